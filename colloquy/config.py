"""Parameters of retrieval, with the defaults that its queries rely on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    top_pairs: int = 24
    top_friend: int = 32
    top_windows: int = 16
    top_images: int = 8
    top_live: int = 12
    top_final: int = 12
    rrf_k: int = 60
    over_fetch: int = 3
    half_life_days: float = 30.0
    recency_boost: float = 0.15
    warmth_boost: float = 0.12
    pair_boost: float = 1.35
    weight_live: float = 1.08
    weight_history: float = 1.0
    weight_image: float = 0.75
    weight_ai: float = 0.25
    rerank_weight: float = 0.55
    rerank_min_candidates: int = 16
    max_same_session: int = 3


DEFAULT = EngineConfig()
