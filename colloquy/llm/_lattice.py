"""Marginal word probabilities over all segmentations into vocabulary pieces."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

MARK = 256  # the symbol that begins a word
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 2_000_000


class Vocabulary:
    """Pieces as symbol strings, looked up by hash for many places at once."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            keys = np.zeros(len(pieces), np.uint64)
            for k, piece in enumerate(pieces):
                h = np.uint64(0)
                for s in piece:
                    h = h * _BASE + np.uint64(s + 1)
                keys[k] = h
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share a hash")
            self.keys = np.append(keys, np.uint64(0))
            self._mul = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
            self._tables, rest = [], np.arange(len(pieces))
            for mul, bits in zip(self._mul, (22, 20)):
                table = np.full(1 << bits, len(pieces), np.int32)
                slot = (keys[rest] * mul) >> np.uint64(64 - bits)
                table[slot] = rest
                self._tables.append((table, mul, np.uint64(64 - bits)))
                rest = rest[table[slot] != rest]
            self._rest = rest  # as a rule none

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or len(pieces)."""
        none = len(self.pieces)
        with np.errstate(over="ignore"):
            out = np.full(h.shape, none, np.int32)
            for table, mul, shift in self._tables:
                got = table[(h * mul) >> shift]
                hit = (self.keys[got] == h) & (got < none)
                out[hit] = got[hit]
        for k in self._rest:
            out[h == self.keys[k]] = k
        return out


@functools.cache
def load_vocabulary(path: str | None) -> tuple[Vocabulary, np.ndarray]:
    """Pieces and start weights of a sentencepiece model; scores are ranks there.

    Pieces that hold a word mark elsewhere than in front, and control pieces, do
    not take part; byte pieces stand for the bytes that are no piece otherwise.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    weight: dict[tuple[int, ...], float] = {(b,): 1e-7 for b in range(256)} | {(MARK,): 1e-7}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in text[1:]:
            continue
        symbols = tuple(text.removeprefix("▁").encode())
        symbols = (MARK, *symbols) if text[0] == "▁" else symbols
        rank = min(-model.get_score(i), 1e5)
        weight[symbols] = max(weight.get(symbols, 0.0), 1.0 / (10.0 + rank))
    total = sum(weight.values())
    return Vocabulary(list(weight)), np.log(np.array(list(weight.values())) / total)


def by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as (their indices, symbol matrix), in bounded chunks."""
    size = end - start
    order = np.argsort(size, kind="stable")
    bound = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for lo, hi in zip(bound[:-1], bound[1:]):
        n = int(size[order[lo]])
        step = max(1, _CELLS // ((n + 1) * min(n + 1, longest)))
        for a in range(lo, hi, step):
            at = order[a : min(a + step, hi)]
            symbols = np.full((len(at), n + 1), MARK, np.uint64)
            symbols[:, 1:] = data[start[at][:, None] + np.arange(n)]
            yield at, symbols


def _edges(vocabulary: Vocabulary, symbols: np.ndarray) -> list[np.ndarray]:
    """For each piece length, the piece index at every start (len(pieces): none)."""
    n = symbols.shape[1]
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros_like(symbols)
        for size in range(1, min(n, vocabulary.longest) + 1):
            h = h[:, : n - size + 1] * _BASE + symbols[:, size - 1 :] + np.uint64(1)
            out.append(vocabulary.find(h))
    return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _forward(edges: list[np.ndarray], log_p: np.ndarray, rows: int, n: int) -> np.ndarray:
    """alpha[j]: log of the weight of all segmentations of the first j symbols."""
    alpha = np.zeros((n + 1, rows))
    for j in range(1, n + 1):
        alpha[j] = _log_sum([alpha[j - k] + log_p[edges[k - 1][:, j - k]] for k in range(1, min(j, len(edges)) + 1)])
    return alpha


def word_log_probability(vocabulary: Vocabulary, log_p: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    weight = np.append(log_p, -np.inf)
    out = np.zeros(len(start))
    for at, symbols in by_length(data, start, end, vocabulary.longest):
        out[at] = _forward(_edges(vocabulary, symbols), weight, *symbols.shape)[-1]
    return out


def expected_counts(vocabulary: Vocabulary, log_p: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur ``times`` times."""
    weight, total = np.append(log_p, -np.inf), np.zeros(len(log_p) + 1)
    for at, symbols in by_length(data, start, end, vocabulary.longest):
        rows, n = symbols.shape
        edges = _edges(vocabulary, symbols)
        alpha = _forward(edges, weight, rows, n)
        beta = np.zeros((n + 1, rows))
        for i in range(n - 1, -1, -1):
            beta[i] = _log_sum([weight[edges[k - 1][:, i]] + beta[i + k] for k in range(1, min(n - i, len(edges)) + 1)])
        for k, piece in enumerate(edges, 1):
            some = np.nonzero(piece < len(log_p))
            share = np.exp(alpha[some[1], some[0]] + weight[piece[some]] + beta[some[1] + k, some[0]] - alpha[n][some[0]])
            total += np.bincount(piece[some], weights=share * times[at][some[0]], minlength=len(total))
    return total[:-1]
