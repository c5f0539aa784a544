from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm._bwt import repeated_starts
from colloquy.llm.suffix_dedup import repeated_spans

from .corpus import SCHEMA, frame, null_last, rows


def brute(pairs, n=200):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for z in range(len(b)) if gone[z] and (z == 0 or not gone[z - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("block_bytes", [400_000, 600])
def test_against_every_substring(spark, block_bytes):
    got = sorted((tuple(r)[:5] for r in repeated_spans(frame(spark), block_bytes=block_bytes).collect()), key=null_last)
    assert got == sorted(brute([r[:2] for r in rows()]), key=null_last)


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_block_expansion_matches_counting():
    rng = np.random.default_rng(2)
    for _ in range(30):
        texts = [rng.integers(1, 4, rng.integers(1, 60)).astype(np.uint8) for _ in range(6)]
        n = int(rng.integers(2, 9))
        sym = np.concatenate([np.append(t, np.uint8(0)) for t in texts])
        ends = np.repeat(np.cumsum([len(t) + 1 for t in texts]) - 1, [len(t) + 1 for t in texts])
        valid = np.arange(len(sym)) + n <= ends
        seen = Counter(sym[k : k + n].tobytes() for k in np.flatnonzero(valid))
        want = np.array([bool(v) and seen[sym[k : k + n].tobytes()] > 1 for k, v in enumerate(valid)])
        assert (repeated_starts(sym, valid, np.ones(len(sym), np.int8), n) == want).all()
