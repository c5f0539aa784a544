from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm._lattice import MARK, Vocabulary, expected_counts, word_log_probability
from colloquy.llm.lm_score import score_texts

from .corpus import SCHEMA, frame, null_last, rows


def brute(pairs):
    tokens = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in pairs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) for (i, _), t, h in zip(pairs, tokens, held)]


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_base_score(spark, frequent):
    got = sorted((tuple(r) for r in score_texts(frame(spark), frequent=frequent).collect()), key=null_last)
    want = sorted(brute([r[:2] for r in rows()]), key=null_last)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 0 for r in got)


def test_lattice_sums_all_segmentations():
    pieces = [(MARK,), (MARK, 97), (97,), (98,), (97, 98), (98, 97), (MARK, 97, 98)]
    p = np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.2])
    words = [b"a", b"ab", b"abba", b"bab", b"aabb"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    got = word_log_probability(Vocabulary(pieces), np.log(p), data, start, end)
    uses = np.zeros(len(p))
    for k, w in enumerate(words):
        symbols = (MARK, *w)
        total, mine = 0.0, np.zeros(len(p))
        for cuts in itertools.product([0, 1], repeat=len(w)):
            bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(symbols)]
            parts = [symbols[a:b] for a, b in zip(bounds, bounds[1:])]
            if all(x in pieces for x in parts):
                weight = math.prod(p[pieces.index(x)] for x in parts)
                total += weight
                for x in parts:
                    mine[pieces.index(x)] += weight
        assert got[k] == pytest.approx(math.log(total))
        uses += mine / total
    assert np.allclose(expected_counts(Vocabulary(pieces), np.log(p), data, start, end, np.ones(len(words))), uses)


def test_empty_tables(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (only,) = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0)
