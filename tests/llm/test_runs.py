from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import runs as module
from colloquy.llm.registry import op13_periodic_runs
from colloquy.llm.runs import _until_next, collapse_runs, find_in

from .corpus import SCHEMA, frame, null_last, rows


def brute_runs(w, least=6, exponent=4):
    """Every maximal stretch of each period, kept with its smallest one."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((a, n, q) for (a, n), q in found.items())


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def collapsed(w, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def search(w):
    x = np.unique(w, return_inverse=True)[1].astype(np.int64) if len(w) else np.zeros(0, np.int64)
    return find_in(x, _until_next(x, np.zeros(len(x), np.int64)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_against_every_period(parts):
    w = [x for base, times in parts for x in base * times]
    assert search(w) == brute_runs(w)


def test_long_periods_and_short_keys(monkeypatch):
    monkeypatch.setattr(module, "KEY_WORDS", 8)
    monkeypatch.setattr(module, "WINDOW", 64)
    rng = random.Random(3)
    for _ in range(30):
        w = [rng.randrange(4) for _ in range(rng.randrange(40))]
        for _ in range(3):
            base = [rng.randrange(3) for _ in range(rng.choice((1, 2, 3, 16, 17, 31, 32, 33, 63, 64, 65)))]
            w += (base * 6)[: rng.randrange(len(base), 6 * len(base) + 1)] + [rng.randrange(4) for _ in range(rng.randrange(5))]
        assert search(w) == brute_runs(w)


def test_very_repetitive_text_is_quick():
    assert search(["a"] * 300_000) == [(0, 300_000, 1)]
    assert search([1, 2, 3] * 50_000) == [(0, 150_000, 3)]


def data():
    rng = random.Random(8)
    more = []
    for k in range(60):
        base = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))]
        more.append((1000 + k, "  ".join(["start", *base * rng.randint(2, 9), "end"]) + "\n" * (k % 3), "en", "s", 0, "r", "n", 1, "s"))
    long = (2000, "é " + "one two three four five six seven " * 40_000, None, None, 0, "r", "n", 1, "s")
    return rows() + more + [long, (2001, "a A a A a A", None, None, 0, "r", "n", 1, "s"), (2002, "é é é é é é é é é é é é", None, None, 0, "r", "n", 1, "s")]


def test_operator(spark):
    got = collapse_runs(frame(spark, data()))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=lambda r: null_last((r[0], r[3])))
    want = []
    for i, t, *_ in data():
        w = split(t)
        found = [(1, 280_000, 7)] if i == 2000 else brute_runs(w)
        want.append((i, len(w), found, collapsed(w, found)))
    assert got == sorted(want, key=lambda r: null_last((r[0], r[3])))


def test_query_with_planted_tails(spark, tmp_path):
    some = [r for r in data() if r[0] != 2000]
    frame(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=null_last)
    want = []
    for i, t, *_ in some:
        w = planted(i, split(t))
        found = brute_runs(w)
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(collapsed(w, found))))
    assert got == sorted(want, key=null_last)
    assert sum(r[1] > 0 for r in got) > 30


def test_empty_table(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA), tail_seed=F.lit(5)).collect() == []
