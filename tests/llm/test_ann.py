from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.llm.ann import FULL, PROBES, TABLES, WIDTH, Hashes, _probes, functions_for, nearest, perturbations

QUERY = "vec_id % 50 = 0"


def exact(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        yield q, ids[np.lexsort((ids, -s))[:k]]


def test_recall_and_scores(spark):
    x = np.random.default_rng(3).normal(size=(3000, 24))
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.expr(QUERY)).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    hits = [len({r.vec_id for r in found[q]} & set(want)) / 5 for q, want in exact(x)]
    assert np.mean(hits) >= 0.9
    for q, rs in found.items():
        assert [r.rank for r in rs] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(rs, rs[1:]))
        for r in rs:
            assert abs(r.score - x[q] @ x[r.vec_id] / np.linalg.norm(x[q]) / np.linalg.norm(x[r.vec_id])) < 1e-12


def test_hot_vector_is_salted_and_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12_000, 8))
    x[::2] = x[0]
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") == 50)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [0, 2, 4, 6, 8]


def test_odd_vectors(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (7, [1.0, 1.0]), (9, [float("inf"), 0.0]), (10, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("key", F.lit("x"))
    assert [(r.rank, r.vec_id) for r in nearest(frame, F.expr(QUERY)).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 7)]
    assert nearest(frame.limit(0), F.expr(QUERY)).collect() == []


def test_perturbations_are_valid_and_ordered():
    sets = perturbations(4, 60)
    assert len(set(sets)) == len(sets) and sets[0] == (0,)
    assert all(7 - j not in s for s in sets for j in s)


def visited(hashes, x, queries, probes):
    """Which rows each query scores, by the functions that the tasks use."""
    key = hashes.keys(np.floor(hashes.places(x)))
    batch = pa.RecordBatch.from_arrays([pa.array(queries), pa.array(list(x[queries]), pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    out = np.zeros((len(queries), len(x)), bool)
    for k, found in enumerate(_probes(hashes, probes)(iter([batch]))):
        out[k] = np.isin(key, found.column("key").to_numpy().view(np.uint64)).any(axis=1)
    return out


def test_visited_share_falls_with_the_rows():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.arange(0, 50_000, 400)
    for n, most in ((2000, 0.6), (10_000, 0.3), (50_000, 0.1)):
        part, asks = x[:n], queries[queries < n]
        seen = visited(Hashes(64, TABLES, functions_for(n), WIDTH), part, asks, PROBES)
        near = part[asks] @ part.T
        near[np.arange(len(asks)), asks] = -2
        best = np.argsort(-near, axis=1)[:, :5]
        recall = np.take_along_axis(seen, best, axis=1).mean()
        assert seen.mean() < most and recall >= 0.9, (n, seen.mean(), recall)


def test_functions_follow_the_rows():
    sizes = [functions_for(n) for n in (0, 1, 399, 400, 401, 1000, 10**4, 10**5, 10**6, 10**9, 10**11)]
    assert sizes[:4] == [0, 0, 0, 0] and sizes == sorted(sizes) and sizes[-1] > sizes[-2] > sizes[-3]


def test_borders_of_a_full_scan(spark):
    rng = np.random.default_rng(7)
    for n in (200, 201, FULL, FULL + 1):
        x = rng.standard_normal((n, 16))
        frame_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r.vec_id) for r in nearest(frame_, F.col("vec_id") % 50 == 0).collect()}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = set()
        for q in range(0, n, 50):
            near = unit @ unit[q]
            near[q] = -2
            want |= {(q, int(i)) for i in np.argsort(-near)[:5]}
        assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)
