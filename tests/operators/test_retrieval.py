from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import retrieval
from colloquy.plans import catalogue

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=1300):
    x = np.random.default_rng(2).standard_normal((n, 8)).astype(np.float32)
    x[40:60] = x[7]  # equal distances: the smaller id comes first
    return [(i, row.tolist(), i % 10) for i, row in enumerate(x)]


def brute(data, k, queries):
    out = []
    for i in queries:
        q = np.array(data[i][1], float)
        found = []
        for j, v, _ in data:
            if j != i:
                v = np.array(v, float)
                found.append((round(1 - float(q @ v) / float(np.sqrt(q @ q) * np.sqrt(v @ v)), 9), j))
        out += [(i, j, r + 1) for r, (_, j) in enumerate(sorted(found)[:k])]
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(vectors(), SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_every_fiftieth_vector_is_a_query(spark, stored):
    got = catalogue.QUERIES["q26_vector_topk"](spark, stored).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == sorted((i, j, r) for i, j, r in brute(vectors(), 10, range(0, 1300, 50)))
    assert catalogue.QUERIES["q33_recall_mrr"](spark, stored).first().n_queries == 26
    for name in ("q27_vector_topk_prefilter", "q28_variant_merge", "q29_rrf_fusion", "q30_scored_retrieval", "q31_session_diversity", "q32_rerank_blend"):
        assert {r.query_id for r in catalogue.QUERIES[name](spark, stored).select("query_id").distinct().collect()} == set(range(0, 1300, 50))


def test_blocks_of_queries_give_the_same(spark, stored, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 5)
    got = catalogue.QUERIES["q26_vector_topk"](spark, stored).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == sorted(brute(vectors(), 10, range(0, 1300, 50)))
    none = spark.read.parquet(f"{stored}/embeddings.parquet").where(F.lit(False))
    assert retrieval.vector_topk(none, none.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 3).collect() == []


def test_vectors_without_a_distance_take_no_part(spark):
    data = vectors(120)
    odd = [(200, None, 0), (201, [0.0] * 8, 0), (202, [None] + [1.0] * 7, 0), (203, [float("nan")] * 8, 0), (204, [1.0] * 5, 0), (None, [1.0] * 8, 0), (250, [0.0] * 8, 0)]
    rows = spark.createDataFrame(data + odd, SCHEMA)
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = retrieval.vector_topk(rows, queries, 10).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == sorted(brute(data, 10, (0, 50, 100)))
