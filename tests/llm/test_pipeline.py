from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm.quality import score_quality

from .corpus import frame, words
from .test_minhash import brute as groups
from .test_quality import labelled


def test_stages_on_a_small_corpus(spark, tmp_path):
    import random

    docs, labels = labelled(160)
    rng = random.Random(2)
    near = words(rng, 100)
    docs += [(500 + k, f"{near} end{k}") for k in range(4)] + [(600, words(rng, 50) + " password=abcdef123456 end"), (601, None)]
    data = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in docs]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = frame.collect()
    first = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    accepted = {r.doc_id for r in score_quality(first, spark.createDataFrame(labels, "doc_id long, quality int")).collect() if r.predicted}
    assert {r.doc_id for r in seen["quality"]} == accepted
    want = {i for i, _, _, kept in groups([(r.doc_id, r.text) for r in seen["quality"]]) if kept}
    assert {r.doc_id for r in seen["near_dedup"]} == want and 500 in want and 501 not in want
    clean = {r.doc_id: r for r in seen["secrets"]}
    assert set(clean) == want and clean[600].text.endswith("<SECRET> end") and clean[600].n_chars == len(clean[600].text)
    mixed = {r.doc_id for r in seen["mixing"]}
    tokens = lambda rows: sum(len(re.findall(r"\S+", r.text or "")) for r in rows)
    assert mixed <= want and tokens(seen["mixing"]) >= 0.8 * tokens(seen["secrets"])
    assert {r.doc_id for r in seen["packing"]} == mixed
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == mixed


def test_nulls_clashing_names_and_empty_tables(spark, tmp_path):
    labels = [(i, int(i % 3 > 0)) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    odd = frame(spark)
    for name in ("epoch", "n_tokens", "taken_tokens", "domain", "a.b", "row", "rid2", "kept", "quality", "level_0", "root", "group"):
        odd = odd.withColumn(name, F.lit(f"{name}!"))
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert out.count() >= docs.count()
                break
            assert out.columns == columns, name
            kept = out.collect()
            assert all(r["a.b"] == "a.b!" and r["epoch"] == "epoch!" and r["rid2"] == "rid2!" for r in kept)
            if name != "quality":
                docs = spark.createDataFrame(kept, docs.schema)
