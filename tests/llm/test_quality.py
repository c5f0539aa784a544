from __future__ import annotations

import random
import zlib

import numpy as np

from colloquy.llm.quality import score_quality

from .corpus import SCHEMA, frame, rows, words


def labelled(n=400):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        text, good = words(rng, 80), i % 4 != 0
        docs.append((i, text if good else " ".join(w + rng.choice(["%%%", "###"]) for w in text.split())))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    got = score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in score_quality(frame_, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped))
    assert a == b


def test_labels_of_any_type_and_repeated_ids(spark):
    docs, labels = labelled(120)
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    scores = [{r.doc_id: r.score for r in score_quality(frame_, spark.createDataFrame([(i, kind(q)) for i, q in labels], f"doc_id long, quality {name}"), sample_a_class=20).collect()} for name, kind in (("int", int), ("long", int), ("double", float), ("string", str))]
    assert all(s == scores[0] for s in scores)
    # one id with most of the rows, equal and different ones, stays within the bound
    hot = docs[:50] + [(1, docs[1][1])] * 200 + [(1, f"{docs[3][1]} {k}") for k in range(100)]
    got = score_quality(spark.createDataFrame(hot, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), sample_a_class=20).collect()
    assert len(got) == len(hot) and all(0 <= r.score <= 1 for r in got)


def brute(docs, labels, neighbours=15):
    """The vote from all pairwise cosines in plain numpy, for samples below the bound."""
    from colloquy.llm.quality import DIMENSIONS, TERMS, term_counts

    raw = [(t or "").encode() for _, t in docs]
    counts = term_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    idf = np.log((len(docs) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.1
    idf[37:40] = 3
    x = np.log1p(counts.astype(float)) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = dict(labels)
    fit = [k for k, (i, _) in enumerate(docs) if i in want and zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([want[docs[k][0]] for k in fit])
    axes = np.linalg.svd(x[fit], full_matrices=False)[2][: min(DIMENSIONS, len(fit), TERMS)].T
    v = x @ axes
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    out = {}
    for (i, t), row in zip(docs, v):
        cos = v[fit] @ row
        near = np.argsort(-cos)[:neighbours]
        weight = np.maximum(cos[near], 1e-6) ** 4
        out[i] = (weight * y[near]).sum() / weight.sum() if t else y.mean()
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, 30) + (" # % #" * rng.randint(0, 6))) for i in range(50)] + [(900, None)]
    labels = [(i, int(t.count("#") < 5)) for i, t in docs[:50]]
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = brute(docs, labels)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None), (None, 1), (5, 9), (3, 1)], "doc_id long, quality int")
    got = score_quality(frame(spark), labels, keep=("rid", "lang")).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got) and got[0].kept.rid in ("r", None)
    assert {r.score for r in score_quality(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert score_quality(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_scores_keep_the_class_shares_of_a_bounded_sample(spark):
    docs, labels = labelled()
    docs += [(1000, ""), (1001, None)]
    usable = [q for i, q in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for bound in (20, 2000):
        got = {r.doc_id: r.score for r in score_quality(*frames, sample_a_class=bound).collect()}
        assert abs(got[1000] - sum(usable) / len(usable)) < 1e-9 and got[1001] == got[1000]


def test_votes_count_for_the_class_they_stand_for(spark):
    rng = random.Random(9)
    docs = [(i, words(rng, 60)) for i in range(400)]  # labels without relation to the text: scores are shares
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 != 0)) for i, _ in docs], "doc_id long, quality int")
    got = [r.score for r in score_quality(*frames, sample_a_class=20).where("held_out").collect()]
    assert sum(got) / len(got) > 0.75


class Model:
    """As a broadcast."""

    def __init__(self, n=50):
        from colloquy.llm.quality import DIMENSIONS, TERMS

        g = np.random.default_rng(3)
        self.value = {
            "idf": np.ones(TERMS, np.float32), "axes": g.standard_normal((TERMS, DIMENSIONS)).astype(np.float32), "vectors": g.standard_normal((n, DIMENSIONS)).astype(np.float32),
            "labels": (np.arange(n) % 2).astype(np.float32), "weights": np.ones(n), "prior": 0.25,
        }


def test_memory_of_many_short_texts():
    import tracemalloc

    import pyarrow as pa

    from colloquy.llm.quality import _document_frequency, _vote

    n = 6000
    texts = pa.array([None if i % 7 == 0 else "" if i % 7 == 1 else f"word {i}" for i in range(n)])
    ids, flags = pa.array(range(n)), pa.array([False] * n)
    for run in (_document_frequency, _vote(Model(), 15)):
        tracemalloc.start()
        got = list(run(iter([pa.RecordBatch.from_arrays([ids, flags, texts], names=["doc_id", "held_out", "text"])])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6, (run, peak)
    out = pa.Table.from_batches(got)
    assert out.column("doc_id").to_pylist() == list(range(n))
    assert [x == 0.25 for x in out.column("score").to_pylist()] == [i % 7 < 2 for i in range(n)]


def test_kept_texts_go_out_by_slices():
    import pyarrow as pa

    from colloquy.llm.quality import _vote

    texts = [None if i % 50 == 0 else f"line {i} of a text, and so on. " * (i % 90) for i in range(600)]
    ids, flags = pa.array(range(600)), pa.array([i % 3 == 0 for i in range(600)])
    kept = pa.StructArray.from_arrays([ids, pa.array(texts)], names=["doc_id", "text"])
    with_text = pa.RecordBatch.from_arrays([ids, flags, pa.array([x or "" for x in texts])], names=["doc_id", "held_out", "text"])
    once = pa.RecordBatch.from_arrays([ids, flags, kept], names=["doc_id", "held_out", "kept"])
    # a slice of a batch too, whose arrays begin elsewhere
    for lo, size in ((0, 600), (123, 400)):
        a = pa.Table.from_batches(_vote(Model(), 15)(iter([with_text.slice(lo, size)])))
        parts = list(_vote(Model(), 15, 1)(iter([once.slice(lo, size)])))
        b = pa.Table.from_batches(parts)
        assert a.column("score").equals(b.column("score")) and b.column("held_out").to_pylist() == flags.to_pylist()[lo : lo + size]
        assert b.column("kept").to_pylist() == kept.to_pylist()[lo : lo + size]
        assert len(parts) > 1 and max(len(p) for p in parts) <= 256
        assert max(sum(len(r["text"] or "") for r in p.column("kept").to_pylist()) for p in parts) <= 1 << 18


def test_a_kept_text_goes_to_the_workers_once(spark):
    r = random.Random(12)
    docs = [(i, [None, "", words(r, 30), words(r, 3)][i % 4], "en", "web", 0) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 8 // 4) for i in range(120)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    plain = score_quality(df, labels)
    whole = score_quality(df, labels, keep=tuple(df.columns))
    sent = whole._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1].splitlines()[1]
    assert sent.lstrip(" +:-").startswith("Project [") and " AS text#" not in sent, sent
    want = {x["doc_id"]: x["score"] for x in plain.collect()}
    got = whole.collect()
    assert [tuple(x["kept"]) for x in sorted(got, key=lambda x: x["doc_id"])] == docs
    assert all(abs(want[x["doc_id"]] - x["score"]) < 1e-6 for x in got)
    # a name that is no column of its own, and one that is kept under another case
    for keep in (("doc_id",), ("TEXT", "doc_id")):
        part = score_quality(df, labels, keep=keep).collect()
        assert all(abs(want[x["doc_id"]] - x["score"]) < 1e-6 for x in part) and len(part) == 120
