"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are byte trigrams, word shapes and marks of repeated words, hashed
to ``TERMS`` columns. Term counts, damped by a logarithm, are weighted by inverse
document frequency over all documents. A truncated singular value decomposition
of the labelled sample gives ``DIMENSIONS`` latent axes. The labelled vectors are
broadcast (at most ``2 * SAMPLE_A_CLASS`` of them, a fixed bound), every document
gets the exact cosines to all of them in blocks, and its ``NEIGHBOURS`` nearest
vote with their similarity, times the documents of their class for each sampled one.

The shares of repeated, capitalised and symbol-ended words are three further terms.
They stand on a scale of their own (``_SHARE`` times the share, weight 3), as nearly
every text has some of such words, so that document frequency would silence them.

The sample takes the labelled rows with the smallest hashes of their ids,
``SAMPLE_A_CLASS`` at most of each label; rows of the held-out fold are never
in it. Everything but the sample covers all documents; class shares are counted
over all labelled ones outside that fold, so scores don't lean to the rarer class
where the sample is bounded.

Edge cases: null and empty texts have no terms and get the share of label 1 among
the labelled documents, 0.5 without labels; repeated rows get equal scores; labels other
than 0 and 1, of any type, are ignored, of several labels of an id the smallest counts; a null
id is never held out and has no label; other columns are ignored; an empty table
gives an empty result. Long texts are read whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._bytes import LOWER, PrefixHasher, slices, utf8_buffers, words
from ._tables import KEY, quoted, row_keys

TERMS, DIMENSIONS, NEIGHBOURS = 2048, 64, 15
SAMPLE_A_CLASS = 2000
THRESHOLD = 0.7
_SHARE = 12.0
#: Bounds of a slice: a row has ``TERMS`` counts however short its text is, and these are copied several times.
_BYTES, _ROWS = 1 << 18, 256
_MARKS = 64  # first columns: marks and shapes, the rest are trigrams

#: Byte classes for word shapes: lower, upper, digit, separator-like, other ASCII, non-ASCII.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3
_CLASS[128:] = 5


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of each row of a slice: (rows, TERMS) float32."""
    rows, n = len(offsets) - 1, len(data)
    out = np.zeros(rows * TERMS, np.float32)
    if n >= 3:
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
        code = data[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1:-1].astype(np.uint32) * np.uint32(0x85EBCA6B) + data[2:].astype(np.uint32) * np.uint32(0xC2B2AE35)
        code = _MARKS + (code >> np.uint32(12)) % np.uint32(TERMS - _MARKS)
        one = row[:-2] == row[2:]
        out += np.bincount((row[:-2] * TERMS + code.astype(np.int32))[one], minlength=rows * TERMS)
    start, end, row = words(data, offsets)
    if len(start):
        shape = _CLASS[data]
        first, last, size = shape[start], shape[end - 1], end - start
        middle = shape[start + size // 2]
        out += np.bincount(row * TERMS + first * 6 + last, minlength=rows * TERMS)
        word = PrefixHasher(LOWER[data]).of(start, end)
        total = np.maximum(np.bincount(row, minlength=rows), 1)
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        # shares of repeated, capital and symbol-ended words; log1p gives back _SHARE times the share
        for k, mark in enumerate((same, (middle == 1) & (size > 2), last == 4)):
            out[np.arange(rows) * TERMS + 37 + k] = np.expm1(_SHARE * np.bincount(row[mark], minlength=rows) / total)
        out += np.bincount(row * TERMS + 40 + middle, minlength=rows * TERMS)
        out += np.bincount(row * TERMS + 46 + np.minimum(size // 4, 9), minlength=rows * TERMS)
    return out.reshape(rows, TERMS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of counts, in their place."""
    np.log1p(counts, out=counts)
    counts *= idf
    for i in range(0, len(counts), _ROWS):
        norm = np.linalg.norm(counts[i : i + _ROWS], axis=1, keepdims=True)
        counts[i : i + _ROWS] /= np.where(norm > 0, norm, 1)
    return counts


def _document_frequency(batches):
    total = np.zeros(TERMS + 1, np.int64)
    for batch in batches:
        raw, off = utf8_buffers(batch.column("text"))
        for i, j in slices(off, _BYTES, _ROWS):
            total[:-1] += (term_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i]) > 0).sum(axis=0)
            total[-1] += j - i
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], names=["term", "n"])


def _latent_axes(x: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors, by randomised subspace iteration."""
    k = min(k, *x.shape)
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt[:k].T).astype(np.float32)


def held_out(id_col: str = "doc_id", of: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == fold, F.lit(False))


def _fit(idf: np.ndarray, totals: dict[int, int]):
    """Axes and vectors of the whole sample, which comes in one partition."""

    def run(batches):
        seen = []
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            quality, times = batch.column("quality").to_pylist(), batch.column("times").to_pylist()
            for i, j in slices(off, _BYTES, _ROWS):
                x = term_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                seen += [(zlib.crc32(r), r, q, t) for r, q, t in zip((r.tobytes() for r in x), quality[i:j], times[i:j])]
        if not seen:
            return
        seen.sort()  # the order of arrival must not count
        y, times = np.array([x[2] for x in seen]), np.array([x[3] for x in seen], float)
        x = np.empty((len(seen), TERMS), np.float32)
        for i in range(len(seen) - 1, -1, -1):
            x[i] = np.frombuffer(seen.pop()[1], np.float32)
        x = _weighted(x, idf)
        axes = _latent_axes(x, DIMENSIONS)
        v = x @ axes
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        # documents that a sampled one of its class stands for
        sampled = np.bincount(y, times, minlength=2)
        weights = times * np.array([totals.get(q, 0) / max(sampled[q], 1) for q in (0, 1)])[y]
        yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (axes, v, y.astype(np.float32), weights)], names=["axes", "vectors", "labels", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_a_class: int = SAMPLE_A_CLASS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: idf, axes, labelled vectors, their labels and weights.

    Fitted in one task of an executor, on ``2 * sample_a_class`` texts at most.
    The driver gets its numbers only: some MB, whatever the corpus.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row_keys(id_col, text_col))
    df = dict(docs.select("text").mapInArrow(_document_frequency, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n = df.get(TERMS, 0)
    idf = np.log((n + 1) / (np.array([df.get(t, 0) for t in range(TERMS)]) + 1)).astype(np.float32) + np.float32(0.1)
    idf[37:40] = 3  # the share marks are scaled already
    quality = F.expr("try_cast(quality as double)")
    usable = labels.where(quality.isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(quality).cast("int").alias("quality"))
    of_class = docs.select("doc_id").join(usable, "doc_id").groupBy("quality", "doc_id").agg(F.count("*").alias("rows"))
    totals = dict(of_class.groupBy("quality").agg(F.sum("rows")).collect())  # two rows at most
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = [of_class.where(F.col("quality") == q).orderBy(*order).limit(sample_a_class).select("doc_id", "quality") for q in (0, 1)]
    # an id may have many rows: equal ones count as one with a weight, and the bound holds for the rest
    rows = docs.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("quality", "doc_id", *KEY).agg(F.count("*").alias("times"), F.first("text").alias("text"))
    sample = [rows.where(F.col("quality") == q).orderBy(*order, *KEY).limit(sample_a_class).select("text", "quality", "times") for q in (0, 1)]
    got = sample[0].union(sample[1]).coalesce(1).mapInArrow(_fit(idf, totals), "axes binary, vectors binary, labels binary, weights binary").first()
    if not got:
        return {"idf": idf, "axes": None, "vectors": None, "labels": None, "weights": None, "prior": 0.5}
    y, weights = np.frombuffer(got["labels"], np.float32), np.frombuffer(got["weights"])
    return {
        "idf": idf, "axes": np.frombuffer(got["axes"], np.float32).reshape(TERMS, -1), "vectors": np.frombuffer(got["vectors"], np.float32).reshape(len(y), -1),
        "labels": y, "weights": weights, "prior": float((weights * y).sum() / weights.sum()),
    }


def _vote(model, neighbours: int, text: int | None = None):
    """Scores of rows; ``text``: which field of the kept ones is the text, if it has no column of its own."""

    def run(batches):
        m = model.value
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text") if text is None else batch.column("kept").field(text))
            rest = [c for c in batch.schema.names[2:] if c == "kept"]
            # each slice goes out at once: the batch may hold all texts of a partition
            for i, j in slices(off, _BYTES, _ROWS):
                score = np.full(j - i, m["prior"])
                if m["axes"] is not None:
                    v = _weighted(term_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i]), m["idf"]) @ m["axes"]
                    norm = np.linalg.norm(v, axis=1)
                    at = np.flatnonzero(norm > 1e-9)
                    cos = (v[at] / norm[at, None]) @ m["vectors"].T
                    k = min(neighbours, cos.shape[1])
                    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                    weight = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6).astype(float) ** 4 * m["weights"][near]
                    score[at] = (weight * m["labels"][near]).sum(axis=1) / weight.sum(axis=1)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(np.clip(score, 0, 1)), *map(own.column, rest)], names=["doc_id", "held_out", "score", *rest])
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, sample_a_class: int = SAMPLE_A_CLASS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; ``keep`` columns in a struct ``kept``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample_a_class, id_col, text_col))
    kept = [F.struct(*quoted(keep)).alias("kept")] if keep else []
    # a text that is kept goes to the workers once
    at = keep.index(text_col) if text_col in keep and "." not in text_col and dict(docs.dtypes)[text_col] == "string" else None
    texts = [F.coalesce(F.col(text_col), F.lit("")).alias("text")] if at is None else []
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), *texts, *kept)
    # as a type, since names of kept columns may not be written in a schema string
    schema = StructType([rows.schema["doc_id"], rows.schema["held_out"], StructField("score", DoubleType()), *(rows.schema[c] for c in ["kept"] * bool(keep))])
    scored = rows.mapInArrow(_vote(model, neighbours, at), schema)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *(["kept"] if keep else []))
