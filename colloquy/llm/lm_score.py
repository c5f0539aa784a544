"""Language-model scores of texts by a subword lattice.

A text is its lower-cased words and an end. The pieces of an existing
subword vocabulary segment a word, with a mark in front, in many ways; the word's
probability is the sum over all of them, by a forward recursion in log space.
Piece weights start from the vocabulary's scores and are re-estimated on the
training words by expectation maximisation (``ROUNDS`` rounds; every piece
keeps ``SMOOTH`` counts). As the mark begins each word and nothing else, word
probabilities sum to 1, and with the chance of the end so do those of texts.

``base_score`` is an add-one unigram over whole words. Its counts cover all
training words: the ``FREQUENT`` most frequent words are broadcast, which has a
fixed bound; for all others (word, document) rows are joined.

Edge cases: null and empty texts are the end alone; repeated rows get equal
scores; a null id is in training and never held out; other columns are ignored;
an empty table gives an empty result, and without training texts
counts are 0. Long texts and words are scored whole.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, PrefixHasher, slices, utf8_buffers, words
from ._lattice import expected_counts, load_vocabulary, word_log_probability
from ._tables import row_key, written
from .quality import held_out

ROUNDS, SMOOTH, FREQUENT = 2, 0.01, 1 << 18
_FLUSH = 2_000_000  # words of a task held before their counts are given out




def _batch_words(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a batch, and start, end, row and hash of its words."""
    raw, off = utf8_buffers(batch.column("text"))
    data = LOWER[raw[off[0] : off[-1]]]
    parts = []
    for i, j in slices(off):
        lo = off[i] - off[0]
        start, end, row = words(data[lo : off[j] - off[0]], off[i : j + 1] - off[i])
        if len(start):
            parts.append((start + lo, end + lo, row + i, PrefixHasher(data[lo : off[j] - off[0]]).of(start, end)))
    if not parts:
        z = np.zeros(0, np.int64)
        return data, z, z, z, z.view(np.uint64)
    return data, *(np.concatenate(x) for x in zip(*parts))


def _word_counts(batches):
    """(hash, word, times) of the task's words, combined in batches."""
    held: dict[int, list] = {}
    for batch in batches:
        data, start, end, _, code = _batch_words(batch)
        key, first, n = np.unique(code, return_index=True, return_counts=True)
        view = memoryview(data)
        for k, s, e, c in zip(key.view(np.int64).tolist(), start[first].tolist(), end[first].tolist(), n.tolist()):
            if k in held:
                held[k][1] += c
            else:
                held[k] = [bytes(view[s:e]), c]
        if len(held) > _FLUSH // 4:
            yield _counted(held)
            held = {}
    if held:
        yield _counted(held)


def _counted(held: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([x[0] for x in held.values()], pa.binary()), pa.array([x[1] for x in held.values()], pa.int64())], names=["h", "word", "n"])


def _expect(path, log_p):
    def run(batches):
        vocabulary, _ = load_vocabulary(path)
        total = np.zeros(len(vocabulary.pieces))
        for batch in batches:
            raw, off = utf8_buffers(batch.column("word"))
            total += expected_counts(vocabulary, log_p.value, raw, off[:-1], off[1:], batch.column("n").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["piece", "n"])

    return run


def _score(model):
    def run(batches):
        m = model.value
        vocabulary, _ = load_vocabulary(m["path"])
        for batch in batches:
            data, start, end, row, code = _batch_words(batch)
            rows = batch.num_rows
            key, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            log10 = word_log_probability(vocabulary, m["log_p"], data, start[first], end[first]) / np.log(10) + m["go_on"]
            count = np.bincount(row, minlength=rows)
            score = np.bincount(row, weights=log10[inverse], minlength=rows) + m["stop"]
            at = np.minimum(np.searchsorted(m["key"], key), max(len(m["key"]) - 1, 0))
            known = m["key"][at] == key if len(m["key"]) else np.zeros(len(key), bool)
            times = np.where(known, m["times"][at], 0) if len(m["key"]) else np.zeros(len(key))
            base = np.bincount(row, weights=(np.log10(times + 1) - m["log_all"])[inverse], minlength=rows) + m["end_base"]
            n_known = np.bincount(row, weights=known[inverse], minlength=rows).astype(np.int64) + m["end_known"]
            # words beyond the frequent ones, with their times in the text, for the join
            rare = ~known[inverse] if m["more"] else np.zeros(len(row), bool)
            r, k = row[rare], inverse[rare]
            pair, n = np.unique(r * max(len(key), 1) + k, return_counts=True)
            r, k = pair // max(len(key), 1), pair % max(len(key), 1)
            offsets = pa.array(np.searchsorted(r, np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rid", "doc_id", "held_out")), pa.array(count + 1), pa.array(n_known), pa.array(base), pa.array(score),
                 pa.ListArray.from_arrays(offsets, pa.array(key[k].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "rare_n"],
            )

    return run


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(h, n) of the words above a count, which is as low as ``most`` rows allow.

    The count comes from a table of sixteenths of powers of two, so that no task or
    the driver sees more rows than are taken.
    """
    level = F.floor(F.log2(F.col("n")) * 16)
    total, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1024 rows
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(F.lit(False) if least is None else level >= least).select("h", "n")


def score_texts(docs: DataFrame, vocabulary_path: str | None = None, rounds: int = ROUNDS, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), held_out(id_col, 7, 2).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = rows.where("not held_out").select("text")
    counts = written(train.mapInArrow(_word_counts, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("n")), "op9-words")
    ends = train.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_distinct = n_words + ends, distinct + (ends > 0)

    _, log_p = load_vocabulary(vocabulary_path)
    for _ in range(rounds if n_words else 0):
        expected = counts.mapInArrow(_expect(vocabulary_path, sc.broadcast(log_p)), "piece long, n double").groupBy("piece").agg(F.sum("n"))
        got = np.zeros(len(log_p))
        for piece, n in expected.collect():  # one row a piece of the vocabulary
            got[piece] = n
        log_p = np.log((got + SMOOTH) / (got + SMOOTH).sum())

    top = _most_frequent(counts, frequent).toArrow()
    key = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    log_all = np.log10(n_all + n_distinct + 1)
    stop = (ends + 1) / (n_all + 2)
    model = sc.broadcast({
        "path": vocabulary_path, "log_p": log_p, "key": key[order], "times": top["n"].to_numpy().astype(float)[order], "log_all": log_all, "more": distinct > len(key),
        "go_on": np.log10(1 - stop), "stop": np.log10(stop), "end_base": np.log10(ends + 1) - log_all, "end_known": int(ends > 0),
    })
    schema = f"rid long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, rare_n array<int>"
    scored = written(rows.mapInArrow(_score(model), schema), "op9-scored")
    train_tokens = F.lit(n_all).cast("long").alias("train_tokens")
    if distinct <= len(key):
        return scored.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens, F.col("base").alias("base_score"), "score")
    # repeated rows give their rare words once
    pairs = scored.where(F.size("rare") > 0).select("rid", "rare", "rare_n").dropDuplicates(["rid"]).select("rid", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("rare_n").alias("k"))))
    found = pairs.join(counts.select("h", F.col("n").alias("c")), "h").groupBy("rid").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_base"))
    return scored.drop("rare", "rare_n").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), train_tokens,
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
