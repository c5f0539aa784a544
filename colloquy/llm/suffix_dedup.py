"""Removal of byte strings that repeat anywhere in a corpus.

A byte goes if some string of ``min_bytes`` bytes that covers it also starts at
another position, in the same text or another one. Strings never cross texts
and are judged on the input.

1. Every start position belongs to the smallest hash of the ``anchor_bytes``-grams
   inside its string, so equal strings meet under one anchor. Consecutive starts
   with one place of the anchor form a *piece*: few rows, no text.
2. Anchors that occur once are left (a join on counts, combined before the
   shuffle); equal pieces become one with a weight.
3. The texts of anchors with several different pieces are laid out in blocks of
   bounded size. Breadth-first backward extension on the block's
   Burrows-Wheeler transform (:mod:`._bwt`) yields interval borders by
   increasing common prefix and stops at ``min_bytes``.
4. The start runs go back to all copies of a piece, and to the texts.

A hot anchor, with more than ``block_bytes`` of different pieces, is cut into
single starts that are grouped by the string itself, in a skew-safe join.

Edge cases: null or empty texts, and texts below ``min_bytes``, keep all bytes
(0 spans); an empty table gives an empty result; repeated rows count as
separate texts, so long ones lose everything; a null id is returned as null;
columns besides id and text are ignored. Very long texts are processed whole,
one at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BYTE_CODE, PrefixHasher, mix64, slices, utf8_buffers
from ._bwt import repeated_starts
from ._tables import row_key, split_by_keys, written

MIN_BYTES = 200
ANCHOR_BYTES = 72
BLOCK_BYTES = 400_000
_POSITION_BITS = 24

_PIECES = "anchor long, piece long, rid long, start int, size int"
_RUN = "array<struct<lo:int,hi:int>>"


def _anchors(data: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the anchor within each string of ``min_bytes`` bytes.

    The anchor is the gram with the smallest hash, the leftmost of equal ones.
    Returns the positions and the hashes of all grams.
    """
    with np.errstate(over="ignore"):
        power, m = {1: BYTE_CODE[data]}, 1
        while 2 * m <= gram:
            power[2 * m] = power[m][:-m] * np.uint64(pow(PrefixHasher.BASE, m, 1 << 64)) + power[m][m:]
            m *= 2
        n, at = len(data) - gram + 1, 0
        h = np.zeros(n, np.uint64)
        for m in sorted(power, reverse=True):
            if gram - at >= m:
                h = h * np.uint64(pow(PrefixHasher.BASE, m, 1 << 64)) + power[m][at : at + n]
                at += m
        h = mix64(h)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    best, window, m = (h & ~low) | (np.arange(n, dtype=np.uint64) & low), min_bytes - gram + 1, 1
    while 2 * m <= window:
        best = np.minimum(best[:-m], best[m:])
        m *= 2
    if rest := window - m:
        best = np.minimum(best[:-rest], best[rest:])
    first = np.arange(len(best), dtype=np.int64)
    return first + (((best & low).astype(np.int64) - first) & int(low)), h


def _pieces(min_bytes: int, gram: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                data = raw[off[i] : off[j]]
                if len(data) < min_bytes:
                    continue
                anchor, gram_hash = _anchors(data, min_bytes, gram)
                n, o = len(anchor), off[i : j + 1] - off[i]
                row = np.repeat(np.arange(j - i), np.diff(o))[:n]
                inside = np.arange(n) + min_bytes <= o[1:][row]
                cut = np.ones(n, bool)
                cut[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(cut & inside)
                stop = np.append(np.flatnonzero(cut | ~inside), n)
                end = stop[np.searchsorted(stop, start, side="right")] + min_bytes - 1
                view = memoryview(data)
                code = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hash[anchor[start]].view(np.int64)), pa.array(code.view(np.int64)), pa.array(rid[i:j][row[start]]), pa.array((start - o[row[start]]).astype(np.int32)), pa.array((end - start).astype(np.int32))],
                    names=["anchor", "piece", "rid", "start", "size"],
                )

    return run


def _cut_out(batches):
    """Texts of the wanted pieces of each document."""
    for batch in batches:
        raw, off = utf8_buffers(batch.column("text"))
        wanted = batch.column("wanted")
        flat, row = wanted.flatten(), np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        start = flat.field("start").to_numpy().astype(np.int64) + off[:-1][row]
        size = flat.field("size").to_numpy()
        view = memoryview(raw)
        for lo in range(0, len(row), 20_000):
            part = slice(lo, lo + 20_000)
            text = [bytes(view[s : s + z]) for s, z in zip(start[part].tolist(), size[part].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(c)[part] for c in ("block", "anchor", "piece", "weight")), pa.array(text, pa.binary())],
                names=["block", "anchor", "piece", "weight", "text"],
            )


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _expand(min_bytes: int):
    def block(table: pa.Table) -> pa.Table:
        raw, off = utf8_buffers(table.column("text"))
        size = np.diff(off)
        o = off[:-1] - off[0] + np.arange(len(size))  # one terminator after each text
        present = np.zeros(256, bool)
        present[raw[off[0] : off[-1]]] = True
        code = np.zeros(256, np.uint8)
        code[present] = np.arange(1, present.sum() + 1)
        total = int(size.sum()) + len(size)
        sym, body = np.zeros(total, np.uint8), np.ones(total, bool)
        body[o + size] = False
        sym[body] = code[raw[off[0] : off[-1]]]
        row = np.repeat(np.arange(len(size)), size + 1)
        valid = np.arange(total) + min_bytes <= (o + size)[row]
        weight = np.minimum(table.column("weight").to_numpy(), 2).astype(np.int8)[row]
        lo, hi = _runs(repeated_starts(sym, valid, weight, min_bytes))
        # a run ends with its text, as the last starts of a text are never valid
        r = row[lo]
        return pa.table({
            "anchor": table.column("anchor").take(pa.array(r)), "piece": table.column("piece").take(pa.array(r)),
            "lo": pa.array((lo - o[r]).astype(np.int32)), "hi": pa.array((hi - o[r]).astype(np.int32)),
        })

    return block


def _single_starts(min_bytes: int):
    """One row for each start in the pieces of hot anchors."""

    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            for i in range(len(off) - 1):
                view = memoryview(raw[off[i] : off[i + 1]])
                n = len(view) - min_bytes + 1
                code = np.fromiter((xxhash.xxh3_64_intdigest(view[k : k + min_bytes]) for k in range(n)), np.uint64, n)
                same = [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64)) for c in ("anchor", "piece", "weight")]
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *same, pa.array(np.arange(n, dtype=np.int32))], names=["string", "anchor", "piece", "weight", "at"])

    return run


def _apply(min_bytes: int):
    """Merge a document's start runs, and digest what is left."""

    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            ids, runs = batch.column("doc_id"), batch.column("runs").to_pylist()
            out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for i, got in enumerate(runs):
                view, digest, spans, done = memoryview(raw[off[i] : off[i + 1]]), hashlib.sha256(), [], 0
                for x in sorted((x["lo"], x["hi"]) for x in got or ()):
                    end = x[1] + min_bytes - 1
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([x[0], end])
                for s, e in spans:
                    digest.update(view[done:s])
                    done = e
                digest.update(view[done:])
                out["n_removed"].append(sum(e - s for s, e in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append([{"lo": s, "hi": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(off)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    ``spans`` are the maximal removed byte ranges [lo, hi). See the module for
    the method and the edge cases.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("rid"))
    pieces = written(docs.where(F.octet_length("text") >= min_bytes).select("rid", "text").mapInArrow(_pieces(min_bytes, anchor_bytes), _PIECES), "op1-pieces")
    again = pieces.groupBy("anchor").count().where("count > 1").select("anchor")
    found = written(pieces.join(again, "anchor"), "op1-found")

    distinct = written(found.groupBy("anchor", "piece").agg(F.count("*").alias("weight"), F.min(F.struct("rid", "start", "size")).alias("at")), "op1-distinct")
    anchors = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("at.size").alias("bytes")).where("n > 1")
    total = anchors.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.when(F.col("bytes") <= block_bytes, F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).otherwise(-1)
    wanted = (
        distinct.join(anchors, "anchor")
        .select("at.rid", F.struct(block.alias("block"), "anchor", "piece", "weight", "at.start", "at.size").alias("x"))
        .groupBy("rid").agg(F.collect_list("x").alias("wanted"))
    )
    near, _ = split_by_keys(docs.select("rid", "text"), wanted.select("rid"), "rid")
    texts = written(near.dropDuplicates(["rid"]).join(wanted, "rid").select("text", "wanted").mapInArrow(_cut_out, "block int, anchor long, piece long, weight long, text binary"), "op1-texts")
    cold = texts.where("block >= 0").groupBy("block").applyInArrow(_expand(min_bytes), "anchor long, piece long, lo int, hi int")
    single = texts.where("block < 0").mapInArrow(_single_starts(min_bytes), "string long, anchor long, piece long, weight long, at int")
    strings = single.groupBy("string").agg(F.sum("weight").alias("n")).where("n > 1").select("string")
    hot = single.join(strings, "string").select("anchor", "piece", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    alone = distinct.where("weight > 1").join(anchors.select("anchor"), "anchor", "left_anti").select("anchor", "piece", F.lit(0).alias("lo"), (F.col("at.size") - min_bytes + 1).alias("hi"))
    parts = cold.union(hot).union(alone).groupBy("anchor", "piece").agg(F.collect_list(F.struct("lo", "hi")).alias("part"))
    runs = written(
        found.join(parts, ["anchor", "piece"])
        .groupBy("rid").agg(F.flatten(F.collect_set(F.expr("transform(part, x -> named_struct('lo', x.lo + start, 'hi', x.hi + start))"))).alias("runs")),
        "op1-runs",
    )
    hit, rest = split_by_keys(docs, runs.select("rid"), "rid")
    changed = hit.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_apply(min_bytes), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {_RUN}")
    zero = F.lit(0).cast("long")
    whole = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text"), 256).alias("kept_sha256"), F.array().cast(_RUN).alias("spans"))
    return changed.union(whole)
