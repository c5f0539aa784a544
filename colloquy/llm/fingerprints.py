"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed level by level. Runs of one name collapse into one
symbol; deterministic coin tossing labels each symbol with the lowest bit in which
it differs from its left neighbour, until at most six labels are left, and three
after recolouring; local maxima begin phrases of two to four symbols or so. A
phrase's name is a hash of its content, and the names are the next level's
symbols, until one is left. Borders depend on a few neighbours only, so equal
substrings share the names of their interior phrases wherever they stand.

The names of all levels form a set in which each counts by the bytes of its phrase,
so that every level has about the same share of a text, long or short. It is
sketched by ``BINS`` minima of eight bits, in hex: the fingerprint. A name's rank
is exponential with its weight as rate, as in weighted sampling. The likeness
of two is Dice's coefficient from their estimated Jaccard similarity.

:func:`fingerprint_neighbours` also fingerprints each text with its second half
replaced by the beginning of the next document's, by descending id (nulls
last; equal ids by the hash of their rows). Documents are dealt out by ranges of ids
and ordered within them, and the first of each range is sent to the range before it.
Ids that many rows share, null among them, are ranges of their own, in as many
parts by the rows' hashes as their number asks for.

Edge cases: a null text is empty; an empty text has an empty sketch, whose
likeness is 1 to another empty one and 0 to others; repeated rows follow one
another; a table of one row follows itself; an empty table gives an empty result;
other columns are ignored; long texts are parsed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BYTE_CODE, mix64, slices, utf8_buffers
from ._tables import row_key

BINS = 128
_STEP = np.uint64(0xC6BC279692B5C323)
_RANGES = 4  # id ranges for each shuffle partition

#: Recolouring of label c by the labels before and after it: the smallest of 0, 1, 2 not used.
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(7)] for a in range(7)], np.uint8)


#: Place of the lowest set bit of a byte.
_LOW = np.array([7 if b == 0 else (b & -b).bit_length() - 1 for b in range(256)], np.uint8)


def _toss(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit's place, plus that bit, against the left neighbour."""
    apart = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=apart[1:])
    apart[fresh] = ~x.dtype.type(0)  # the first of a text differs in every bit
    if x.dtype == np.uint8:
        place = _LOW[apart]
        bit = (x >> place) & np.uint8(1)
    else:
        place = np.minimum(np.bitwise_count(~apart & (apart - x.dtype.type(1))), np.uint8(8 * x.dtype.itemsize - 1))
        bit = ((x >> place) & x.dtype.type(1)).astype(np.uint8)
    return (place << np.uint8(1)) | bit


def phrase_starts(names: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which symbols begin a phrase; neighbours within a text differ, ``fresh`` are first in one."""
    label = _toss(names, fresh)
    for _ in range(2 if names.dtype == np.uint8 else 3):
        label = _toss(label, fresh)
    first = np.zeros(len(label) + 1, bool)
    first[fresh] = True
    first[-1] = True
    for colour in (3, 4, 5):
        at = np.flatnonzero(label == colour)
        left = np.where(first[at], 6, label[at - 1])
        right = np.where(first[at + 1], 6, label[np.minimum(at + 1, len(label) - 1)])
        label[at] = _FREE[left, right]
    padded = np.zeros(len(label) + 2, np.int8)
    padded[1:-1] = label
    start = first[:-1].copy()
    start[1:] |= (padded[2:-1] > padded[1:-2]) & (padded[2:-1] > padded[3:]) & ~first[1:-1] & ~first[2:]
    start[1:] &= ~start[:-1] | first[1:-1]  # a phrase of one symbol only where a text has one
    return start


def phrase_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, row, bytes) of all phrases of all levels."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    name, level, size = BYTE_CODE[data], 0, None
    out = []
    while len(name):
        fresh = np.ones(len(row), bool)
        fresh[1:] = row[1:] != row[:-1]
        with np.errstate(over="ignore"):
            # runs first, so that neighbours differ
            new = fresh.copy()
            new[1:] |= name[1:] != name[:-1]
            symbol = data if level == 0 else (name >> np.uint64(32)).astype(np.uint32)
            if size is None:
                size = np.ones(len(name), np.int32)
            if not new.all():
                head = np.flatnonzero(new)
                length = np.diff(head, append=len(name)).astype(np.uint64)
                size = np.add.reduceat(size, head)
                name, row, fresh, symbol = name[head], row[head], fresh[head], symbol[head]
                many = np.flatnonzero(length > 1)
                name[many] = mix64(name[many] + length[many] * _STEP)
            start = np.flatnonzero(phrase_starts(symbol, np.flatnonzero(fresh)))
            inside = np.arange(len(name)) - np.repeat(start, np.diff(start, append=len(name)))
            power = np.cumprod(np.full(int(inside.max()) + 1, _STEP, np.uint64))
            name = mix64(np.add.reduceat(name * power[inside], start) + np.uint64(level + 1))
        row, size = row[start], np.add.reduceat(size, start)
        level += 1
        out.append((name, row, size))
        alone = np.ones(len(row), bool)
        alone[1:] &= row[1:] != row[:-1]
        alone[:-1] &= row[1:] != row[:-1]
        name, row, size = name[~alone], row[~alone], size[~alone]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BINS) bytes, 0 for an empty bin."""
    rows = len(offsets) - 1
    out = np.zeros(rows * BINS, np.uint8)
    name, row, size = phrase_names(data, offsets)
    if len(name):
        h = mix64(name ^ _STEP)
        cell = row.astype(np.uint64) * np.uint64(BINS) + (h & np.uint64(BINS - 1))
        # positive floats are in the order of their bits
        rank = -np.log(((h >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0) / size
        both = np.sort((cell << np.uint64(32)) | rank.astype(np.float32).view(np.uint32))
        cell = (both >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        with np.errstate(over="ignore"):
            out[cell[first]] = (mix64(both[first] & np.uint64(0xFFFFFFFF)) % np.uint64(255)).astype(np.uint8) + 1
    return out.reshape(rows, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Dice coefficient of the name sets of two sketches a row."""
    some = ((a > 0) | (b > 0)).sum(axis=1)
    share = np.where(some > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(some, 1), 1.0)
    share = np.clip((share - 1 / 255) / (1 - 1 / 255), 0, 1)
    return 2 * share / (1 + share)


def _shrunk(batches):
    """Rows with their texts compressed, as they are shuffled."""
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw, off = utf8_buffers(batch.column("text"))
        view = memoryview(raw)
        z = pa.array([small.compress(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "range", "mark")), z], names=["doc_id", "rid", "range", "mark", "z"])


def _pairs(batches):
    """Results of each row but the marked ones; the following row is its next document."""
    last, large = None, zstandard.ZstdDecompressor()
    for batch in batches:
        texts = pa.array([large.decompress(z) for z in batch.column("z").to_pylist()], pa.large_binary())
        batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.large_string()), batch.column("mark")], names=["doc_id", "text", "mark"])
        table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
        if table.num_rows > 1:
            yield from _compare(table.to_batches()[0])
        last = table.slice(table.num_rows - 1).to_batches()[0]


def _compare(batch: pa.RecordBatch):
    raw, off = utf8_buffers(batch.column("text"))
    for i, j in slices(off[:-1]):
        j1 = j + 1  # with the next document of the last
        data, o = raw[off[i] : off[j1]], off[i : j1 + 1] - off[i]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.searchsorted(lead, o)
        n = np.diff(chars)
        place = np.append(lead, len(data))
        half = n[:-1] // 2
        kept = place[chars[:-2] + n[:-1] - half]
        taken = place[chars[1:-1] + np.minimum(half, n[1:])]
        # where nothing is cut the end is the text's own
        kept = np.where(half > 0, kept, o[1:-1])
        parts = [x for a, b, c, d in zip(o[:-2].tolist(), kept.tolist(), o[1:-1].tolist(), taken.tolist()) for x in (data[a:b], data[c:d])]
        edited = np.concatenate(parts) if parts else data[:0]
        e = np.concatenate([[0], np.cumsum((kept - o[:-2]) + (taken - o[1:-1]))])
        own, changed = sketches(data, o), sketches(edited, e)
        view = memoryview(edited)
        out = pa.RecordBatch.from_arrays(
            [batch.column("doc_id")[i:j], pa.array(n[:-1].astype(np.int64)), pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(e[:-1].tolist(), e[1:].tolist())], pa.string()),
             pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()), pa.array([x.tobytes().hex() for x in changed], pa.string()), pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        yield out.filter(pa.array(~batch.column("mark")[i:j].to_numpy(zero_copy_only=False)))


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    spark = docs.sparkSession
    ranges = _RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("rid"))
    n, *bounds = docs.agg(F.count("*"), F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()
    # an id with more than a range's share of the rows; fewer than there are ranges
    crowded = docs.groupBy("doc_id").count().where(F.col("count") > max(1, n // ranges)).collect()
    parts = {r["doc_id"]: -(-r["count"] * ranges // n) for r in crowded}
    # ranges count down from the largest ids; null ids come last
    edges = sorted(set(bounds[0] or []) | {x for x in parts if x is not None}, reverse=True)
    place = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x > F.col("doc_id"))) if edges else F.lit(0)
    place = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(place)
    width = F.lit(0)
    for x, m in parts.items():
        width = F.when(F.col("doc_id").eqNullSafe(F.lit(x).cast(dict(docs.dtypes)["doc_id"])), m).otherwise(width)
    part = F.least(F.floor((F.col("rid") / 2.0**64 + 0.5) * F.col("_parts")), F.col("_parts") - 1)
    # larger ids than a crowded one that share its place come before its parts
    dealt = docs.withColumn("_parts", width).withColumn("range", (place * (ranges + 2) + F.when(F.col("_parts") > 0, 1 + part).otherwise(0)).cast("int")).drop("_parts")
    heads = dealt.groupBy("range").agg(F.max_by("rid", F.struct("doc_id", F.bitwise_not("rid").alias("r"))).alias("at"))
    first = sorted(map(tuple, heads.collect()))  # one row a range
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not first:
        return spark.createDataFrame([], schema)
    before = {rid: first[k - 1][0] for k, (_, rid) in enumerate(first)}
    sent = spark.createDataFrame(list(before.items()), "rid long, range int")
    marks = docs.join(F.broadcast(sent), "rid").dropDuplicates(["rid"]).select("doc_id", "text", "rid", "range", F.lit(True).alias("mark"))
    rows = dealt.select("doc_id", "text", "rid", "range", F.lit(False).alias("mark")).union(marks)
    rows = rows.mapInArrow(_shrunk, f"doc_id {dict(docs.dtypes)['doc_id']}, rid long, range int, mark boolean, z binary")
    rows = rows.repartition("range").sortWithinPartitions("range", "mark", F.desc_nulls_last("doc_id"), "rid")
    return rows.select("doc_id", "mark", "z").mapInArrow(_pairs, schema)
