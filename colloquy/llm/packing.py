"""Harmonic packing of tokenized documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class j takes pieces of
``capacity // j`` tokens, j to a sequence. A document is cut greedily into the
largest class lengths that fit, so every piece has exactly its class's length
and a sequence of class j is filled by any j pieces of it; remainders below
``small`` tokens form a class for each length.

Workers (hash groups of documents) number their pieces of each class and fill
sequences of a fixed count on their own. What is left over, fewer than j pieces
of a class and worker, is numbered once more across workers; the fewer than j
pieces of a class left after that are packed by decreasing length. The two
pools hold at most ``workers`` times, and once, the sum of the class counts,
whatever the corpus.

Edge cases: a null or empty text has the end token only; repeated rows are
packed as often as they occur; a null id is kept; other columns are ignored; an
empty table gives an empty result. Long texts are cut over many sequences. Texts
that hold an added token of the tokenizer, ``<|endoftext|>``, get its id there, as
the tokenizer gives it; one that spells it is read in one piece.
"""

from __future__ import annotations

import functools
import os
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import slices, utf8_buffers
from ._tables import row_key, written

CAPACITY, SMALL, END_ID = 2048, 32, 1
_PIECE = "rid long, doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, class int"


_CACHE, _CACHED_CHARS = 1 << 18, 40

#: ASCII letters, digits and other visible characters, as the tokenizer's pattern tells them apart; 0: all other bytes.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
#: First bytes of characters that are white space by no definition.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xCC), *range(0xCE, 0xE1), *range(0xE4, 0xEE)]] = True


def chunk_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at starts of texts (given, all within raw), and where ids on both sides don't depend on each other.

    That is before a blank that a visible character follows, around a line feed between
    visible ASCII characters, and between ASCII letters, digits and other characters
    (Latin-1 letters before them included) but after an apostrophe, which may begin a contraction.
    """
    n = len(raw)
    raw = np.concatenate([raw, np.zeros(2, np.uint8)])
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw == 0xC3) + 1
    kind[latin] = (raw[latin] != 0x97) & (raw[latin] != 0xB7)
    at = np.zeros(n + 2, bool)
    at[1:] = (kind[:-1] != kind[1:]) & (kind[:-1] != 0) & (kind[1:] != 0) & (raw[:-1] != 0x27)
    feed = np.flatnonzero(raw == 0x0A)
    feed = feed[(feed > 0) & (kind[feed - 1] != 0)]
    at[feed] = True
    at[feed[kind[feed + 1] != 0] + 1] = True
    blank = np.flatnonzero(raw == 0x20)
    first, second = raw[blank + 1], raw[blank + 2]
    visible = _VISIBLE[first] | (first == 0xE1) & (second < 0x9A) | (first == 0xE3) & (second > 0x80)
    ends = np.zeros(n + 2, bool)
    ends[starts] = True
    at[blank[visible & ~ends[blank + 1]]] = True
    at |= ends
    return np.flatnonzero(at[:n])


class Ids:
    """Token ids of texts as little-endian bytes, by the tokenizer of a file.

    Texts are cut in chunks; the distinct ones of a slice that aren't remembered are
    encoded in one go. The number of short chunks that are remembered is bounded.
    Texts with an added token, such as ``<|endoftext|>``, are one chunk.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Tokens that begin with a blank.
        self.lead = np.array([(self.tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _spelled(self, raw: bytes) -> list[int]:
        """Where added tokens begin."""
        out = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append(at)
                at = raw.find(token, at + 1)
        return out

    def _chunks(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks. Those with a blank at their beginning only make one text, whose tokens with a blank begin them."""
        plain = [p for p in parts if p[0] == " " and p.count(" ") == 1]
        text = "".join(plain)
        out = {}
        if plain and not self._spelled(text.encode()):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = [*(np.flatnonzero(self.lead[ids]) * 4).tolist(), 4 * len(ids)]
            if len(at) == len(plain) + 1:
                raw = ids.tobytes()
                out = {p: raw[i:j] for p, i, j in zip(plain, at, at[1:])}
        rest = [p for p in parts if p not in out]
        return out | dict(zip(rest, self._encode(rest)))

    def of(self, texts: pa.Array | list[str]) -> list[memoryview]:
        raw, offsets = utf8_buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        at = chunk_starts(raw, offsets)
        for i in np.unique(np.searchsorted(offsets, self._spelled(raw.tobytes()), "right") - 1).tolist():
            at = at[(at <= offsets[i]) | (at >= offsets[i + 1])]
        bounds = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        chunks = pa.LargeStringArray.from_buffers(len(at), bounds, pa.py_buffer(raw)).dictionary_encode()
        parts, known = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        now = self._chunks([p for p in parts if p not in known])
        known.update(now)
        ids = pa.array(map(known.__getitem__, parts), pa.large_binary()).take(chunks.indices)
        for p in [p for p in now if len(p) > _CACHED_CHARS]:
            del known[p]
        if len(known) > _CACHE:  # the older half goes; what is frequent soon comes back
            for p in list(islice(known, len(known) - _CACHE // 2)):
                del known[p]
        tokens = memoryview(ids.buffers()[2] or b"")
        ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))[np.searchsorted(at, offsets)].tolist()
        return [tokens[i:j] for i, j in zip(ends, ends[1:])]


@functools.cache
def _ids(path: str | None) -> Ids:
    return Ids(path)


def class_lengths(capacity: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, pieces in a sequence) of every class, longest first."""
    lengths = sorted({capacity // j for j in range(1, capacity // small + 1)} | set(range(1, small)), reverse=True)
    return np.array(lengths), np.array([capacity // x for x in lengths])


def cut(n: int, lengths: np.ndarray) -> list[int]:
    """Piece lengths, all of them class lengths, that make up n tokens."""
    out = [int(lengths[0])] * (n // int(lengths[0]))
    n -= sum(out)
    while n:
        out.append(int(lengths[np.searchsorted(-lengths, -n)]))
        n -= out[-1]
    return out


def _pieces(path: str | None, capacity: int, small: int):
    def run(batches):
        ids_of = _ids(path)
        encode = ids_of.of
        lengths, _ = class_lengths(capacity, small)
        cuts = functools.cache(lambda n: cut(n, lengths))
        end = END_ID.to_bytes(4, "little")
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(utf8_buffers(b.column("text"))[1])):
            rid, ids = batch.column("rid"), batch.column("doc_id")
            rows: list[tuple] = []
            for i, raw in enumerate(encode(batch.column("text"))):
                tokens = memoryview(b"".join((raw, end)))
                n, at = len(tokens) // 4, 0
                for size in [capacity] * (n // capacity) + cuts(n % capacity):
                    rows.append((i, at, size, zlib.crc32(tokens[4 * at : 4 * (at + size)]), n))
                    at += size
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            take = pa.array(cols[0])
            kind = (len(lengths) - 1 - np.searchsorted(lengths[::-1], cols[2])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rid.take(take), ids.take(take), *map(pa.array, cols[1:]), pa.array(kind)], names=["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])
        ids_of.known.clear()  # the worker process goes on to other tasks
        pa.default_memory_pool().release_unused()

    return run


def _decreasing(capacity: int):
    """First fit by decreasing length over the bounded rest."""

    def run(left: pa.Table) -> pa.Table:
        left = left.sort_by([("length", "descending"), ("rid", "ascending"), ("start", "ascending")])
        free = np.zeros(0, np.int64)
        place = []
        for n in left.column("length").to_pylist():
            fits = np.flatnonzero(free >= n)
            if not len(fits):
                free, fits = np.append(free, capacity), [len(free)]
            free[fits[0]] -= n
            place.append(int(fits[0]))
        return left.set_column(left.schema.get_field_index("bin"), "bin", pa.array(place, pa.int64()))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, small: int = SMALL, workers: int | None = None, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    workers = workers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = _PIECE.format(dict(docs.dtypes)["doc_id"])
    pieces = written(docs.mapInArrow(_pieces(tokenizer_path, capacity, small), schema), "op8-pieces")
    _, counts = class_lengths(capacity, small)
    per = F.element_at(F.array(*[F.lit(int(c)) for c in counts]), F.col("class") + 1)

    def numbered(df: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
        """(pieces of full sequences with their bin, pieces left over)."""
        group = Window.partitionBy(*by)
        df = df.withColumn("_n", F.row_number().over(group.orderBy("rid", "start")) - 1).withColumn("_all", F.count("*").over(group))
        full = F.col("_n") < F.col("_all") - F.col("_all") % per
        return df.where(full).withColumn("bin", F.floor(F.col("_n") / per)).drop("_n", "_all"), df.where(~full).drop("_n", "_all")

    # full-length pieces are sequences of their own and need no numbering beyond their row
    worker = F.pmod(F.xxhash64("rid"), F.lit(workers)).cast("int")
    own, pool = numbered(pieces.withColumn("worker", worker), "worker", "class")
    pool = written(pool, "op8-pool")
    across, rest = numbered(pool.withColumn("worker", F.lit(workers)), "class")
    last = rest.withColumn("worker", F.lit(workers + 1)).withColumn("class", F.lit(0)).withColumn("bin", F.lit(0).cast("long"))
    last = last.groupBy("worker").applyInArrow(_decreasing(capacity), last.schema)
    placed = own.unionByName(across).unionByName(last)
    sequence = F.shiftleft(F.col("worker").cast("long"), 40) + F.shiftleft(F.col("class").cast("long"), 32) + F.col("bin")
    before = Window.partitionBy("sequence_id").orderBy("rid", "start").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("sequence_id", sequence)
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )
