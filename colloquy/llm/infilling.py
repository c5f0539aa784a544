"""Fill-in-the-middle texts, cut over an index of distinct texts.

1. Rows are dealt out by a 128-bit hash of the text, compressed. A text that more
   than a thousandth of all rows hold is dealt to several parts (at most a thousand
   texts are that frequent, so their list is broadcast).
2. Where they meet, rows of equal hash are told apart by content: each class of
   identical texts gets one entry of the index, the Elias-Fano list of the byte
   offsets of its code points. An entry is made once in each part that holds its text.
3. The rows of a class join its entry there, in the same task, and ``select`` finds the
   bytes of each row's two seeded cuts. So texts are shuffled once.

The cuts and the form of a row come from its id alone: ``seed:id`` hashed by SHA-256.
``plain`` texts stay; ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is
``<S>``suffix``<P>``prefix``<M>``middle. Texts that hold a marker are plain, so that
``restore`` gives the text back from output and form.

Edge cases: null texts are empty and plain; a null id hashes as the empty text; rows
that repeat are each returned; other columns are ignored; an empty table gives an empty
result; texts of any length are cut whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import utf8_buffers

SEED = 1
FIM_PERCENT, SPM_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text that more than 1 / FREQUENT of the rows hold is dealt to several parts.
FREQUENT = 1000
_BLOCK = 64  # bytes of upper bits for each entry of the rank directory
_OUT_BYTES = 8 << 20


class EliasFano:
    """A rising list of integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, (universe // n).bit_length() - 1) if n else 0
        place = (values >> self.low_bits) + np.arange(n)
        bits = np.zeros(-(-(int(place[-1]) + 1 if n else 1) // (8 * _BLOCK)) * 8 * _BLOCK, np.uint8)
        bits[place] = 1
        self.upper = np.packbits(bits, bitorder="little").reshape(-1, _BLOCK)
        counts = np.bitwise_count(self.upper).sum(axis=1, dtype=np.int64)
        self.before = np.cumsum(counts) - counts
        self.lower = np.packbits((values[:, None] >> np.arange(self.low_bits)).astype(np.uint8) & 1, bitorder="little")

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.upper[block], bitorder="little"))
        high, low = 8 * _BLOCK * block + int(ones[i - self.before[block]]) - i, 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.lower[at >> 3]) >> (at & 7) & 1) << k
        return high << self.low_bits | low


class Entry:
    """A distinct text: bytes, number of code points, and where these begin."""

    def __init__(self, text: bytes):
        self.text = text
        data = np.frombuffer(text, np.uint8)
        ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.n, self.bounds = len(ends) - 1, EliasFano(ends, len(data))
        self.marked = not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE))


def _shrunk(batches):
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw, off = utf8_buffers(batch.column("text"))
        view = memoryview(raw)
        z = pa.array([small.compress(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), z], names=[*names, "z"])


def _cuts(fim: int, spm: int):
    """Each row's form and cuts, by the entry of its class."""

    def run(batches):
        large, key, classes = zstandard.ZstdDecompressor(), None, {}
        out, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            for i, (k1, k2, z, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "z", "h")))):
                if (k1, k2) != key:
                    key, classes = (k1, k2), {}
                # equal frames hold equal texts: a class is found by comparing whole contents
                entry = classes.get(z)
                if entry is None:
                    entry = classes[z] = Entry(large.decompress(z))
                n, text = entry.n, entry.text
                if entry.marked or h[2] % 100 >= fim:
                    row = (n, "plain", None, None, text)
                else:
                    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    x, y = entry.bounds.select(a), entry.bounds.select(b)
                    parts = (PREFIX.encode(), text[:x]), (SUFFIX.encode(), text[y:]), (MIDDLE.encode(), text[x:y])
                    spm_form = h[3] % 100 < spm
                    row = (n, "spm" if spm_form else "psm", a, b - a, b"".join(s for k in ((1, 0, 2) if spm_form else (0, 1, 2)) for s in parts[k]))
                out.append((i, row))
                size += len(row[-1])
                if size > _OUT_BYTES:
                    yield made(ids, out)
                    out, size = [], 0
            if out:
                yield made(ids, out)
                out, size = [], 0

    def made(ids, out):
        cols = zip(*(row for _, row in out))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        n, form, a, m, output = (pa.array(c, kind) for c, kind in zip(cols, kinds))
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        return pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in out])), n, form, a, m, output.cast(pa.string())], names=names)

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars, output."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), hashes.alias("h"))
    n = docs.count()
    most = max(64, n // FREQUENT)
    frequent = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    parts = F.broadcast(frequent.select("k1", "k2", F.ceil(F.col("copies") / most).cast("int").alias("parts")))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("parts"))).otherwise(0).cast("int")
    id_type = dict(rows.dtypes)["doc_id"]
    dealt = rows.join(parts, ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", part.alias("part"), "h")
    dealt = dealt.mapInArrow(_shrunk, f"doc_id {id_type}, k1 long, k2 long, part int, h array<long>, z binary")
    dealt = dealt.repartition("k1", "k2", "part").sortWithinPartitions("k1", "k2", "part")
    return dealt.mapInArrow(_cuts(fim_percent, spm_percent), f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text of an output, by its markers."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    pick = lambda *order: F.concat(*[F.get(parts, F.lit(k)) for k in order])
    return F.when(form == "psm", pick(1, 3, 2)).when(form == "spm", pick(2, 3, 1)).otherwise(output)
