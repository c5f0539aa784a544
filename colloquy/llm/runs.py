"""Runs of words that repeat with a period, found by matching aligned blocks.

A run is a stretch of consecutive words with smallest period q and at least
``max(min_length, min_exponent * q)`` words that no neighbour extends with that period.
For each power of two s, the runs with s <= q < 2s are found so:

1. A text's words are cut into aligned blocks of s. A run holds one whole block whose
   copy at distance q is in it too, so every word of that block stands again less
   than 2s further on; other blocks can't start a run and are left out.
2. The blocks are the keys of an Aho-Corasick automaton over integer sequences, which
   reads the words that follow them. An occurrence s to 2s - 1 words after an equal
   block is a seed. Keys of blocks above ``KEY_WORDS`` hold so many words of it.
3. A seed's distance is extended word by word in both directions, exactly, and what is
   long enough is a run. A stretch that was found with a smaller period isn't one again;
   blocks whole inside a run of a smaller period need no look, as their seeds lie in it.

Words are told apart by content, not by hash. Texts are read in slices of about a
megabyte, and automata hold the blocks of one stretch of ``WINDOW`` words, or eight
blocks, at a time.

Edge cases: null texts and texts of separators only have no words, no runs and an empty
collapsed text; repeated rows are each returned; a null id is a value like any other; other
columns are ignored; an empty table gives an empty result; long texts are searched whole.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import IS_SPACE, slices, utf8_buffers, words

MIN_LENGTH, MIN_EXPONENT = 6, 4
KEY_WORDS = 1024
WINDOW = 1 << 16
_OUT_WORDS = 1 << 16
_FAR = np.iinfo(np.int64).max


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word of a slice: equal for equal words only."""
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    solid = np.ascontiguousarray(data[~IS_SPACE[data]])
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(solid)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _until_next(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words from each word to its next occurrence in its row."""
    order = np.lexsort((word, row))
    gap = np.full(len(word), _FAR)
    same = (word[order[1:]] == word[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _extend(x: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words d apart are equal: its start and end."""
    lo, hi, step = at, at, 64
    while hi + d < len(x):
        stop = min(hi + step, len(x) - d)
        off = np.flatnonzero(x[hi:stop] != x[hi + d : stop + d])
        if len(off):
            hi += int(off[0])
            break
        hi, step = stop, 2 * step
    step = 64
    while lo > 0:
        stop = max(lo - step, 0)
        off = np.flatnonzero(x[stop:lo] != x[stop + d : lo + d])
        if len(off):
            lo = stop + int(off[-1]) + 1
            break
        lo, step = stop, 2 * step
    return lo, hi + d


def _seeds(x: np.ndarray, blocks: np.ndarray, s: int):
    """(start of a block, distance) of occurrences s to 2s - 1 words after an equal block."""
    size, width = min(s, KEY_WORDS), max(WINDOW, 8 * s)
    edges = np.flatnonzero(np.diff(blocks // width)) + 1
    for some in np.split(blocks, edges):
        keys: dict[tuple[int, ...], int] = {}
        kind = {b: keys.setdefault(tuple(x[b : b + size].tolist()), len(keys)) for b in some.tolist()}
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in keys.items():
            found.add_word(key, k)
        found.make_automaton()
        # what may follow a block, as stretches that don't overlap
        gaps = np.flatnonzero(np.diff(some) > 2 * s)
        for lo, hi in zip((some[np.append(0, gaps + 1)] + s).tolist(), (some[np.append(gaps, len(some) - 1)] + 2 * s + size - 1).tolist()):
            for last, k in found.iter(tuple(x[lo:hi].tolist())):
                place = lo + last - size + 1
                block = (place - s) // s * s
                if kind.get(block) == k:
                    yield block, place - block


def find_in(x: np.ndarray, gap: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of one text's word numbers, by start and period."""
    n, s = len(x), 1
    found: dict[tuple[int, int], int] = {}
    while n >= max(min_length, min_exponent * s):
        starts = np.arange(0, n - 2 * s + 1, s)
        blocks = starts[np.maximum.reduceat(gap[: starts[-1] + s], starts) < 2 * s]
        if found and len(blocks):
            inside = np.array(sorted((a, a + length) for a, length in found))
            at = np.searchsorted(inside[:, 0], blocks, side="right") - 1
            reach = np.maximum.accumulate(inside[:, 1])[at]
            blocks = blocks[(at < 0) | (reach < np.minimum(blocks + 3 * s, n))]
        done: dict[int, int] = {}
        for b, d in _seeds(x, blocks, s) if len(blocks) else ():
            if b < done.get(d, 0):
                continue
            lo, hi = _extend(x, b, d)
            done[d] = hi - d
            if hi - lo >= max(min_length, min_exponent * d):
                found[lo, hi - lo] = min(d, found.get((lo, hi - lo), d))
        s *= 2
    return sorted((a, length, q) for (a, length), q in found.items())


def _repeated_tails(seed: np.ndarray, start: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which word stands at each place, where every tenth seed makes the end of its text repeat."""
    at = np.arange(len(start))
    g = seed // 10
    changed = (seed >= 0) & (seed % 10 == 0) & (count > 0)
    for r in np.flatnonzero(changed).tolist():
        n, a = int(count[r]), int(g[r] % count[r])
        p = 1 + (n - a) // (3 + int(g[r]) % 8)
        at[first[r] + a : first[r] + n] = first[r] + a + np.arange(n - a) % p
    return at


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    out = []
    for i in range(0, len(start), _OUT_WORDS):
        s, e = start[i : i + _OUT_WORDS], end[i : i + _OUT_WORDS]
        size = e - s + 1
        place = np.cumsum(size) - size
        take = np.arange(int(size.sum())) + np.repeat(s - place, size)
        part = data[np.minimum(take, len(data) - 1)]
        part[place + size - 1] = 0x20
        out.append(part.tobytes())
    return b"".join(out)[:-1]


def _collapse(min_length: int, min_exponent: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            seeds = batch.column("seed").fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                data, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, row = words(data, o)
                first = np.searchsorted(row, np.arange(j - i + 1))
                count = np.diff(first)
                at = _repeated_tails(seeds[i:j], start, row, first, count)
                word = _numbers(data, start, end)[at] if len(start) else np.zeros(0, np.int64)
                start, end = start[at], end[at]
                gap = _until_next(word, row)
                texts, all_runs = [], []
                for r in range(j - i):
                    a, b = int(first[r]), int(first[r + 1])
                    runs = find_in(word[a:b], gap[a:b], min_length, min_exponent)
                    s, e = start[a:b], end[a:b]
                    if runs:
                        edge = np.zeros(b - a + 1, np.int64)
                        for lo, length, q in runs:
                            edge[lo + q] += 1
                            edge[lo + length] -= 1
                        kept = np.cumsum(edge)[:-1] == 0
                        s, e = s[kept], e[kept]
                    texts.append(_joined(data, s, e))
                    all_runs.append(runs)
                flat = [x for runs in all_runs for x in runs]
                item = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in all_runs])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(bounds, item), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, tail_seed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period by start and period), collapsed.

    ``collapsed`` has the words that no run holds after its first period, joined by one
    space. With ``tail_seed``, an unsigned number of each row, texts of every tenth seed
    are searched with an end that repeats (planted cases for tests of recall).
    """
    if min_exponent < 3:
        raise ValueError("blocks find runs of three periods or more")
    seed = (F.lit(None) if tail_seed is None else tail_seed).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), seed.alias("seed"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_collapse(min_length, min_exponent), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, of equal ones the first, then the shortest period; null if there is none."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, x: F.when(better(best, x), x).otherwise(best))
