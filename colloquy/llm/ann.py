"""Nearest vectors by cosine: multiprobe p-stable hashing with exact reranking.

Vectors, scaled to unit length for hashing, get in each of ``TABLES`` tables a
bucket of ``functions`` values ``floor(a.x / WIDTH)`` with normal ``a``, orthogonal to
each other within a table as far as the dimension goes. There is no random offset:
projections of unit vectors lie around 0, where a border parts them best. A
query visits its own bucket and those of the ``PROBES`` perturbation sets (values
moved by -1 or +1) with the smallest sums of squared distances to the crossed
borders, the order of estimated success. Every row is indexed. What a visited
bucket holds is scored exactly, in double precision on the original
vectors; the best of all tables are merged.

The number of functions follows the number of rows n: a query is to visit a share of
``sqrt(FULL / n)`` of them, all up to ``FULL`` rows. So the work for a query grows with
the root of n.

Buckets above ``SPLIT`` rows are dealt out over salted parts, which a query visits
all. Groups of parts are joined with their visitors; a group holds about
``GROUP_ROWS`` index rows.

Vectors take no part if they are null, empty, zero, hold null or non-finite
components, have a null id, or another length than most. Rows with the query's
id are no candidates of it. Repeated ids count once per result, with their best
score; ties go to the smaller id. An empty table gives an empty result; columns
besides id and vector are ignored.
"""

from __future__ import annotations

import heapq
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import random_u64
from ._tables import written

TABLES, WIDTH, PROBES, FULL = 24, 4.0, 600, 400
SPLIT, GROUP_ROWS, PAIRS = 4096, 20_000, 100_000


def perturbations(functions: int, n: int) -> list[tuple[int, ...]]:
    """Sets of ranks among the 2k sorted border distances, by expected score.

    The rank j and its opposite 2k - 1 - j move one value both ways and exclude
    each other. The expectations are those of sorted uniform distances.
    """
    k = functions
    e = [(j * (j + 1)) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + ((2 * k + 1 - j) * (2 * k + 2 - j)) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    heap, out = [(e[0], (0,))] if k else [], []
    while heap and len(out) < n:
        score, ranks = heapq.heappop(heap)
        if all(2 * k - 1 - j not in ranks for j in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - e[last] + e[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + e[last + 1], (*ranks, last + 1)))
    return out


class Hashes:
    """The hash functions of all tables for one dimension."""

    def __init__(self, dimension: int, tables: int, functions: int, width: float):
        rng = np.random.default_rng(3)
        self.tables, self.functions = tables, functions
        a = rng.standard_normal((tables, dimension, functions))
        for lo in range(0, functions, dimension):
            part = a[:, :, lo : lo + dimension]
            size = np.linalg.norm(part, axis=1, keepdims=True)
            a[:, :, lo : lo + dimension] = np.linalg.qr(part)[0] * size
        self.a = a.transpose(1, 0, 2).reshape(dimension, tables * functions) / width
        self.multiply = (random_u64(tables * max(functions, 1), 29) | np.uint64(1)).reshape(tables, -1)[:, :functions]

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, functions) positions on the lines, in bucket widths."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (x @ self.a).reshape(len(x), self.tables, self.functions)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Bucket keys of integer cells (..., tables, functions); tables never share one."""
        return self.finished(self.mixed(cells))

    def mixed(self, cells: np.ndarray) -> np.ndarray:
        """Sums of cells times odd numbers, modulo 2^64: a moved cell adds or takes its number."""
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64).view(np.uint64) * self.multiply).sum(axis=-1, dtype=np.uint64)

    def finished(self, mixed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((mixed + np.arange(self.tables, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed >> np.uint64(29))


def functions_for(n: int, tables: int = TABLES, probes: int = PROBES, full: int = FULL) -> int:
    """Functions with which a query's probes visit about ``sqrt(full / n)`` of n rows; a function parts them in two."""
    if n <= full:
        return 0
    share = 1 - (1 - (full / n) ** 0.5) ** (1 / tables)
    return round(log2(probes / share))


def _vectors(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _index(hashes: Hashes):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                x = _vectors(part.column("embedding"))
                key = hashes.keys(np.floor(hashes.places(x))).view(np.int64)
                at = pa.array(np.repeat(np.arange(len(x)), hashes.tables))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column("vec_id").take(at), part.column("embedding").take(at)], names=["key", "vec_id", "embedding"])

    return run


def _probes(hashes: Hashes, probes: int):
    k = hashes.functions
    sets = perturbations(k, 3 * probes)
    member = np.zeros((len(sets), 2 * k))
    padded = np.full((len(sets), max(map(len, sets), default=1)), 2 * k)  # the last place adds nothing
    for i, ranks in enumerate(sets):
        member[i, list(ranks)] = 1
        padded[i, : len(ranks)] = ranks
    with np.errstate(over="ignore"):
        moves = np.concatenate([np.uint64(0) - hashes.multiply, hashes.multiply], axis=1)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for i in range(batch.num_rows):
                place = hashes.places(_vectors(batch.column("embedding").slice(i, 1)))[0]
                cell = np.floor(place)
                own = hashes.mixed(cell)
                keys = [hashes.finished(own)]
                if k:
                    distance = np.concatenate([place - cell, 1 - (place - cell)], axis=1)
                    rank = np.argsort(distance, axis=1)
                    score = np.take_along_axis(distance, rank, axis=1) ** 2 @ member.T
                    best = np.argpartition(score, probes - 1, axis=1)[:, :probes] if score.shape[1] > probes else np.argsort(score, axis=1)
                    step = np.concatenate([np.take_along_axis(moves, rank, axis=1), np.zeros((hashes.tables, 1), np.uint64)], axis=1)
                    with np.errstate(over="ignore"):
                        moved = own[:, None] + np.take_along_axis(step[:, None, :], padded[best], axis=2).sum(axis=2, dtype=np.uint64)
                    keys.append(hashes.finished(moved.T).ravel())
                key = np.unique(np.concatenate(keys)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(np.full(len(key), i)))], names=["key", "query_id"])

    return run


def _search(k: int):
    def run(index: pa.Table, visits: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if index.num_rows and visits.num_rows:
            part, ids = index.column("part").to_numpy(), index.column("vec_id").to_numpy()
            x = _vectors(index.column("embedding").combine_chunks())
            norm = np.linalg.norm(x, axis=1)
            order = np.argsort(part, kind="stable")
            keys, first = np.unique(part[order], return_index=True)
            first = np.append(first, len(part))
            q = _vectors(visits.column("embedding").combine_chunks())
            q_norm, q_id = np.linalg.norm(q, axis=1), visits.column("query_id").to_numpy()
            lists = visits.column("parts").combine_chunks()
            wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            at, who = at[hit], who[hit]
            size = first[at + 1] - first[at]
            upto = np.cumsum(size)
            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            least = np.full(len(q), -np.inf)  # what a row must reach to be among the k of a query
            lo = 0
            while lo < len(at):
                # the visits of about PAIRS pairs, expanded to (query, row)
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
                n = size[lo:hi]
                u = np.repeat(who[lo:hi], n)
                v = order[np.repeat(first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(len(u))]
                near = np.einsum("ij,ij->i", q[u], x[v]) / (q_norm[u] * norm[v])
                # equal scores may differ in the last digits here: they all go on to the exact sums
                fine = (near >= least[u] - 1e-9) & (q_id[u] != ids[v])
                u, v = u[fine], v[fine]
                exact = (q[u] * x[v]).sum(axis=1) / (q_norm[u] * norm[v])
                kept = tuple(np.concatenate(y) for y in zip(kept, (u, ids[v], exact)))
                best = _first(*kept, k)
                kept = tuple(y[best] for y in kept)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(q)) >= k)
                worst = np.full(len(q), np.inf)
                np.minimum.at(worst, kept[0], kept[2])
                least[full] = worst[full]
                lo = hi
            out = {"query_id": q_id[kept[0]], "vec_id": kept[1], "score": kept[2]}
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def _first(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k best rows of each query, without repeated ids."""
    # an id has one score here unless rows repeat it; the better one comes first
    order = np.lexsort((-score, ids, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[new]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    new = np.ones(len(order), bool)
    new[1:] = query[order][1:] != query[order][:-1]
    rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[rank < k]


def usable(vector: Column) -> Column:
    """Whether a vector can take part: finite, not null and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, functions: int | None = None, width: float = WIDTH, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per query and rank: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    fine = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    sizes = fine.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension, n = (sizes["d"], sizes["count"]) if sizes else (1, 0)
    fine = fine.where(F.size(vector_col) == dimension)
    rows = fine.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    queries = fine.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    functions = functions_for(n, tables, probes) if functions is None else functions
    hashes = Hashes(dimension, tables if functions else 1, functions, width)
    groups = max(1, -(-n * hashes.tables // GROUP_ROWS))
    kind = dict(rows.dtypes)["embedding"]

    index = written(rows.mapInArrow(_index(hashes), f"key long, vec_id long, embedding {kind}"), "op3-index")
    large = index.groupBy("key").count().where(F.col("count") > SPLIT).select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("n"))
    part = lambda salt: F.xxhash64("key", salt.cast("int"))
    group = lambda p: F.pmod(F.xxhash64(p), F.lit(groups)).cast("int").alias("group")
    placed = index.join(large, "key", "left").select(part(F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n")))).alias("part"), "vec_id", "embedding")
    placed = placed.withColumn("group", group("part"))
    visits = queries.mapInArrow(_probes(hashes, probes), "key long, query_id long").join(large, "key", "left")
    visits = visits.select("query_id", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("salt"), "key").select("query_id", part(F.col("salt")).alias("part"))
    visits = visits.groupBy("query_id", group("part")).agg(F.collect_set("part").alias("parts"))
    visits = visits.join(queries.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("group", "query_id", "parts", "embedding")
    found = placed.groupBy("group").cogroup(visits.groupBy("group")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
