"""Near-duplicate groups of texts by MinHash with exact confirmation.

A text's set holds its distinct runs of ``n_words`` lower-cased words; shorter
texts have their whole word sequence as the one member, and texts without words
have an empty set and no links. Sets link at a Jaccard similarity of
``threshold`` per cent or more.

1. Equal sets collapse to one node, keyed by a hash of the set.
2. ``bands * rows`` universal hash minima give each node its band keys and a
   signature of one byte per minimum. With 32 bands of 4 rows a pair at 0.75
   shares no band with probability 5e-6.
3. Every node is paired with one other, the smallest node of most of its band
   buckets. Pairs pass by signature, then by the full sets; components of what
   passed follow.
4. Buckets that still hold several components are searched inside their task, by
   signature, for pairs of different components. Not the pairs come out, but their
   nodes, under the pair of *blocks* that they belong to; a block is a bounded part
   of the nodes with one smallest node. Each pair of blocks then gets the full sets
   of its nodes once, whatever the number of pairs, and links those that reach
   the threshold and aren't connected yet. So every pair of a bucket is either
   connected or compared, and no more links come out of a task than join components.
5. Components of all confirmed links by alternating large-star and small-star.

In a large bucket the nodes outside its largest component are searched in parts of
``BLOCK`` against all its nodes, so rows grow with the bucket and not with its square
where one component holds most of it. The partners
of a frequent centre are dealt out over salted groups.

Edge cases: null and empty texts and texts of separators only have n_shingles 0
and stand alone; repeated rows share a group; a null id never is a group's
smallest unless all are null; other columns are ignored; an empty table gives an
empty result. Texts of any length are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, PrefixHasher, mix64, random_u64, slices, utf8_buffers, words
from ._components import connected_components
from ._tables import KEY, Tables, quoted, row_keys, split_by_keys, written

N_WORDS = 5
THRESHOLD = 75
BANDS, ROWS = 32, 4
BLOCK = 2000
BLOCK_SHINGLES = 500_000
_CENTRE = 500  # partners of a centre in one salted group
_MIX = np.uint64(0x9DDFEA08EB382D69)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice, flat, and their offsets."""
    n_rows = len(offsets) - 1
    data = LOWER[data]
    start, end, row = words(data, offsets)
    word = PrefixHasher(data).of(start, end)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        n = len(word)
        full = max(0, n - n_words + 1)
        h = np.zeros(full, np.uint64)
        for k in range(n_words):
            h = h * _MIX + word[k : k + full]
        h = mix64(h + np.uint64(n_words))
        inside = np.arange(full) + n_words <= first[1:][row[:full]] if full else np.zeros(0, bool)
        h, owner = h[inside], row[:full][inside]
        for i in np.flatnonzero((count > 0) & (count < n_words)):
            x = np.uint64(0)
            for w in word[first[i] : first[i + 1]]:
                x = x * _MIX + w
            h = np.append(h, mix64(np.array([x + np.uint64(count[i])], np.uint64)))
            owner = np.append(owner, i)
    if len(owner) and (np.diff(owner) < 0).any():
        o = np.argsort(owner, kind="stable")
        h, owner = h[o], owner[o]
    bound = np.searchsorted(owner, np.arange(n_rows + 1))
    for i in range(n_rows):
        h[bound[i] : bound[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(n_rows + 1))


def signatures(sets: np.ndarray, bound: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, signature bytes) of each row; rows must not be empty."""
    a, b = random_u64(bands * rows, 11) | np.uint64(1), random_u64(bands * rows, 13)
    n = len(bound) - 1
    keys, sig = np.empty((n, bands), np.uint64), np.empty((n, bands * rows), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(bands):
            key = np.full(n, k, np.uint64)
            for r in range(rows):
                i = k * rows + r
                least = mix64(np.minimum.reduceat(sets * a[i] + b[i], bound[:-1]))
                sig[:, i] = (least & np.uint64(0xFF)).astype(np.uint8)
                key = mix64(key * _MIX + least)
            keys[:, k] = key
    return keys, sig


def _profile(n_words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            for i, j in slices(off):
                sets, bound = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n_words)
                size = np.diff(bound)
                some = np.flatnonzero(size)
                keys, sig = np.zeros((j - i, bands), np.uint64), np.zeros((j - i, bands * rows), np.uint8)
                if len(some):
                    keys[some], sig[some] = signatures(sets, np.append(bound[:-1][some], bound[-1]), bands, rows)
                view = memoryview(sets.view(np.uint8)) if len(sets) else b""
                node = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * s : 8 * e]) for s, e in zip(bound[:-1].tolist(), bound[1:].tolist())), np.uint64, j - i)
                flat = pa.array(keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], batch.column("rid")[i:j], batch.column("rid2")[i:j], pa.array(size.astype(np.int64)), pa.array(node.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "rid", "rid2", "n_shingles", "node", "bands", "sig"],
                )

    return run


def _matrix(col: pa.Array) -> np.ndarray:
    raw, off = utf8_buffers(col)
    return raw[off[0] : off[-1]].reshape(len(col), -1)


def _by_signature(least: float):
    def run(batches):
        for batch in batches:
            ok = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).mean(axis=1) >= least
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return run


def _by_key(batches, name: str):
    """A table for each run of equal values of a sorted column."""
    held, last = [], None
    for batch in batches:
        key = batch.column(name).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
        for lo, hi in zip(edge, edge[1:]):
            if held and key[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key[lo]
    if held:
        yield pa.Table.from_batches(held)


def _ints(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _search_buckets(least: float):
    """(pair of blocks, node) of all pairs of different components in a bucket that pass by signature."""

    def found(table: pa.Table):
        i, j, node, root, block = _ints(table, "i", "j", "node", "root", "block")
        sig = _matrix(table.column("sig").combine_chunks())
        left, right = np.flatnonzero(i <= j), np.flatnonzero(i >= j)
        one = len(left) == len(right) == len(node)
        for x in left:
            y = right[x + 1 :] if one else right
            y = y[root[y] != root[x]]
            y = y[(sig[y] == sig[x]).mean(axis=1, dtype=np.float32) >= least] if len(y) else y
            if len(y):
                low, high = np.minimum(block[x], block[y]).view(np.uint64), np.maximum(block[x], block[y]).view(np.uint64)
                with np.errstate(over="ignore"):
                    pair = mix64(low * _MIX + mix64(high)).view(np.int64)
                yield from zip(pair.tolist(), node[y].tolist())
                yield from zip(np.unique(pair).tolist(), [int(node[x])] * len(y))

    def run(batches):
        held: set[tuple[int, int]] = set()
        for table in _by_key(batches, "bucket"):
            held.update(found(table))
            if len(held) > 100_000:
                yield out(held)
                held = set()
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], pa.int64()) for c in (0, 1)], names=["pair", "node"])

    return run


def _link_blocks(least: float, threshold: int):
    """Links between components of a pair of blocks: signatures, then full sets; a linked pair becomes one component."""

    def links(table: pa.Table):
        node, root, block = _ints(table, "node", "root", "block")
        raw, off = utf8_buffers(table.column("shingles"))
        sets, bound = raw[off[0] : off[-1]].copy().view(np.uint64), (off - off[0]) // 8
        size, sig = np.diff(bound), _matrix(table.column("sig").combine_chunks())
        comp = np.unique(root, return_inverse=True)[1]
        one = block.min() == block.max()
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        for x in left:
            y = right[comp[right] != comp[x]]
            y = y[y > x] if one else y
            y = y[(100 * np.minimum(size[y], size[x]) >= threshold * np.maximum(size[y], size[x]))]
            if not len(y):
                continue
            like = (sig[y] == sig[x]).mean(axis=1, dtype=np.float32)
            y = y[np.argsort(-like, kind="stable")[: int((like >= least).sum())]]
            own, step = sets[bound[x] : bound[x + 1]], 16
            while len(y):
                now, y, step = y[:step], y[step:], min(2 * step, 256)
                flat = np.concatenate([sets[bound[k] : bound[k + 1]] for k in now])
                same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(same.astype(np.int64), np.cumsum(size[now]) - size[now])
                for k in now[100 * both >= threshold * (len(own) + size[now] - both)]:
                    if comp[k] != comp[x]:
                        comp[comp == comp[k]] = comp[x]
                        yield int(node[x]), int(node[k])
                y = y[comp[y] != comp[x]]

    def run(batches):
        for table in _by_key(batches, "pair"):
            if got := list(links(table)):
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _sets(n_words: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            for i, j in slices(off):
                sets, bound = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n_words)
                view = memoryview(sets.view(np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column("node")[i:j], pa.array([bytes(view[8 * s : 8 * e]) for s, e in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary())], names=["node", "shingles"])

    return run


def _confirm(n_words: int, threshold: int):
    """Compare each run's centre, which comes first, with its partners."""

    def run(batches):
        group, centre = None, None
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            groups, salts, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "b"))
            partner = batch.column("partner").to_numpy(zero_copy_only=False)
            out = []
            for i, j in slices(off):
                sets, bound = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n_words)
                for k in range(i, j):
                    own = sets[bound[k - i] : bound[k - i + 1]]
                    if not partner[k]:
                        group, centre = (groups[k], salts[k]), own.copy()
                        continue
                    assert group == (groups[k], salts[k])
                    at = np.searchsorted(centre, own)
                    both = int((centre[np.minimum(at, len(centre) - 1)] == own).sum())
                    if 100 * both >= threshold * (len(centre) + len(own) - both):
                        out.append((groups[k], node[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; ``texts`` has node and text."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / _CENTRE).cast("int").alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.col("n")).cast("int")
    partners = pairs.join(counts, "a").select("a", salt.alias("salt"), F.col("b").alias("node")).join(texts, "node").select("a", "salt", F.col("node").alias("b"), F.lit(True).alias("partner"), "text")
    salts = pairs.join(counts, "a").select(F.col("a").alias("node"), salt.alias("salt")).distinct()
    centres = salts.join(texts, "node").select(F.col("node").alias("a"), "salt", F.col("node").alias("b"), F.lit(False).alias("partner"), "text")
    return partners.union(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "partner").mapInArrow(_confirm(n_words, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = N_WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, rid, rid2, node, root.

    ``component_id`` is the smallest id of the document's group, ``kept`` whether
    it is the document's own. ``rid`` and ``rid2`` are the row's key by id and text, ``root`` the
    group's key (null for empty sets).
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row_keys(id_col, text_col))
    tables = Tables(docs.sparkSession, "op5")
    id_type = dict(docs.dtypes)["doc_id"]
    profile = tables.write(docs.mapInArrow(_profile(n_words, bands, rows), f"doc_id {id_type}, rid long, rid2 long, n_shingles long, node long, bands array<long>, sig binary"), "profile")
    nodes = profile.where("n_shingles > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
    nodes = tables.write(nodes.join(profile.select("node", "rid", "bands", "sig").dropDuplicates(["node", "rid"]), ["node", "rid"]), "nodes")
    sig = nodes.select("node", "sig")
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    buckets = tables.write(keys.join(shared, "bucket"), "buckets")
    # of equally frequent centres the smallest; a centre is smaller than its node
    chosen = tables.write(buckets.where("node != centre").groupBy("node").agg(F.mode("centre", deterministic=True).alias("centre")), "centres")

    # a true pair falls this far below its expected agreement once in 1e7
    least = threshold / 100 - 5.2 * (0.25 * 0.75 / (bands * rows)) ** 0.5
    star = chosen.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    star = star.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    star = tables.write(star.mapInArrow(_by_signature(least), "a long, b long"), "star")

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes.select("node", "rid"), "node")
        near, _ = split_by_keys(docs.select("rid", "text"), wanted.select("rid"), "rid")
        return near.join(wanted, "rid").select("node", "text").dropDuplicates(["node"])

    ends = star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct()
    links = tables.write(_confirmed(star, tables.write(texts_of(ends), "texts"), n_words, threshold), "links")
    roots = connected_components(links, "op5-roots")

    # blocks: the nodes below one centre's centre, in parts of bounded count and size
    above = chosen.select(F.col("node").alias("centre"), F.col("centre").alias("upper"))
    placed = nodes.join(chosen, "node", "left").join(above, "centre", "left").join(roots, "node", "left")
    placed = placed.select("node", "sig", "n_shingles", F.coalesce("root", "node").alias("root"), F.coalesce("upper", "centre", "node").alias("cluster"))
    sizes = placed.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = tables.write(placed.join(sizes, "cluster").select("node", "sig", "root", F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("block")), "placed")

    labelled = tables.write(buckets.join(placed.select("node", "root"), "node").select("bucket", "node", "root"), "labelled")
    # a bucket's largest component is connected already: only the other nodes look for links, in parts, each at all nodes
    several = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    several = several.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    parts = F.ceil(F.col("others") / BLOCK).cast("int")
    dealt = labelled.join(several, "bucket").withColumn("own", F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("node"), parts).cast("int"))).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    mixed = dealt.select("node", F.xxhash64("bucket", "other").alias("bucket"), F.when(F.col("own") == F.col("other"), 0).otherwise(1).alias("i"), F.lit(0).alias("j")).join(placed, "node")
    found = mixed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search_buckets(least), "pair long, node long")
    found = tables.write(found.distinct(), "found")
    sets = tables.write(texts_of(found.select("node").distinct()).mapInArrow(_sets(n_words), "node long, shingles binary"), "sets")
    searched = found.join(placed, "node").join(sets, "node").repartition("pair").sortWithinPartitions("pair")
    more = tables.write(searched.mapInArrow(_link_blocks(least, threshold), "a long, b long"), "more")
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "op5-roots")

    labelled = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(smallest, "root").select("node", "component_id", "root")
    tables.drop("buckets", "centres", "star", "texts", "links", "placed", "labelled", "found", "sets")
    out = profile.select("doc_id", "n_shingles", *KEY, "node").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *KEY, "node", "root")


def drop_near_duplicates(docs: DataFrame, n_words: int = N_WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, of equal ones any one.

    Texts move only for rows that go, or that repeat, and their hash neighbours.
    """
    groups = near_duplicates(docs, n_words, threshold, id_col=id_col, text_col=text_col)
    rows = groups.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("kept").alias("kept"), F.first("root").alias("root"))
    # rows without a set stand alone
    rows = rows.withColumn("group", F.when(F.col("root").isNull(), F.concat_ws(":", *KEY)).otherwise(F.col("root").cast("string")))
    chosen = rows.where("kept").groupBy("group").agg(F.min(F.struct(*KEY)).alias("best"))
    verdict = rows.join(chosen, "group").select(*KEY, (F.struct(*KEY) == F.col("best")).alias("stays"), "n")
    special = written(verdict.where("not stays or n > 1").select(*KEY, "stays"), "op5-special")
    # the rows are structs, so that no name clashes
    keyed = docs.select(F.struct(*quoted(docs.columns)).alias("row"), *row_keys(id_col, text_col))
    near, rest = split_by_keys(keyed, special, "rid")
    near = near.join(special.where("not stays").select(*KEY), list(KEY), "left_anti").dropDuplicates(list(KEY))
    return rest.select("row.*").union(near.select("row.*"))
