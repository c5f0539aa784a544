"""Vector top-k, fusion of routes and reranking, for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import cleaning as C
from ..functions import lexicons as L

#: A block of queries, held by a task: so many rows and bytes of vectors, about.
MAX_QUERIES, BLOCK_BYTES = 100_000, 32 << 20
_CHUNK = 256


def usable(vector: Column) -> Column:
    """Whether a vector has a distance: not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, as a matrix, of each vector length."""
    ids, sizes, flat = ids.to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(sizes, sizes)
    return {int(d): (ids[sizes == d], flat[of == d].reshape(-1, d)) for d in np.unique(sizes)}


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in the order of the components: equal vectors get equal sums."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each query, the smaller id first if equal."""
    order = np.lexsort((ids, distance, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


class _Cell:
    """The k nearest of a cell's rows on each route for each of its queries, kept while the rows pass."""

    def __init__(self, queries: pa.Table, k: int, routes: int):
        held = _by_length(queries.column("id").combine_chunks(), queries.column("vector").combine_chunks())
        self.asked = {d: (ids, q, np.sqrt(_fold(q, q))) for d, (ids, q) in held.items()}
        self.k, self.routes, self.best = k, routes, {}

    def see(self, batch: pa.RecordBatch) -> None:
        k, nothing, member = self.k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), batch.column("routes").to_numpy()
        for d, (at, x) in _by_length(pa.array(np.arange(batch.num_rows)), batch.column("vector")).items():
            if d not in self.asked:
                continue
            ids, on = batch.column("id").to_numpy()[at], [np.flatnonzero(member[at] >> r & 1) for r in range(self.routes)]
            q_ids, qs, q_norms = self.asked[d]
            norms = np.sqrt(_fold(x, x))
            for lo in range(0, len(qs), _CHUNK):
                q, q_norm, q_id = qs[lo : lo + _CHUNK], q_norms[lo : lo + _CHUNK], q_ids[lo : lo + _CHUNK]
                with np.errstate(divide="ignore", invalid="ignore"):
                    every = (q @ x.T) / (q_norm[:, None] * norms)
                every[~np.isfinite(every) | (q_id[:, None] == ids)] = -np.inf
                for r, rows in enumerate(on):
                    if not len(rows):
                        continue
                    near = every if len(rows) == len(x) else every[:, rows]
                    kept = self.best.get((d, lo, r), nothing)
                    # products of matrices differ in the last digits: all that may be among the k go on to the exact sums
                    least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(q), -np.inf)
                    full = np.bincount(kept[0], minlength=len(q)) >= k
                    worst = np.full(len(q), -np.inf)
                    np.maximum.at(worst, kept[0], kept[2])
                    least = np.maximum(least, np.where(full, 1 - worst, -np.inf)) - 1e-9
                    a, b = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                    for s in range(0, len(a), 50_000):
                        u, v = a[s : s + 50_000], rows[b[s : s + 50_000]]
                        found = (u, ids[v], 1 - _fold(q[u], x[v]) / (q_norm[u] * norms[v]))
                        kept = tuple(np.concatenate(y) for y in zip(kept, found))
                        top = _best(*kept, k)
                        kept = tuple(y[top] for y in kept)
                    self.best[d, lo, r] = kept

    def found(self):
        for (d, lo, r), (u, ids, distance) in self.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(self.asked[d][0][lo + u]), pa.array(np.full(len(u), r, np.int32)), pa.array(ids), pa.array(distance)], names=["query_id", "route_order", "id", "distance"])


def _cells(k: int, routes: int):
    """Rows sorted by cell, queries before the rows that they are compared with."""

    def run(batches):
        cell, queries, scored = None, [], None
        for batch in batches:
            keys, sides = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | np.diff(sides)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                if keys[lo] != cell:
                    if scored is not None:
                        yield from scored.found()
                    cell, queries, scored = keys[lo], [], None
                if not sides[lo]:
                    queries.append(batch.slice(lo, hi - lo))
                elif queries:
                    scored = scored or _Cell(pa.Table.from_batches(queries), k, routes)
                    scored.see(batch.slice(lo, hi - lo))
        if scored is not None:
            yield from scored.found()

    return run


def vector_routes(rows: DataFrame, queries: DataFrame, k: int, routes: Sequence[tuple[str, Column | None]], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine on each route for each query(query_id, query_vector), in one pass.

    A route is a name and a predicate, which applies before the distances; a row may
    be on several. Returns query_id, id, rank, distance, route and route_order.
    Distances are exact, 1 - cosine in double precision. Both sides are dealt to cells:
    rows in as many parts as there are shuffle partitions, queries in blocks of bounded
    size, whose number comes from a scalar subquery, so nothing is fetched and no job runs
    while the plan is made. A cell holds one block of queries, its rows pass in batches, and
    k rows a query and route leave it. All rows are compared with all queries: the work is
    their product. Ids are whole numbers; rows with the query's id are no hits of it. Rows
    and queries without an id or with a vector that is not ``usable`` take no part, nor do
    pairs of different lengths.
    """
    mask = sum((F.when(F.lit(True) if where is None else where, 1 << r).otherwise(0) for r, (_, where) in enumerate(routes)), F.lit(0))
    fine = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).withColumn("_routes", mask).where("_routes > 0")
    fine = fine.select(F.col(id_col).cast("long").alias("id"), F.col("_routes").cast("int").alias("routes"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = queries.where(F.col("query_id").isNotNull() & usable(F.col("query_vector"))).select(F.col("query_id").cast("long").alias("id"), F.col("query_vector").cast("array<double>").alias("vector"))
    size = F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0))
    blocks = asked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / MAX_QUERIES), F.ceil(size / BLOCK_BYTES)).cast("int").alias("n")).scalar()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, block = F.pmod(F.xxhash64("id"), F.lit(parts)), F.pmod(F.xxhash64("id"), blocks)
    # the cells of one block are dealt to as many tasks, one each
    cell = lambda p, b: [(p * (1 << 32) + b).alias("cell"), (p + b).cast("int").alias("at")]
    whole = fine.withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*cell(part, F.col("b")), F.lit(True).alias("is_row"), "id", "routes", "vector")
    copies = asked.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select(*cell(F.col("p"), block), F.lit(False).alias("is_row"), "id", F.lit(0).alias("routes"), "vector")
    dealt = whole.unionByName(copies).repartitionById(parts, "at").drop("at").sortWithinPartitions("cell", "is_row")
    scored = dealt.mapInArrow(_cells(k, len(routes)), "query_id long, route_order int, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id", "route_order").orderBy("distance", id_col))
    name = F.element_at(F.array(*[F.lit(x) for x, _ in routes]), F.col("route_order") + 1)
    return scored.withColumnRenamed("id", id_col).withColumn("rank", rank).where(F.col("rank") <= k).withColumn("route", name)


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query on one route: query_id, id, rank, distance (see :func:`vector_routes`)."""
    return vector_routes(rows, queries, k, [("all", where)], id_col, vector_col).drop("route", "route_order")


def merge_variants(hits: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Hits of several variants of a query as one list: best rank, variants, smallest distance."""
    merged = hits.groupBy("query_id", id_col).agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set(F.col("variant").cast("string"))), ",").alias("variants"), F.min("distance").alias("distance"))
    return merged.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank", "distance", id_col)))


def fuse(hits: DataFrame, k: int = DEFAULT.rrf_k, id_col: str = "vec_id") -> DataFrame:
    """Reciprocal-rank fusion of routes: the sum of 1 / (k + rank) by id."""
    return hits.groupBy("query_id", id_col).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"), F.min("route_order").alias("first_route"))


def recency(age_days: Column, config: EngineConfig = DEFAULT) -> Column:
    """1 + boost * exp(-age / half_life); ages below 0 count as 0."""
    if config.half_life_days <= 0:
        return F.lit(1.0)
    return 1 + config.recency_boost * F.exp(-F.greatest(age_days, F.lit(0.0)) / config.half_life_days)


def source_weight(source: Column, config: EngineConfig = DEFAULT) -> Column:
    """Weight of a hit's provenance."""
    return F.when(source.isin("live", "user_new"), config.weight_live).when(source == "human_original_image", config.weight_image).when(source == "ai_generated", config.weight_ai).otherwise(config.weight_history)


def final_score(fused: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``rrf`` times source weight, recency, warmth and pair boosts, with the final rank."""
    score = F.col("rrf") * source_weight(F.col("source"), config) * recency(F.col("age_days"), config) * (1 + F.col("warmth") * config.warmth_boost) * F.when(F.col("is_pair"), config.pair_boost).otherwise(1.0)
    return fused.withColumn("score", score)


def diversify(hits: DataFrame, n: int, per_session: int = DEFAULT.max_same_session, id_col: str = "vec_id") -> DataFrame:
    """Top n by score with at most ``per_session`` of a session, filled up by the rest.

    Those within the cap come first; an empty session is never capped.
    """
    by_score = [F.desc("score"), F.asc(id_col)]
    inside = F.row_number().over(Window.partitionBy("query_id", "session").orderBy(*by_score))
    over = F.coalesce(F.col("session").cast("string"), F.lit("")) != ""
    rows = hits.withColumn("_over", over & (inside > per_session) if per_session > 0 else F.lit(False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_over", *by_score))
    return rows.withColumn("position", place).where(F.col("position") <= n).drop("_over")


def blend(hits: DataFrame, model: DataFrame, weight: float = DEFAULT.rerank_weight, id_col: str = "vec_id") -> DataFrame:
    """Score relative to the query's best, mixed with a model's score; no model score is 0."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    joined = hits.join(model, ["query_id", id_col], "left")
    given = F.least(F.greatest(F.coalesce("model_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn("blended", (1 - weight) * F.when(top > 0, F.col("score") / top).otherwise(0.0) + weight * given)


def evaluate(ranked: DataFrame, relevant: Column, cuts: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Any-hit recall at each cut and mean reciprocal rank, over all queries."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("r"))
    hit = [F.avg((F.coalesce(F.col("r"), F.lit(1 << 30)) <= c).cast("int")).alias(f"recall_{c}") for c in cuts]
    return first.agg(F.count("*").alias("n_queries"), *hit, F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


#: Routes of a retrieval in the order that fixes equal scores and attributes, with their sizes.
ROUTES = (("pair", DEFAULT.top_pairs), ("friend", DEFAULT.top_friend), ("window", DEFAULT.top_windows), ("image", DEFAULT.top_images), ("live", DEFAULT.top_live))


def live_allowed(source: Column, conversation: Column, asked: Column, long_term: bool = False) -> Column:
    """Whether a live row may be recalled: generated ones in their own conversation only, unless kept for long."""
    if long_term:
        return F.lit(True)
    return (source != "ai_generated") | F.coalesce((asked != "") & (conversation == asked), F.lit(False))


def route_filters(names: Sequence[str]) -> dict[str, Column]:
    """What a hit must fulfil on each route; columns text, friend_reply, description, source, role, query_text."""
    text = F.coalesce("text", F.lit(""))
    live = C.strip(text)
    return {
        "pair": ~C.low_signal(F.coalesce("friend_reply", F.lit(""))),
        "friend": ~C.low_signal(text) & ~C.echoes(F.coalesce("query_text", F.lit("")), text),
        "window": C.window_has_signal(text, names),
        "image": C.strip(F.coalesce("description", F.lit(""))) != "",
        "live": ~live.isin(*L.PROACTIVE_MARKERS) & ~C.low_signal(live) & ~((F.coalesce("source", F.lit("")) == "live") & (F.coalesce("role", F.lit("")) == "assistant")),
    }


def recent_live(rows: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """The latest n live rows of each query's conversation, newest first."""
    live = rows.where((F.col("route") == "live") & ~F.col("deleted"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc("timestamp_ms"), "chunk_id")
    last = live.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("conversation_id", "chunk_id", "place")
    return queries.where("conversation_id != ''").select("query_id", "conversation_id").join(last, "conversation_id").select("query_id", "chunk_id", "place")


def retrieve(rows: DataFrame, queries: DataFrame, names: Sequence[str], now_ms: int, config: EngineConfig = DEFAULT, long_term: bool = False) -> DataFrame:
    """Ranked memories of each query over five routes.

    ``rows`` has chunk_id, route, vector, deleted, text, friend_reply, description, source,
    role, conversation_id, session, warmth and timestamp_ms; ``queries`` query_id,
    query_vector, query_text and conversation_id. Each route is searched for
    ``over_fetch`` times its size, filtered, and only then cut. Live hits stand behind the
    recent rows of the conversation, each once. Ranks are fused over the routes,
    weighted, and at most ``max_same_session`` of a session come first.
    """
    hits = vector_routes(rows.where(~F.col("deleted")), queries, max(n for _, n in ROUTES) * config.over_fetch, [(r, F.col("route") == r) for r, _ in ROUTES], "chunk_id", "vector")
    size = F.element_at(F.create_map(*[F.lit(x) for r in ROUTES for x in r]), F.col("route"))
    hits = hits.where(F.col("rank") <= size * config.over_fetch).select("query_id", "chunk_id", "route", "route_order", "rank")
    facts = rows.where(~F.col("deleted")).select("chunk_id", "text", "friend_reply", "description", "source", "role", "conversation_id", "session", "warmth", "timestamp_ms")
    asked = queries.select("query_id", "query_text", F.coalesce("conversation_id", F.lit("")).alias("_asked"))
    found = hits.join(facts, "chunk_id").join(asked, "query_id")
    fine = F.lit(False)
    for name, test in route_filters(names).items():
        fine = F.when(F.col("route") == name, test).otherwise(fine)
    found = found.where(F.coalesce(fine, F.lit(False)) & ((F.col("route") != "live") | live_allowed(F.col("source"), F.col("conversation_id"), F.col("_asked"), long_term)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "route").orderBy("rank"))).where(F.col("rank") <= size)
    # recent rows first, then what else the live search found
    recent = recent_live(rows, queries).withColumnRenamed("place", "rank").select("query_id", "chunk_id", F.lit("live").alias("route"), F.lit(4).alias("route_order"), "rank", F.lit(0).alias("_late"))
    ranked = found.select("query_id", "chunk_id", "route", "route_order", "rank")
    extra = ranked.where("route = 'live'").join(recent.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("_late", F.lit(1))
    live = recent.unionByName(extra).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_late", "rank"))).drop("_late")
    fused = fuse(ranked.where("route != 'live'").unionByName(live), config.rrf_k, "chunk_id").join(facts, "chunk_id")
    scored = final_score(fused.withColumn("age_days", (F.lit(now_ms) - F.col("timestamp_ms")) / 86_400_000.0).withColumn("is_pair", F.col("first_route") == 0), config)
    return diversify(scored, config.top_final, config.max_same_session, "chunk_id")


def relationship_hits(memories: DataFrame, queries: DataFrame, n: int = 6) -> DataFrame:
    """The nearest n memories of each query; notes are left out after the cut."""
    hits = vector_topk(memories.where(~F.col("deleted")), queries, n, None, "memory_id", "vector")
    return hits.join(memories.select("memory_id", "kind", "summary"), "memory_id").where("kind != 'note'")


def as_hit(distance: Column, kind: Column, text: Column, friend_reply: Column, description: Column) -> Column:
    """Score and text of a stored row as a hit: 1 - distance, not below 0, and the text of its kind."""
    shown = F.when(kind == "pair", friend_reply).when(kind == "image", description).otherwise(text)
    return F.struct(F.greatest(F.lit(0.0), 1 - distance).alias("score"), F.coalesce(F.nullif(shown, F.lit("")), text, F.lit("")).alias("text"))


def shown_results(hits: DataFrame, limits: Sequence[tuple[str, int]] = (("pair", 8), ("window", 4), ("image", 4))) -> DataFrame:
    """The first hits of each kind that are shown to a model; empty ones take their number but no place."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in limits for x in kv]), F.col("kind"))
    w = Window.partitionBy("query_id", "kind").orderBy("position")
    return hits.withColumn("number", F.row_number().over(w)).where((F.col("number") <= most) & (F.trim("text") != ""))


def gate_rerank(scores: DataFrame, query: Column, least: int = DEFAULT.rerank_min_candidates, short: int = 18, gap: float = 0.18) -> DataFrame:
    """Whether each query's candidates are worth reranking: enough of them, and a short query or close scores."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = scores.withColumn("_n", F.row_number().over(w)).groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("_n") == 5, F.col("score"))).alias("e"), F.first(query).alias("q"))
    close = F.coalesce((F.col("a") > 0) & ((F.col("a") - F.col("e")) / F.col("a") < gap), F.lit(False))
    return top.select("query_id", ((F.col("n") >= least) & ((F.length("q") <= short) | close)).alias("rerank"))


def retrieval_health(ranked: DataFrame, warn: float = 0.5) -> DataFrame:
    """How often queries share their first hit; above ``warn`` the index is suspect."""
    first = ranked.where(F.col("rank") == 1)
    share = 1 - F.countDistinct("vec_id") / F.count("*")
    return first.agg(F.count("*").alias("n_queries"), F.round(share, 6).alias("duplicate_rate"), (share > warn).alias("suspect"))
