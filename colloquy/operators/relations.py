"""Mutation of keyed relations, as new versions of a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of the same key.

    Of source rows with one key the last by ``order`` counts; without an order the one
    whose columns compare greatest, so that the key stays unique and a rerun gives the same.
    """
    rows = source.select(*target.columns) if order is None else source.select(*target.columns, order.alias("_order"))
    rest = [c for c in target.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*rest) if order is None else F.col("_order")).alias("_r")).select(key, "_r.*")
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(latest)


def soft_delete(target: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """``deleted`` set for the keys of ``gone``; older tombstones stay."""
    marks = gone.select(key, F.lit(True).alias("_gone")).distinct()
    return target.join(marks, key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def keep_first(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity in a stated order."""
    w = Window.partitionBy(*identity).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the latest."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def pending(chunks: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Chunks not yet in the target; tombstones count as being there."""
    return chunks.join(existing.select(key), key, "left_anti")


def update_matched(target: DataFrame, labels: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Label columns taken from ``labels`` where the key matches and the value is not null."""
    new = labels.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(new, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return joined


def recent_per_key(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The latest n rows of each key, newest first."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)


def _best(rows: DataFrame, order: list) -> Column:
    """The columns of ``order`` of a group's best row, as an aggregate."""
    fields = F.struct(*[c for c, _ in order])
    if all(falling for _, falling in order):
        return F.max(fields)
    if not any(falling for _, falling in order):
        return F.min(fields)
    # numbers turn around by their sign; of texts, which have none, the bytes do
    types = dict(rows.dtypes)
    bytes_of = lambda c: F.concat(F.hex(F.encode(c, "utf-8")), F.lit("!"))
    turned = lambda c: F.translate(bytes_of(c), "!0123456789ABCDEF", "GFEDCBA9876543210") if types[c] == "string" else -F.col(c)
    return F.max_by(fields, F.struct(*[F.col(c) if falling else turned(c) for c, falling in order]))


def best_per_group_then_fill(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The best row of every group first, then the best of the rest, n in all.

    ``order`` is a list of (column, falling). The best of a group is an aggregate, and the
    rest is cut by a top n, so no group is sorted. ``order`` must tell rows apart.
    """
    names = [c for c, _ in order]
    best = rows.groupBy(group).agg(_best(rows, order).alias("_b")).select(group, "_b.*", F.lit(True).alias("is_best"))
    sort = [F.desc(c) if falling else F.asc(c) for c, falling in order]
    marked = rows.join(best, [group, *names], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))
    return marked.orderBy(F.desc("is_best"), *sort).limit(n)


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns of ``defaults`` where they are missing or null."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(name, value) if name in rows.columns else value)
    return rows


def append_live(target: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """New messages with the defaults of live rows, upserted by id."""
    given = with_defaults(rows, {"source": F.lit("live"), "confirmed": F.lit(True), "trust_level": F.lit(0.35), "deleted": F.lit(False), "created_at_ms": F.lit(now_ms).cast("long"), "attachments": F.array().cast("array<string>")})
    return upsert(target, given.select(*target.columns))


def upsert_memories(target: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """Memories of a relation with their defaults, upserted by id."""
    now = F.lit(now_ms).cast("long")
    given = with_defaults(rows, {"kind": F.lit("note"), "importance": F.lit(1), "source": F.lit("chat"), "conversation_id": F.lit(""), "created_at_ms": now, "updated_at_ms": now, "deleted": F.lit(False)})
    return upsert(target, given.select(*target.columns))


def purge(target: DataFrame, now_ms: int, source: str = "ai_generated", older_than_days: int = 0, conversation: str | None = None) -> DataFrame:
    """``target`` with tombstones on all rows of a source, of a conversation or beyond an age only if asked."""
    hit = (F.col("source") == source) & ~F.col("deleted")
    if conversation:
        hit &= F.col("conversation_id") == conversation
    if older_than_days > 0:
        hit &= F.col("created_at_ms") < now_ms - older_than_days * 86_400_000
    return target.withColumn("deleted", F.col("deleted") | F.coalesce(hit, F.lit(False)))


def purge_count(target: DataFrame, now_ms: int, **what) -> DataFrame:
    """How many rows :func:`purge` would mark, as one row."""
    marked = purge(target.withColumn("_was", F.col("deleted")), now_ms, **what)
    return marked.agg(F.count_if(F.col("deleted") & ~F.col("_was")).alias("n"))


def remember(log: DataFrame, turns: DataFrame, key: str = "conversation_id", text: str = "text") -> DataFrame:
    """``log`` with the turns whose text it doesn't hold yet; a text counts once, and so does none."""
    known = log.select(F.col(key).alias("_k"), F.col(text).alias("_t")).distinct()
    new = turns.join(known, F.col(key).eqNullSafe(F.col("_k")) & F.col(text).eqNullSafe(F.col("_t")), "left_anti").dropDuplicates([key, text])
    return log.unionByName(new.select(*log.columns))


def latest_by_key(rows: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """A key-value log as a table: the last valid value of each key."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def slowest(records: DataFrame, n: int, keys: list[str], duration: str) -> DataFrame:
    """The ``n`` longest records of each group, longest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(duration), "id")
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def listed_windows(windows: DataFrame, most: int = 10_000) -> DataFrame:
    """Windows by their bounds, the first ``most`` of all: the cut comes after the order."""
    return windows.orderBy("start_time_ms", "end_time_ms", "id").limit(most)


def offered_stickers(stickers: DataFrame, most: int = 30) -> DataFrame:
    """Stickers that the assistant may use: its own and shared ones, those with most tags first, then the oldest."""
    tags = F.size(F.coalesce("tags", F.array().cast("array<string>")))
    return stickers.where(F.col("owner").isin("ai", "shared")).orderBy(F.desc(tags), "created_at_ms", "id").limit(most)


def import_totals(files: DataFrame) -> DataFrame:
    """Totals over imported files: files, failures, messages, chunks."""
    return files.agg(F.count("*").alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


# joins ------------------------------------------------------------------------------------------


def with_people(messages: DataFrame, people: DataFrame, own: list[str] = (), friends: list[str] = ()) -> DataFrame:
    """Messages with the sender's name and role.

    ``people`` has uid, name and role. A role is, in this order: that of a system message,
    the message's own, the person's, the one of the configured ids, other.
    """
    known = people.groupBy("uid").agg(F.first("name", ignorenulls=True).alias("_name"), F.first("role", ignorenulls=True).alias("_role"))
    joined = messages.join(known, messages["sender_uid"] == known["uid"], "left").drop("uid")
    configured = F.when(F.col("sender_uid").isin(*own), "self").when(F.col("sender_uid").isin(*friends), "friend")
    own_role = F.col("role") if "role" in messages.columns else F.lit(None).cast("string")
    role = F.when(F.col("kind") == "system", "system").otherwise(F.coalesce(own_role, F.col("_role"), configured, F.lit("other")))
    return joined.withColumn("role", role).withColumn("sender_name", F.coalesce(F.nullif("sender_name", F.lit("")), "_name", "sender_uid")).drop("_name", "_role")


def refs_with_messages(refs: DataFrame, messages: DataFrame, order: list[str]) -> DataFrame:
    """Image references with their message's session; of messages with one id the last counts."""
    last = messages.groupBy("message_id").agg(F.max_by(F.struct("source", "session_no", "timestamp_ms"), F.struct(*order)).alias("_m"))
    return refs.join(last, "message_id").select(*[refs[c] for c in refs.columns], "_m.*")


def refs_with_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References with a file: of the same path, else name, else a file whose name ends in ``_name``.

    Paths and names are compared in lower case. A rule under which several files fit
    gives no file, and the next rule isn't tried. ``refs`` has ref_id and path, ``files``
    path.
    """
    low = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    name = lambda c: F.regexp_extract(low(c), "[^/]*$", 0)
    stored = files.select(F.col("path").alias("file"), low(F.col("path")).alias("_path"), name(F.col("path")).alias("_name"))
    # every suffix of a stored name that follows an underline is a key, so the suffix rule is an equi-join
    parts = F.split("_name", "_")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    keys = stored.select("file", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("rule"), F.col("_path").alias("key")), F.struct(F.lit(1).alias("rule"), F.col("_name").alias("key"))),
        F.when(F.size(parts) > 1, F.transform(suffixes, lambda x: F.struct(F.lit(2).alias("rule"), x.alias("key")))).otherwise(F.array().cast("array<struct<rule:int,key:string>>")),
    )).alias("k")).select("file", "k.*")
    one = keys.groupBy("rule", "key").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    wanted = refs.select("ref_id", F.explode(F.array(F.struct(F.lit(0).alias("rule"), low(F.col("path")).alias("key")), F.struct(F.lit(1).alias("rule"), name(F.col("path")).alias("key")), F.struct(F.lit(2).alias("rule"), name(F.col("path")).alias("key")))).alias("k")).select("ref_id", "k.*")
    hits = wanted.join(one, ["rule", "key"]).groupBy("ref_id").agg(F.min_by(F.when(F.col("n") == 1, F.col("file")), "rule").alias("file"))
    return refs.join(hits, "ref_id", "left")


def with_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with their vector, chunks that have none)."""
    usable = vectors.where(F.col("vector").isNotNull())
    return chunks.join(usable, key), chunks.join(usable.select(key), key, "left_anti")


def cached_attributions(openings: DataFrame, cache: DataFrame, language: str) -> DataFrame:
    """Openings with the stored category; only where text, initiator and language are unchanged."""
    old = cache.select("opening_id", F.col("category").alias("_c"), F.col("opening").alias("_o"), F.col("initiator").alias("_i"), F.col("language").alias("_l"))
    same = (F.col("_o") == F.col("opening")) & (F.col("_i") == F.col("initiator")) & (F.col("_l") == language)
    return openings.join(old, "opening_id", "left").withColumn("category", F.when(same, F.nullif("_c", F.lit("")))).drop("_c", "_o", "_i", "_l")


# fixed values: how descriptions of images begin that failed
FAILED = ("[Image: recognition failed", "[Image: recognition timed out", "[Image: no description", "[图片：识别失败", "[图片：识别超时")


def usable_description(text: Column) -> Column:
    """Whether a description says something and doesn't report a failure."""
    said = F.trim(F.coalesce(text, F.lit("")))
    return (said != "") & ~said.rlike("^(?:" + "|".join(re.escape(x) for x in FAILED) + ")")


def reuse_descriptions(images: DataFrame, described: DataFrame) -> DataFrame:
    """Images with a description stored for the same content, and what is left to do with each.

    ``described`` has image_sha, description and deleted. Empty ones and failures
    aren't usable. States: reusable, failed, pending.
    """
    fine = usable_description(F.col("description"))
    known = described.groupBy("image_sha").agg(F.min(F.when(fine & ~F.col("deleted"), F.col("description"))).alias("reused"), F.count("*").alias("_n"))
    state = F.when(F.col("reused").isNotNull(), "reusable").when(F.col("_n") > 0, "failed").otherwise("pending")
    return images.join(known, "image_sha", "left").withColumn("state", state).drop("_n")
