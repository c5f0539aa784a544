"""Ordered-sequence operators over the message relation.

A message has source, timestamp_ms, seq, role, kind, text and message_id. Every
operator partitions by source (or session), so a shuffle by that key serves the
whole chain: the session id derives from it, and Spark keeps the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import chunkable

ORDER = ("timestamp_ms", "seq")


def in_order(*keys: str):
    """Window of a partition in message order."""
    return Window.partitionBy(*keys).orderBy(*ORDER)


def sessionize(messages: DataFrame, gap_minutes: float) -> DataFrame:
    """Add ``session_no``: a new one where the gap to the message before is longer."""
    w = in_order("source")
    gap = F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)
    begins = F.when(gap > int(gap_minutes * 60_000), 1).otherwise(0)
    return messages.withColumn("_b", begins).withColumn("session_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_b")


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row per session: bounds, counts by role, first message and id."""
    one = sessions.groupBy("source", "session_no").agg(
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("n_messages"),
        F.count_if(F.col("role") == "friend").alias("n_friend"), F.count_if(F.col("role") == "self").alias("n_self"),
        F.min_by("message_id", F.struct(*ORDER)).alias("first_id"),
    )
    name = F.concat(F.lit("sess-"), F.substring(F.sha1(F.concat_ws("-", "start_ms", "end_ms", "first_id")), 1, 16))
    return one.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).withColumn("session_id", name)


def sliding_windows(sessions: DataFrame, size: int, overlap: int, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """One row per window and message: offset of the window, position in it.

    Steps of ``size - overlap``; the last window of a session ends with it, and a
    short session is one window. System messages are left out. A message is
    copied to the at most ``ceil(size / step)`` windows that hold it.
    """
    step = max(1, size - overlap)
    w = in_order(*keys)
    rows = sessions.where("kind != 'system'").withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    last = F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / step)).cast("int")
    first_window = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1).cast("int")
    to = F.least(last, F.floor(F.col("pos") / step).cast("int"))
    return rows.withColumn("window_no", F.explode(F.when(first_window <= to, F.sequence(first_window, to)))).withColumn("place", F.col("pos") - F.col("window_no") * step).drop("pos", "n")


def turns(sessions: DataFrame, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """Add ``turn_no``: runs of one role within a session."""
    w = in_order(*keys)
    change = F.when(F.col("role") != F.lag("role").over(w), 1).otherwise(0)
    return sessions.withColumn("_c", change).withColumn("turn_no", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_c")


def rendered(speaker: Column, text: Column) -> Column:
    """A dialogue line."""
    return F.concat(speaker, F.lit(": "), text)


def context_frames(sessions: DataFrame, before: int, after: int, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """Add rendered ``context_before`` and ``context_after``; system and blank rows take a place but no line."""
    w = in_order(*keys)
    line = F.when((F.col("kind") != "system") & (F.trim("text") != ""), rendered(F.col("role"), F.trim("text")))
    rows = sessions.withColumn("_l", line)
    join = lambda lo, hi: F.array_join(F.collect_list(F.col("_l")).over(w.rowsBetween(lo, hi)), "\n")
    return rows.withColumn("context_before", join(-before, -1)).withColumn("context_after", join(1, after)).drop("_l")


def response_pairs(sessions: DataFrame, reply_cap: int, keys: Sequence[str] = ("source", "session_no"), identity: Column | None = None) -> DataFrame:
    """Runs of self messages with the friend replies before the next self message.

    Only messages with text of their own count (``chunkable``); one of the user's that
    has none ends the run and what may answer it. A run without replies gives no
    row; at most ``reply_cap`` replies count. With an ``identity`` of messages each pair
    has an id of those it consists of.
    """
    w = in_order(*keys)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    usable = chunkable(F.col("kind"), F.col("text"))
    rows = sessions.withColumn("_s", (F.col("role") == "self") & usable)
    # a self message begins a new group unless it goes on with a run of usable ones
    goes_on = F.col("_s") & F.coalesce(F.lag("_s").over(w), F.lit(False))
    rows = rows.withColumn("_new", ((F.col("role") == "self") & ~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(up_to))
    rows = rows.where((F.col("_run") > 0) & (F.col("_s") | ((F.col("role") == "friend") & usable)))
    rows = rows.withColumn("_k", F.when(~F.col("_s"), F.row_number().over(Window.partitionBy(*keys, "_run", "_s").orderBy(*ORDER))))
    kept = rows.where(F.col("_s") | (F.col("_k") <= reply_cap))
    item = F.struct("timestamp_ms", "seq", F.trim("text").alias("t"))
    texts = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda x: x["t"]), "\n\n")
    ids = []
    if identity is not None:
        part = F.struct(F.when(F.col("_s"), 0).otherwise(1).alias("side"), "timestamp_ms", "seq", F.concat(F.when(F.col("_s"), "u:").otherwise("f:"), identity).alias("t"))
        name = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "|")
        listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("timestamp_ms", "seq", "message_id")))), lambda x: x["message_id"])
        ids = [F.concat(F.lit("pair-"), F.substring(F.sha1(name), 1, 16)).alias("pair_id"), listed(F.col("_s")).alias("user_message_ids"), listed(~F.col("_s")).alias("friend_message_ids"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq")]
    out = kept.groupBy(*keys, "_run").agg(
        *ids,
        texts(F.col("_s")).alias("user_text"), texts(~F.col("_s")).alias("friend_reply"),
        F.count_if(F.col("_s")).alias("n_user"), F.count_if(~F.col("_s")).alias("n_reply"),
        F.min("timestamp_ms").alias("start_time_ms"), F.max(F.when(~F.col("_s"), F.col("timestamp_ms"))).alias("end_time_ms"),
    )
    return out.where("n_user > 0 and n_reply > 0").withColumnRenamed("_run", "run_no")


def adjacent_pairs(sessions: DataFrame, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """Friend messages right after a self message, with both texts."""
    w = in_order(*keys)
    rows = sessions.select(*keys, *ORDER, "role", "kind", "text", F.lag("role").over(w).alias("_r"), F.lag("text").over(w).alias("user_text"), F.lag("kind").over(w).alias("_k"))
    return rows.where("role = 'friend' and _r = 'self' and kind != 'system' and _k != 'system'").select(*keys, *ORDER, "user_text", F.col("text").alias("reply"))


def idle_gaps(summary: DataFrame) -> DataFrame:
    """Whole minutes from the previous session's end, and the bucket of the gap."""
    w = Window.partitionBy("source").orderBy("start_ms", "end_ms")
    gap = ((F.col("start_ms") - F.lag("end_ms").over(w)) / 60_000).cast("long")
    return summary.withColumn("gap_minutes", gap).withColumn("gap_bucket", gap_bucket(F.col("gap_minutes")))


def gap_bucket(minutes: Column) -> Column:
    """Idle time as one of five buckets; null for none before."""
    return F.when(minutes < 60, "short").when(minutes < 180, "one_to_three_hours").when(minutes < 480, "three_to_eight_hours").when(minutes < 2160, "overnight").when(minutes.isNotNull(), "multi_day")


def tail_budget(messages: DataFrame, max_messages: int, max_chars: int, key: str = "source") -> DataFrame:
    """The last messages of each key within both budgets, from a user message on."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in ORDER])
    rows = messages.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = rows.where((F.col("_n") <= max_messages) & ((F.col("_c") <= max_chars) | (F.col("_n") == 1)))
    first = F.max(F.when(F.col("role") == "self", F.col("_n"))).over(Window.partitionBy(key))
    return within.withColumn("_f", first).where(F.col("_n") <= F.col("_f")).drop("_n", "_c", "_f")


def session_openings(sessions: DataFrame) -> DataFrame:
    """First human message of every session, with the pause before it: one aggregate gives both bounds and message."""
    human = F.col("role").isin("self", "friend")
    first = F.min_by(F.when(human, F.struct("role", "timestamp_ms", "text")), F.when(human, F.struct(*ORDER)))
    one = sessions.groupBy("source", "session_no").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), first.alias("o"))
    return idle_gaps(one).where("o is not null").select("source", "session_no", F.col("o.role").alias("initiator"), F.col("o.timestamp_ms").alias("opened_ms"), F.col("o.text").alias("opening"), "gap_minutes", "gap_bucket")


def budget_context(sessions: DataFrame, budget: int, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """Add ``context_before`` and ``context_after`` by characters: the nearest messages within ``budget``, half of it after.

    A message that goes beyond is taken only if nothing with text was taken before
    it. Frames are ranges over running lengths, so a message reads its context only.
    """
    w = in_order(*keys)
    size = F.length(F.trim("text"))
    line = F.when((F.col("kind") != "system") & (F.trim("text") != ""), rendered(F.col("role"), F.trim("text")))
    rows = sessions.withColumn("_upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_upto") - size)
    rows = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_item", F.struct(F.col("_pos").alias("pos"), line.alias("line")))
    some = F.when(size > 0, F.col("_item"))
    by = Window.partitionBy(*keys)
    before = F.collect_list("_item").over(by.orderBy("_from").rangeBetween(-budget, 0))
    after = F.collect_list("_item").over(by.orderBy("_upto").rangeBetween(0, max(1, budget // 2)))
    rows = rows.withColumns({
        "_before": F.array_append(F.filter(before, lambda x: x["pos"] < F.col("_pos")), F.last(some, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))),
        "_after": F.array_append(F.filter(after, lambda x: x["pos"] > F.col("_pos")), F.first(some, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))),
    })
    text = lambda c: F.array_join(F.transform(F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))), lambda x: x["line"]), "\n")
    return rows.withColumns({"context_before": text("_before"), "context_after": text("_after")}).drop("_upto", "_from", "_pos", "_item", "_before", "_after")


def opening_runs(sessions: DataFrame, excerpt: int = 120, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """The initiator's messages of each session up to the first of the other side, and the beginning of the answer.

    The first human message names the initiator, whatever its kind; messages without
    content don't count. Returns keys, initiator, opened_ms, opening, n_opening, response.
    """
    content = message_content(F.col("text"), F.col("placeholders")) if "placeholders" in sessions.columns else F.trim("text")
    human = sessions.where(F.col("role").isin("self", "friend")).withColumn("_text", content)
    w = in_order(*keys)
    first = human.withColumn("_who", F.first("role").over(w)).withColumn("_other", F.sum((F.col("role") != F.col("_who")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(*ORDER, F.col("_text").alias("t"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_other") == 0) & (F.col("_text") != ""), item))), lambda x: x["t"]), "\n")
    answer = F.min_by(F.when(F.col("_other") > 0, F.col("_text")), F.when((F.col("_other") > 0) & (F.col("role") != F.col("_who")) & (F.col("_text") != ""), F.struct(*ORDER)))
    return first.groupBy(*keys).agg(
        F.first("_who").alias("initiator"), F.min("timestamp_ms").alias("opened_ms"), texts.alias("opening"),
        F.count_if((F.col("_other") == 0) & (F.col("_text") != "")).alias("n_opening"), F.substring(answer, 1, excerpt).alias("response"),
    ).where("opening != ''")


def message_content(text: Column, placeholders: Column) -> Column:
    """A message's text, or its placeholders where it has none."""
    return F.coalesce(F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit("")), F.array_join(F.coalesce(placeholders, F.array().cast("array<string>")), " "))


def human_ends(sessions: DataFrame, usable: Column, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """First and last human message of each session that is ``usable`` and neither recalled nor of the system."""
    fine = sessions.where(F.col("role").isin("self", "friend") & ~F.col("kind").isin("system", "recalled") & usable)
    row = F.struct("role", "timestamp_ms", "text")
    ends = fine.groupBy(*keys).agg(F.min_by(row, F.struct(*ORDER)).alias("a"), F.max_by(row, F.struct(*ORDER)).alias("z"))
    return ends.select(*keys, F.col("a.role").alias("first_role"), F.col("a.timestamp_ms").alias("first_ms"), F.col("a.text").alias("first_text"), F.col("z.role").alias("last_role"), F.col("z.timestamp_ms").alias("last_ms"), F.col("z.text").alias("last_text"))


def previous_tail(sessions: DataFrame, size: int = 4) -> DataFrame:
    """One row per session with the last lines of the session before it, and the idle minutes between."""
    lines = sessions.where((F.col("kind") != "system") & (F.trim("text") != ""))
    w = Window.partitionBy("source", "session_no").orderBy(*[F.desc(c) for c in ORDER])
    ends = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
    item = F.struct(*ORDER, rendered(F.col("role"), F.trim("text")).alias("line"))
    tail = ends.groupBy("source", "session_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("tail"))
    gaps = idle_gaps(session_summary(sessions)).join(tail, ["source", "session_no"], "left")
    before = Window.partitionBy("source").orderBy("start_ms", "end_ms")
    return gaps.select("source", "session_no", "gap_minutes", F.coalesce(F.lag("tail").over(before), F.lit("")).alias("previous_tail"))


def even_sample(rows: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], prefix: Column | None = None) -> DataFrame:
    """Rows ``floor(i * count / n)`` of each key in order; then the first of each ``prefix``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    # i is an index of the sample iff some j < n has floor(j * count / n) = i
    j = F.ceil(F.col("_i") * n / F.col("_n"))
    kept = at.where((F.col("_n") <= n) | ((j < n) & (F.floor(j * F.col("_n") / n) == F.col("_i"))))
    if prefix is not None:
        kept = kept.withColumn("_p", prefix).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))).where("_k = 1").drop("_p", "_k")
    return kept.drop("_i", "_n")


#: Ranges of equal width that a bucket's order is counted in.
_RANGES = 1024


def length_quota_sample(rows: DataFrame, n: int, length: Column, key: str, order: Sequence[str], shares: Sequence[int] = (3, 4, 3), bounds: Sequence[int] = (8, 30)) -> DataFrame:
    """Up to ``n`` rows of each key, spread evenly over short, middle and long ones by ``shares``.

    What a bucket cannot fill goes to the others, the middle one first. The first column
    of ``order`` is a number; its range is counted in ``_RANGES`` parts, so that no bucket is
    sorted as a whole.
    """
    bucket = F.when(length < bounds[0], 0).when(length <= bounds[1], 1).otherwise(2)
    rows = rows.withColumn("_b", bucket)
    have = rows.groupBy(key).agg(*[F.count_if(F.col("_b") == b).alias(f"_h{b}") for b in range(3)])
    quota = [n * s // sum(shares) for s in shares]
    quota[1] += n - sum(quota)
    got = {b: F.least(F.col(f"_h{b}"), F.lit(quota[b])) for b in range(3)}
    spare, take = F.lit(n) - got[0] - got[1] - got[2], dict(got)
    for b in (1, 0, 2):
        more = F.least(F.col(f"_h{b}") - got[b], spare)
        take[b], spare = got[b] + more, spare - more
    plan = have.select(key, F.posexplode(F.array(*[take[b].cast("long") for b in range(3)])).alias("_b", "_take"))
    # the wanted places of a bucket lie in few ranges of its order: only those are numbered
    first = F.col(order[0]).cast("double")
    spans = rows.groupBy(key, "_b").agg(F.min(first).alias("_lo"), F.max(first).alias("_hi"), F.count("*").alias("_n"))
    at = rows.join(spans, [key, "_b"]).withColumn("_r", F.floor((first - F.col("_lo")) * _RANGES / (F.col("_hi") - F.col("_lo") + 1)))
    counts = at.groupBy(key, "_b", "_r").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key, "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    places = plan.where("_take > 0").join(spans.select(key, "_b", "_n"), [key, "_b"])
    places = places.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_take") - 1), lambda j: F.floor(j * F.col("_n") / F.col("_take"))))).select(key, "_b", "_at")
    wanted = places.join(counts.withColumn("_before", before), [key, "_b"]).where("_at >= _before and _at < _before + _c").select(key, "_b", "_r", (F.col("_at") - F.col("_before")).alias("_i"))
    some = at.join(wanted.select(key, "_b", "_r").distinct(), [key, "_b", "_r"], "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy(key, "_b", "_r").orderBy(*order)) - 1)
    return some.join(wanted, [key, "_b", "_r", "_i"], "left_semi").drop("_b", "_i", "_n", "_lo", "_hi", "_r")


def occurrence(rows: DataFrame, digest: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``occurrence``: how many equal rows came before, in a stated order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*digest).orderBy(*order)) - 1)


def trim_since(sessions: DataFrame, since_ms: int) -> DataFrame:
    """Messages from a time on; the sessions keep their numbers."""
    return sessions.where(F.col("timestamp_ms") >= since_ms)


def window_chunks(windows: DataFrame, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """Rendered windows of :func:`sliding_windows` with an id; those without a line are left out."""
    line = F.when(F.trim("text") != "", rendered(F.col("role"), F.trim("text")))
    item = F.struct("place", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), item))), lambda x: x["line"]), "\n")
    out = windows.groupBy(*keys, "window_no").agg(F.count("*").alias("message_count"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), text.alias("text"))
    name = F.concat_ws("-", *keys, "start_seq", "end_seq")
    return out.where("text != ''").withColumn("chunk_id", F.concat(F.lit("window-"), F.substring(F.sha1(name), 1, 16)))


def message_identity(platform_ids: Column) -> Column:
    """A message's identity: without its place in a file where the platform's ids are stable."""
    return F.when(platform_ids, F.concat_ws("|", "message_id", "timestamp_ms", "sender_uid")).otherwise(F.concat_ws("|", "message_id", "seq", "timestamp_ms", "sender_uid"))


def message_tags(has_media: Column, reply_to: Column, kind: Column) -> Column:
    """Sorted tags of a message."""
    tag = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return F.concat(tag(has_media, "media"), tag(kind == "placeholder", "placeholder"), tag(F.coalesce(reply_to, F.lit("")) != "", "reply"))
