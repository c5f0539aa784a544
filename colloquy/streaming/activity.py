"""Activity of conversations: sessions, last activity, pending input, and the poll for writing first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stream_sessions(messages: DataFrame, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream by event time: bounds and counts, once the watermark has passed them.

    Goes beyond the model's own sessions, which are cut on stored messages only: late
    messages up to ``late`` still join. ``messages`` has source, at (timestamp) and role.
    """
    # a session window ends with the gap; one of exactly the gap still belongs together
    window = F.session_window("at", f"{gap_minutes * 60_000 + 1} milliseconds")
    found = messages.withWatermark("at", late).groupBy("source", window).agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "friend").alias("n_friend"), F.min("at").alias("start_at"), F.max("at").alias("end_at"))
    return found.select("source", "start_at", "end_at", "n_messages", "n_friend")


def last_activity(events: DataFrame) -> DataFrame:
    """The latest activity of each conversation; an older one never replaces it."""
    return events.groupBy("conversation_id").agg(F.max("at_ms").alias("last_ms"))


def coalesced_input(events: DataFrame) -> DataFrame:
    """The input that waits for an answer in each conversation.

    ``events`` has caller, at_ms, kind (input, ack or discard), message_id and text. An
    answer (ack) or a discard settles all input before it. A message counts once; the
    generation is the number of inputs so far, so an older answer in work is outdated.
    """
    w = Window.partitionBy("caller").orderBy("at_ms", "message_id")
    rows = events.withColumn("_settled", F.sum((F.col("kind") != "input").cast("int")).over(Window.partitionBy("caller"))).withColumn("_before", F.sum((F.col("kind") != "input").cast("int")).over(w))
    open_ = rows.where("kind = 'input' and _before = _settled").withColumn("_n", F.row_number().over(Window.partitionBy("caller", "message_id").orderBy("at_ms"))).where("_n = 1")
    item = F.struct("at_ms", "message_id", "text")
    merged = open_.groupBy("caller").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n").alias("pending"), F.count("*").alias("n_pending"))
    total = events.groupBy("caller").agg(F.countDistinct(F.when(F.col("kind") == "input", F.col("message_id"))).alias("generation"))
    return total.join(merged, "caller", "left").select("caller", "generation", F.coalesce("pending", F.lit("")).alias("pending"), F.coalesce("n_pending", F.lit(0)).alias("n_pending"))


def recent_context(messages: DataFrame, kept: int = 40, read: int = 12) -> DataFrame:
    """The last messages that a caller's and a conversation's cache hold together.

    A message is stored under both keys, each of which keeps ``kept``; a read merges
    both, counts a message once, and takes the last ``read``. ``messages`` has caller,
    conversation_id, message_id, at_ms and text.
    """
    keys = F.array(F.concat(F.lit("caller:"), "caller"), F.concat(F.lit("conversation:"), "conversation_id"))
    stored = messages.withColumn("key", F.explode(keys)).withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at_ms"), F.desc("message_id")))).where(F.col("_n") <= kept)
    asks = messages.select("caller", "conversation_id").distinct().withColumn("key", F.explode(keys))
    both = asks.join(stored.select("key", "message_id", "at_ms", "text"), "key").dropDuplicates(["caller", "conversation_id", "message_id"])
    place = F.row_number().over(Window.partitionBy("caller", "conversation_id").orderBy(F.desc("at_ms"), F.desc("message_id")))
    return both.withColumn("place", place).where(F.col("place") <= read).drop("key")


def send_limits(audit: DataFrame, activity: DataFrame, now_ms: int, daily: int) -> DataFrame:
    """Whether the day's number of messages is used up, and whether the last one is unanswered, for each conversation.

    ``audit`` has conversation_id, sent_ms (of messages that were sent); ``activity`` is
    :func:`last_activity`. Days are UTC.
    """
    day = now_ms // 86_400_000 * 86_400_000
    sent = audit.groupBy("conversation_id").agg(F.count_if(F.col("sent_ms") >= day).alias("today"), F.max("sent_ms").alias("last_sent"))
    both = sent.join(activity, "conversation_id", "left")
    return both.select("conversation_id", "today", (F.col("today") >= daily).alias("limit_reached"), (F.coalesce("last_ms", F.lit(-1)) <= F.col("last_sent")).alias("unanswered"))


def audit_tail(audit: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` entries of an audit log, newest first."""
    return audit.orderBy(F.desc("sent_ms"), "conversation_id").limit(n)


_ANSWER = "conversation_id string, at_ms long, status string, scheduled_ms long"


def poll(events: DataFrame, delay_ms: int, idle_ms: int, threshold: float) -> DataFrame:
    """Answers to polls whether to write first, as a stateful stream over one conversation each.

    ``events`` has conversation_id, at_ms, kind, value: ``activity`` (value unused), ``poll``
    (value is the score), ``gate`` (a poll that something forbids) and ``finish`` (value is
    the scheduled time of the candidate that was sent). The newest activity wins over a
    candidate that is older: cancelled. A candidate that isn't due is scheduled. A due one is
    ready, and stays until it is finished, if nothing forbids it and the conversation was
    idle and the score suffices; otherwise it is put off: skipped. A poll without one makes one.
    """

    def step(key, pdfs, state):
        created, due, last = state.get if state.exists else (-1, -1, -1)
        out = []
        for e in pd.concat(list(pdfs)).sort_values("at_ms", kind="stable").itertuples():
            if e.kind == "activity":
                last = max(last, e.at_ms)
                continue
            if e.kind == "finish":
                if due == e.value and created >= last:
                    created = due = -1
                continue
            if created >= 0 and last > created:
                created, due, status = e.at_ms, e.at_ms + delay_ms, "cancelled"
            elif created < 0 and e.kind == "gate":
                status = "skipped"
            elif created < 0:
                created, due, status = e.at_ms, e.at_ms + delay_ms, "scheduled"
            elif e.at_ms < due:
                status = "scheduled"
            elif e.kind == "gate" or e.at_ms - last < idle_ms or e.value < threshold:
                created, due, status = e.at_ms, e.at_ms + delay_ms, "skipped"
            else:
                status = "ready"
            out.append((key[0], e.at_ms, status, due if due >= 0 else None))
        state.update((int(created), int(due), int(last)))
        yield pd.DataFrame(out, columns=["conversation_id", "at_ms", "status", "scheduled_ms"]).astype({"scheduled_ms": "Int64"})

    return events.groupBy("conversation_id").applyInPandasWithState(step, _ANSWER, "created long, due long, last long", "append", "NoTimeout")
