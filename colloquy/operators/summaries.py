"""Incremental summaries of long conversations.

A stored summary covers the first messages of a conversation and names them by a digest.
The digest of a prefix is a sum over its messages, each hashed with its place, so all
prefixes of all conversations have theirs by one running sum, and a stored state is valid
exactly if the sum at its end is unchanged. Where the prefix was edited the state is
replaced from the beginning; else only messages that it doesn't cover are summarised.

What writes a summary is a function of the text so far and a batch of messages; a task
folds a conversation's batches in order and holds one of them at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import next_fit

VERSION = 1


@dataclass(frozen=True)
class SummaryLimits:
    """When a conversation is summarised, and how much of it stays as it is."""

    trigger_messages: int = 40
    trigger_chars: int = 12_000
    keep_messages: int = 16
    recent_chars: int = 6_000
    batch_chars: int = 12_000
    max_chars: int = 2_000


def _parts(place: Column, role: Column, content: Column) -> list[Column]:
    """Four numbers of 60 bits of a message at its place."""
    digest = F.sha2(F.to_json(F.array(place.cast("string"), role, content)), 256)
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]


def prefixes(messages: DataFrame, key: str = "conversation_id", order: str = "seq") -> DataFrame:
    """User's and assistant's messages with their place from 1 and the digest of all messages up to them.

    ``messages`` has key, order, role and content. Other roles are instructions, which no summary covers.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = messages.where("role in ('user', 'assistant')").select(key, order, "role", F.coalesce("content", F.lit("")).alias("content")).withColumn("place", F.row_number().over(w).cast("long"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(p).over(so_far).cast("string") for p in _parts(F.col("place"), F.col("role"), F.col("content"))]
    return rows.withColumn("prefix_digest", F.sha2(F.concat_ws("-", *sums), 256))


def summary_heads(history: DataFrame, stored: DataFrame, limits: SummaryLimits = SummaryLimits(), key: str = "conversation_id") -> DataFrame:
    """One row per conversation: n, covered, summary (of what is valid), split and split_digest.

    ``history`` is :func:`prefixes`, ``stored`` has key, version, covered, prefix_digest and
    summary. Messages up to ``split`` are to be covered; ``split`` is ``covered`` where nothing
    is to be done. What stays are at most ``keep_messages`` with ``recent_chars`` symbols
    from the end, from a user's message on.
    """
    old = stored.where(F.col("version") == VERSION).select(key, F.col("covered").alias("_c"), F.col("prefix_digest").alias("_d"), F.col("summary").alias("_s"))
    at = history.select(key, F.col("place").alias("_c"), F.col("prefix_digest").alias("_now"))
    usable = (F.trim("_s") != "") & (F.length("_s") <= limits.max_chars) & (F.col("_d") == F.col("_now"))
    valid = old.join(at, [key, "_c"]).where(usable).groupBy(key).agg(F.max_by(F.struct("_c", "_s"), "_c").alias("_v")).select(key, F.col("_v._c").alias("covered"), F.col("_v._s").alias("summary"))
    rows = history.join(valid, key, "left").withColumns({"covered": F.coalesce("covered", F.lit(0).cast("long")), "summary": F.coalesce("summary", F.lit(""))})
    w = Window.partitionBy(key).orderBy(F.desc("place"))
    to_end = w.rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("content")
    rows = rows.withColumns({"_open": F.col("place") > F.col("covered"), "_back": F.row_number().over(w), "_chars": F.sum(size).over(to_end)})
    kept = F.col("_open") & (F.col("_back") <= limits.keep_messages) & (F.col("_chars") <= limits.recent_chars)
    one = rows.groupBy(key).agg(
        F.max("place").alias("n"), F.max("covered").alias("covered"), F.max("summary").alias("summary"), F.count_if("_open").alias("open"), F.coalesce(F.sum(F.when(F.col("_open"), size)), F.lit(0)).alias("chars"),
        F.min(F.when(kept & (F.col("role") == "user"), F.col("place"))).alias("_first"),
    )
    short = (F.col("open") <= limits.trigger_messages) & (F.length("summary") + F.col("chars") <= limits.trigger_chars)
    split = F.when(short, F.col("covered")).otherwise(F.coalesce(F.col("_first") - 1, F.col("n")))
    one = one.withColumn("split", split).select(key, "n", "covered", "summary", "split")
    return one.join(history.select(key, F.col("place").alias("split"), F.col("prefix_digest").alias("split_digest")), [key, "split"], "left").select(key, "n", "covered", "summary", "split", "split_digest")


def summary_batches(history: DataFrame, heads: DataFrame, limits: SummaryLimits = SummaryLimits(), key: str = "conversation_id") -> DataFrame:
    """Newly covered messages in batches: key, batch_no, place, piece, role, content.

    A batch holds ``batch_chars`` symbols at most; a longer message is cut in pieces, and nothing is lost.
    """
    rows = history.join(heads.select(key, "covered", "split"), key).where("place > covered and place <= split")
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(limits.batch_chars))
    cut = rows.select(key, "place", "role", "content", F.posexplode(starts).alias("piece", "_at"))
    pieces = cut.select(key, "place", "piece", "role", F.substr("content", F.col("_at") + 1, F.lit(limits.batch_chars)).alias("content")).withColumn("_cost", F.length("content"))
    return next_fit(pieces, [key], ["place", "piece"], "_cost", limits.batch_chars, "batch_no").drop("_cost")


def summarised(batches: DataFrame, heads: DataFrame, write: Callable[[str, list[dict]], str], limits: SummaryLimits = SummaryLimits(), key: str = "conversation_id") -> DataFrame:
    """States of the conversations with batches: key, version, covered, prefix_digest, summary, error.

    ``write`` gets the summary so far and a batch, a list of role and content. If it fails or
    gives nothing, the row has the error and no summary, and the stored state should stay.
    """
    todo = heads.where("split > covered").select(key, "summary", "split", "split_digest")
    rows = batches.join(todo, key).repartition(key).sortWithinPartitions(key, "batch_no", "place", "piece")
    most, kind = limits.max_chars, dict(heads.dtypes)[key]

    def run(parts):
        state: dict = {}

        def told():
            if state["batch"] and state["error"] is None:
                try:
                    state["summary"] = (write(state["summary"], state["batch"]) or "").strip()[:most]
                    if not state["summary"]:
                        state["error"] = "the summary is empty"
                except Exception as e:  # noqa: BLE001  what a model's client raises becomes a row
                    state["error"] = f"{type(e).__name__}: {e}"
            state["batch"] = []

        def done():
            told()
            return state["key"], VERSION, state["split"], state["digest"], None if state["error"] else state["summary"], state["error"]

        for part in parts:
            out = []
            for row in part.to_pylist():
                if state.get("key") != row[key] or not state:
                    if state:
                        out.append(done())
                    state = {"key": row[key], "split": row["split"], "digest": row["split_digest"], "summary": row["summary"], "error": None, "batch": [], "no": row["batch_no"]}
                if row["batch_no"] != state["no"]:
                    told()
                    state["no"] = row["batch_no"]
                state["batch"].append({"role": row["role"], "content": row["content"]})
            if out:
                yield table(out, part.schema)
            schema = part.schema
        if state:
            yield table([done()], schema)

    def table(out, schema):
        kinds = (schema.field(key).type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[key, "version", "covered", "prefix_digest", "summary", "error"])

    return rows.mapInArrow(run, f"{key} {kind}, version int, covered long, prefix_digest string, summary string, error string")


def update_summaries(messages: DataFrame, stored: DataFrame, write: Callable[[str, list[dict]], str], limits: SummaryLimits = SummaryLimits(), key: str = "conversation_id", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(new stored states, what to show of each conversation: its valid summary and place from which messages stay as they are)."""
    history = prefixes(messages, key, order)
    heads = summary_heads(history, stored, limits, key)
    new = summarised(summary_batches(history, heads, limits, key), heads, write, limits, key)
    fine = new.where("error is null").drop("error")
    states = stored.select(*fine.columns).join(fine.select(key), key, "left_anti").unionByName(fine)
    shown = heads.join(fine.select(key, F.col("summary").alias("_new"), F.col("covered").alias("_upto")), key, "left")
    return states, shown.select(key, F.coalesce("_new", "summary").alias("summary"), (F.coalesce("_upto", "covered") + 1).alias("from_place"))


def recent(messages: DataFrame, shown: DataFrame, key: str = "conversation_id", order: str = "seq") -> DataFrame:
    """The messages that no summary covers, with their place."""
    return prefixes(messages, key, order).join(shown.select(key, "from_place"), key).where("place >= from_place").drop("from_place", "prefix_digest")


def by_length(summary: str, batch: list[dict]) -> str:
    """A stand-in for a model: roles and lengths of what was summarised, after what was before."""
    return (summary + " " + json.dumps([[m["role"], len(m["content"])] for m in batch], separators=(",", ":"))).strip()
