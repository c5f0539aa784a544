"""Steps that depend on what the step before decided.

Rows are dealt by key and sorted, and a task folds them in that order from Arrow
batches. Only the state of the open bin is carried between batches, so a source
of any length needs the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that begin a new topic
TOPIC_MARKERS = ("对了", "话说", "突然想起", "还有个事", "另一个事", "说起来", "换个话题", "顺便", "不过", "但是", "然后呢")


def _runs(keys: pa.Array) -> Iterator[tuple[int, int, object]]:
    """(begin, end, value) of runs of equal keys."""
    if not len(keys):
        return
    one = pc.run_end_encode(keys)
    at = 0
    for end, value in zip(one.run_ends.to_pylist(), one.values.to_pylist()):
        yield at, end, value
        at = end


def _folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold, new: str) -> DataFrame:
    """``rows`` with a column ``new`` of bin numbers that ``fold`` gives to sorted batches."""
    ready = rows.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).repartition(*keys).sortWithinPartitions("_key", *order)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    names = [f.name for f in rows.schema.fields]

    def run(batches):
        state: dict = {}
        for batch in batches:
            bins = np.zeros(batch.num_rows, np.int64)
            for lo, hi, key in _runs(batch.column("_key")):
                if state.get("key", state) != key:
                    state = {"key": key, "bin": 0}
                fold(batch.slice(lo, hi - lo), state, bins[lo:hi])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(bins)], names=[*names, new])

    return ready.mapInArrow(run, ", ".join([*fields, f"{new} long"]))


def next_fit(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: int, new: str) -> DataFrame:
    """``rows`` with the number of their bin within ``keys``.

    A bin closes before the row that would bring it over ``budget``; a dearer row is
    a bin of its own. Costs are whole numbers from 0.
    """

    def fold(part: pa.RecordBatch, state: dict, bins: np.ndarray) -> None:
        total = np.cumsum(part.column(cost).to_numpy(zero_copy_only=False).astype(np.int64))
        used, at, opened = state.get("used", 0), 0, state.get("opened", False)
        while at < len(total):
            before = total[at - 1] if at else 0
            n = int(np.searchsorted(total, before + budget - used, side="right")) - at
            if not n and not opened:
                n = 1
            bins[at : at + n] = state["bin"]
            if n:
                used, opened, at = used + int(total[at + n - 1] - before), True, at + n
            if at < len(total):
                used, opened, state["bin"] = 0, False, state["bin"] + 1
        state |= {"used": used, "opened": opened}

    return _folded(rows, keys, order, fold, new)


def pack_blocks(messages: DataFrame, budget: int, key: str = "source") -> DataFrame:
    """Messages of each key in blocks of at most ``budget`` symbols, a line costing its length and one.

    Returns key, block_no, start_ms, end_ms, n_messages and n_chars.
    """
    lines = messages.select(key, "timestamp_ms", "seq", (F.length(F.coalesce("text", F.lit(""))) + 1).alias("cost"))
    packed = next_fit(lines, [key], ["timestamp_ms", "seq"], "cost", budget, "block_no")
    return packed.groupBy(key, "block_no").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("n_messages"), F.sum("cost").cast("long").alias("n_chars"))


def analysis_blocks(sessions: DataFrame, budget: int, line: Column, key: str = "source") -> DataFrame:
    """Consecutive sessions in blocks by their rendered length; long sessions are split between messages.

    ``sessions`` has key, session_no, timestamp_ms, seq. First each session is packed
    by lines (length and one), then its parts by the length of their text. Returns
    key, block_id, start_ms, end_ms, sessions, n_messages and text.
    """
    budget = max(1000, budget)
    order = ["timestamp_ms", "seq"]
    lines = sessions.select(key, "session_no", *order, line.alias("line")).withColumn("cost", F.length("line") + 1)
    parts = next_fit(lines, [key, "session_no"], order, "cost", budget, "part")
    item = F.struct(*order, "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n")
    units = parts.groupBy(key, "session_no", "part").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("n"), text.alias("text"))
    units = next_fit(units.withColumn("cost", F.length("text")), [key], ["session_no", "part"], "cost", budget, "block_no")
    unit = F.struct("session_no", "part", "text")
    blocks = units.groupBy(key, "block_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_set("session_no")).alias("sessions"), F.sum("n").alias("n_messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["text"]), "\n\n").alias("text"),
    )
    name = F.concat(F.lit("blk-"), F.substring(F.sha2(F.concat_ws("\n", "start_ms", "end_ms", "text"), 256), 1, 20))
    return blocks.select(key, name.alias("block_id"), "start_ms", "end_ms", "sessions", "n_messages", "text")


def turn_batches(turns: DataFrame, most: int, key: str = "session_key") -> DataFrame:
    """Turns with the number of their batch of at most ``most`` messages; a turn is never split.

    ``turns`` has key, turn_no and n_messages.
    """
    rows = turns.withColumn("_cost", F.greatest(F.lit(1), "n_messages"))
    return next_fit(rows, [key], ["turn_no"], "_cost", max(1, most), "batch_no").drop("_cost")


def segment_turns(turns: DataFrame, target: int, most: int, min_turns: int, soft_gap_minutes: float, key: str = "session_key") -> DataFrame:
    """Turns with the number of their segment.

    ``turns`` has key, turn_no, start_ms, end_ms, chars and, if markers count, text. A
    segment of ``min_turns`` closes before a turn after a pause of ``soft_gap_minutes``, or
    before one with a topic marker once it has half of ``target`` characters. It closes
    after a turn that brings it to ``most`` characters, or to ``target`` with ``min_turns``.
    """
    target, min_turns = max(1, target), max(1, min_turns)
    most, pause = max(target, most), int(soft_gap_minutes * 60_000)
    marked = F.col("text").rlike("|".join(TOPIC_MARKERS)) if "text" in turns.columns else F.lit(False)
    rows = turns.withColumn("_mark", F.coalesce(marked, F.lit(False)))

    def fold(part: pa.RecordBatch, state: dict, bins: np.ndarray) -> None:
        size, count, last = state.get("size", 0), state.get("count", 0), state.get("last")
        start, end, chars, mark = (part.column(c).to_pylist() for c in ("start_ms", "end_ms", "chars", "_mark"))
        for i in range(len(bins)):
            if count >= min_turns and (start[i] - last >= pause or (size >= target // 2 and mark[i])):
                size, count, state["bin"] = 0, 0, state["bin"] + 1
            bins[i] = state["bin"]
            size, count, last = size + max(1, chars[i] or 0), count + 1, end[i]
            if size >= most or (size >= target and count >= min_turns):
                size, count, state["bin"] = 0, 0, state["bin"] + 1
        state |= {"size": size, "count": count, "last": last}

    return _folded(rows, [key], ["turn_no"], fold, "segment_no").drop("_mark")


def adaptive_segments(turns: DataFrame, target: int, most: int, min_turns: int, soft_gap_minutes: float, key: str = "session_key") -> DataFrame:
    """Bounds of the segments of :func:`segment_turns`."""
    rows = segment_turns(turns, target, most, min_turns, soft_gap_minutes, key)
    return rows.groupBy(key, "segment_no").agg(F.min("turn_no").alias("start_turn"), F.max("turn_no").alias("end_turn"), F.count("*").alias("n_turns"), F.sum(F.greatest(F.lit(1), "chars")).cast("long").alias("chars"))


def with_overlap(segments: DataFrame, turns: int) -> DataFrame:
    """Segments that begin ``turns`` turns earlier, within their session."""
    return segments.withColumn("start_turn", F.greatest(F.lit(0).cast("long"), F.col("start_turn") - turns))


def cover(segments: DataFrame, n_turns: str = "n_turns", key: str = "session_key") -> DataFrame:
    """Proposed segments made an exact partition of turns 0 to ``n_turns`` - 1.

    Bounds are clamped, a segment begins after what is covered before it, those that
    are covered wholly go, and gaps become segments. ``segments`` has key, start_turn,
    end_turn and n_turns; a session without proposals has one row with null bounds.
    """
    top = F.col(n_turns) - 1
    start = F.when(F.col("start_turn").isNotNull(), F.greatest(F.lit(0), F.least("start_turn", top)))
    rows = segments.where(F.col(n_turns) > 0).select(key, F.col(n_turns).alias("n"), start.alias("s"), F.greatest(start, F.least("end_turn", top)).alias("e"))
    # the state is what has been covered: the largest end so far
    item = F.struct("s", "e")
    state = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        pair = lambda a, b: F.struct(a.cast("long").alias("s"), b.cast("long").alias("e"))
        gap = F.when(x["s"] > acc["next"], F.array(pair(acc["next"], x["s"] - 1))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
        own = F.array(pair(F.greatest(x["s"], acc["next"]), x["e"]))
        return F.when(x["e"] < acc["next"], acc).otherwise(F.struct((x["e"] + 1).cast("long").alias("next"), F.concat(acc["out"], gap, own).alias("out")))

    folded = rows.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), item))).alias("items")).withColumn("r", F.aggregate("items", state, step))
    tail = F.when(F.col("r.next") < F.col("n"), F.array(F.struct(F.col("r.next").alias("s"), (F.col("n") - 1).cast("long").alias("e")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
    return folded.select(key, F.posexplode(F.concat("r.out", tail)).alias("segment_no", "x")).select(key, F.col("segment_no").cast("long").alias("segment_no"), F.col("x.s").alias("start_turn"), F.col("x.e").alias("end_turn"))
