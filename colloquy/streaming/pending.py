"""Inputs that wait for an answer, and a buffer of bounded size: state machines over events in their order.

A stream's rows come in any order within the watermark's delay. They wait in the state of
their key until the watermark has passed them, and are then applied by time, so a stream
gives what the batch form gives over the same rows. Machines keep plain values only,
which the state stores as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE_SECONDS, MAX_TURNS, BUFFER_TURNS = 300, 8, 1000


class PendingInput:
    """What a caller said that isn't answered, and which answer is being made.

    Each input begins a new generation, which outdates an answer in work, and is answered
    together with all that waits. ``ack`` settles the inputs its generation began with, if it
    is still the current one; ``cancel`` ends it and leaves the inputs; ``update`` changes
    the text of its newest input; ``discard`` drops the inputs of the given ids, or all, and
    ends the generation if all it answers are among them. A message id counts once.
    """

    columns = ("kind", "ok", "generation", "pending", "n_pending", "outdated")
    schema = "kind string, ok boolean, generation long, pending string, n_pending long, outdated long"
    needs = ("kind", "message_id", "text", "generation", "message_ids")

    def __init__(self, saved: dict | None = None):
        self.s = saved or {"queue": [], "generation": 0, "active": None, "ids": [], "newest": None}

    def deadline(self) -> int | None:
        return None

    def tick(self, now_ms: int):
        yield from ()

    def apply(self, at_ms: int, e: dict):
        s, outdated = self.s, None
        current = s["active"] is not None and e["generation"] == s["active"]
        if e["kind"] == "input":
            ok, outdated = True, s["active"]
            if all(m != e["message_id"] for m, _ in s["queue"]):
                s["queue"].append([e["message_id"], e["text"] or ""])
            s["generation"] += 1
            s |= {"active": s["generation"], "ids": [m for m, _ in s["queue"]], "newest": e["message_id"]}
        elif e["kind"] == "update":
            ok = current and any(m == s["newest"] for m, _ in s["queue"])
            if ok:
                s["queue"] = [[m, e["text"] or "" if m == s["newest"] else t] for m, t in s["queue"]]
        elif e["kind"] == "ack":
            ok = current
            if ok:
                s["queue"] = [x for x in s["queue"] if x[0] not in s["ids"]]
                s["active"] = None
        elif e["kind"] == "cancel":
            ok = current
            if ok:
                outdated, s["active"] = s["active"], None
        elif e["kind"] == "discard":
            wanted = [m for m in e["message_ids"] if m] if e["message_ids"] is not None else []
            rest = [x for x in s["queue"] if wanted and x[0] not in wanted]
            ok = len(rest) < len(s["queue"])
            s["queue"] = rest
            if s["active"] is not None and (not wanted or (s["ids"] and set(s["ids"]) <= set(wanted))):
                outdated, s["active"] = s["active"], None
        else:
            ok = False
        text = "\n\n".join(t.strip() for _, t in s["queue"] if t.strip())
        yield at_ms, (e["kind"], ok, s["generation"], text, len(s["queue"]), outdated)

    def drain(self):
        yield from ()


class BoundedBuffer:
    """Turns of several conversations in one buffer, written in batches of a conversation.

    A conversation's turns are written when there are ``max_turns``, or when none came for
    ``idle_seconds``. A turn that finds ``size`` waiting is dropped, and comes out as such.
    """

    columns = ("conversation_id", "batch_no", "place", "turn_id", "dropped")
    schema = "conversation_id string, batch_no long, place int, turn_id string, dropped boolean"
    needs = ("conversation_id", "turn_id")

    def __init__(self, saved: dict | None = None, size: int = BUFFER_TURNS, max_turns: int = MAX_TURNS, idle_seconds: int = IDLE_SECONDS):
        self.s, self.size, self.most, self.idle = saved or {"held": {}, "numbers": {}, "total": 0}, size, max_turns, idle_seconds * 1000

    def deadline(self) -> int | None:
        return min((turns[-1][1] + self.idle for turns in self.s["held"].values()), default=None)

    def _flush(self, conversation: str):
        turns, n = self.s["held"].pop(conversation), self.s["numbers"].get(conversation, 0)
        self.s["numbers"][conversation], self.s["total"] = n + 1, self.s["total"] - len(turns)
        for place, (turn, at_ms) in enumerate(turns):
            yield at_ms, (conversation, n, place, turn, False)

    def tick(self, now_ms: int):
        """What has been idle long enough at a time, the longest first."""
        idle = sorted((turns[-1][1], c) for c, turns in self.s["held"].items() if turns[-1][1] + self.idle <= now_ms)
        for _, c in idle:
            yield from self._flush(c)

    def apply(self, at_ms: int, e: dict):
        yield from self.tick(at_ms)
        if self.s["total"] >= self.size:
            yield at_ms, (e["conversation_id"], None, None, e["turn_id"], True)
            return
        held = self.s["held"].setdefault(e["conversation_id"], [])
        held.append([e["turn_id"], at_ms])
        self.s["total"] += 1
        if len(held) >= self.most:
            yield from self._flush(e["conversation_id"])

    def drain(self):
        for c in sorted(self.s["held"]):
            yield from self._flush(c)


def _frame(key, out: list, names: Sequence[str], key_name: str, at: str) -> pd.DataFrame:
    rows = [(key, pd.Timestamp(ms, unit="ms"), *row) for ms, row in out]
    frame = pd.DataFrame(rows, columns=[key_name, at, *names])
    # integers with nulls
    return frame.astype({c: "Int64" for c in ("batch_no", "generation", "outdated", "n_pending") if c in frame} | ({"place": "Int32"} if "place" in frame else {}))


def streamed(events: DataFrame, machine, key: str, at: str, order: str, late: str = "0 seconds", **options) -> DataFrame:
    """What a machine says to a stream's events, each key's in order of ``at`` and ``order``; key, at and its columns."""

    def run(k, parts, state):
        saved = json.loads(state.get[0]) if state.exists else {"held": [], "machine": None}
        m, held = machine(saved["machine"], **options), saved["held"]
        if not state.hasTimedOut:
            for part in parts:
                for r in part.to_dict("records"):
                    held.append([int(r[at].value // 1_000_000), _plain(r[order]), {c: _plain(r[c]) for c in machine.needs}])
        passed = state.getCurrentWatermarkMs()
        held.sort(key=lambda x: (x[0], x[1]))
        n = next((i for i, x in enumerate(held) if x[0] > passed), len(held))
        out = [y for at_ms, _, e in held[:n] for y in m.apply(at_ms, e)]
        held = held[n:]
        out += m.tick(passed)
        state.update((json.dumps({"held": held, "machine": m.s}),))
        due = [x for x in (held[0][0] if held else None, m.deadline()) if x is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due), passed + 1))
        yield _frame(k[0], out, machine.columns, key, at)

    rows = events.withWatermark(at, late).select(key, at, *dict.fromkeys([order, *machine.needs]))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, {at} timestamp, {machine.schema}", "saved string", "append", "EventTimeTimeout")


def _plain(value):
    """A value that JSON can hold."""
    if value is None or isinstance(value, str):
        return value
    if hasattr(value, "tolist"):
        return value.tolist()
    return None if value != value else value


def settled(events: DataFrame, machine, key: str, at: str, order: str, drain: bool = True, **options) -> DataFrame:
    """The batch form of :func:`streamed`, with what is left written at the end."""
    rows = events.select(key, at, *dict.fromkeys([order, *machine.needs])).repartition(key).sortWithinPartitions(key, at, order)

    def run(parts):
        last, m = None, None
        for part in parts:
            out = []
            for r in part.to_pylist():
                if m is None or r[key] != last:
                    if m is not None and drain:
                        out += [(last, y) for y in m.drain()]
                    last, m = r[key], machine(None, **options)
                at_ms = int(pd.Timestamp(r[at]).value // 1_000_000)
                out += [(r[key], y) for y in m.apply(at_ms, {c: r[c] for c in machine.needs})]
            yield from batches(out)
        if m is not None and drain:
            yield from batches([(last, y) for y in m.drain()])

    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}
    types = [pa.string(), pa.timestamp("us", tz="UTC"), *(kinds[c.split()[1]] for c in machine.schema.split(", "))]

    def batches(out):
        if out:
            columns = zip(*((k, ms * 1000, *row) for k, (ms, row) in out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, at, *machine.columns])

    return rows.mapInArrow(run, f"{key} string, {at} timestamp, {machine.schema}")


def dropped(rows: DataFrame, key: str) -> DataFrame:
    """Turns that were written and dropped, by buffer."""
    return rows.groupBy(key).agg(F.count_if(~F.col("dropped")).alias("written"), F.count_if("dropped").alias("dropped"))
