"""Write-behind of conversation turns, as a stateful stream and as a batch.

Turns wait in a buffer of their conversation, which is written when it holds
``max_turns``, or when no turn came for ``idle_seconds``. Time is the turns' own
(``enqueued_at``), so a replay gives the same batches: where the service that this
models looks at the clock, the stream looks at its watermark.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..functions.lexicons import PROACTIVE_MARKERS

MAX_TURNS, IDLE_SECONDS = 8, 300
_OUT = "conversation_id string, batch_no long, place int, turn_id string, enqueued_at timestamp"


def write_behind(turns: DataFrame, max_turns: int = MAX_TURNS, idle_seconds: int = IDLE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Flushed turns of a stream with the number of their batch and their place in it.

    ``turns`` has conversation_id, turn_id and enqueued_at (timestamp). The state of a
    conversation is its buffer, at most ``max_turns`` ids, and the number of the next batch.
    """

    def flush(key, pdfs, state):
        number, held = state.get if state.exists else (0, "[]")
        held = json.loads(held)
        out = []

        def close():
            nonlocal number, held
            out.extend((key[0], number, i, t, pd.Timestamp(ms, unit="ms")) for i, (t, ms) in enumerate(held))
            number, held = number + 1, []

        if state.hasTimedOut:
            if held:
                close()
        else:
            frame = pd.concat(list(pdfs)).sort_values(["enqueued_at", "turn_id"], kind="stable")
            for t, at in zip(frame["turn_id"], frame["enqueued_at"]):
                ms = at.value // 1_000_000
                if held and ms - held[-1][1] >= idle_seconds * 1000:
                    close()
                held.append((t, ms))
                if len(held) >= max_turns:
                    close()
        state.update((number, json.dumps(held)))
        if held:
            state.setTimeoutTimestamp(max(held[-1][1] + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conversation_id", "batch_no", "place", "turn_id", "enqueued_at"])

    ready = turns.withWatermark("enqueued_at", late).select("conversation_id", "turn_id", "enqueued_at")
    return ready.groupBy("conversation_id").applyInPandasWithState(flush, _OUT, "number long, held string", "append", "EventTimeTimeout")


def drained(turns: DataFrame, max_turns: int = MAX_TURNS, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """What :func:`write_behind` has flushed once the stream ends and every buffer is drained."""
    w = Window.partitionBy("conversation_id").orderBy("enqueued_at", "turn_id")
    ms = F.unix_millis("enqueued_at")
    pause = F.coalesce(ms - F.lag(ms).over(w) >= idle_seconds * 1000, F.lit(False))
    rows = turns.withColumn("_run", F.sum(pause.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("conversation_id", "_run").orderBy("enqueued_at", "turn_id")) - 1)
    begins = (F.col("_i") % max_turns == 0).cast("long")
    numbered = rows.withColumn("batch_no", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.select("conversation_id", "batch_no", (F.col("_i") % max_turns).alias("place"), "turn_id", "enqueued_at")


def turn_rows(turns: DataFrame, created_ms: Column) -> DataFrame:
    """Rows to store for each turn: what the user said, then what was answered.

    Markers of turns that the assistant began aren't the user's words. Ids derive from
    the turn, so that a turn that is written twice is stored once.
    """
    user, answer = strip(F.coalesce("user_text", F.lit(""))), strip(F.coalesce("assistant_text", F.lit("")))

    def row(side: str, text: Column, role: str, source: str, trust: float, kept: Column, attached: Column) -> Column:
        name = F.concat(F.lit(f"live-{side}-"), F.substring(F.sha1(F.concat_ws("|", "conversation_id", "turn_id", F.lit(role))), 1, 16))
        return F.when(kept, F.struct(name.alias("id"), text.alias("text"), F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit(trust).alias("trust_level"), attached.alias("attachments")))

    none = F.array().cast("array<string>")
    both = F.array(
        row("u", user, "user", "user_new", 0.65, (user != "") & ~user.isin(*PROACTIVE_MARKERS), F.coalesce("user_image_shas", none)),
        row("a", answer, "assistant", "ai_generated", 0.15, answer != "", none),
    )
    rows = turns.select("conversation_id", created_ms.alias("_ms"), F.posexplode(F.filter(both, lambda x: x.isNotNull())).alias("_i", "_r"))
    return rows.select("conversation_id", "_r.*", F.lit(True).alias("confirmed"), F.lit(False).alias("deleted"), (F.col("_ms") + F.col("_i")).alias("created_at_ms"))
