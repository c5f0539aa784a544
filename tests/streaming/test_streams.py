from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from colloquy.streaming import activity, writeback

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def streamed(spark, tmp_path, parts, schema, name):
    """A stream of one file for each part, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")


def run(stream, spark, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_write_behind_equals_the_drained_batch(spark, tmp_path):
    rng = random.Random(1)
    at, rows = 0, []
    for i in range(120):
        at += rng.choice([1, 5, 40, 200, 299, 300, 700])
        rows.append((rng.choice("ab"), f"t{i:03}", START + timedelta(seconds=at)))
    last = [("z", "end", START + timedelta(seconds=at + 5000))]
    schema = "conversation_id string, turn_id string, enqueued_at timestamp"
    parts = [rows[:40], rows[40:80], rows[80:], last]
    got = run(writeback.write_behind(streamed(spark, tmp_path, parts, schema, "turns")), spark, tmp_path, "flushed").where("conversation_id != 'z'").collect()
    want = writeback.drained(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({(r.conversation_id, r.batch_no) for r in want}) > 8
    assert max(r.place for r in want) <= 7


def test_turns_become_rows(spark):
    rows = [("k", "1", " hi ", "yo", ["s"]), ("k", "2", "(AI 主动开启话题)", "hello", None), ("k", "3", "", " ", None)]
    frame = spark.createDataFrame(rows, "conversation_id string, turn_id string, user_text string, assistant_text string, user_image_shas array<string>")
    got = writeback.turn_rows(frame, F.lit(100).cast("long")).collect()
    assert sorted((r.text, r.role, r.source, r.trust_level, r.created_at_ms, tuple(r.attachments)) for r in got) == [("hello", "assistant", "ai_generated", 0.15, 100, ()), ("hi", "user", "user_new", 0.65, 100, ("s",)), ("yo", "assistant", "ai_generated", 0.15, 101, ())]
    assert len({r.id for r in got}) == 3


def test_sessions_of_a_stream(spark, tmp_path):
    minutes = [0, 10, 40, 71, 200]
    rows = [("s", START + timedelta(minutes=m), "friend" if m else "self") for m in minutes] + [("z", START + timedelta(days=2), "self")]
    stream = streamed(spark, tmp_path, [rows[:3], rows[3:5], rows[5:]], "source string, at timestamp, role string", "messages")
    got = run(activity.stream_sessions(stream), spark, tmp_path, "sessions").where("source = 's'").orderBy("start_at").collect()
    assert [(r.n_messages, r.n_friend) for r in got] == [(3, 2), (1, 1), (1, 1)]


def test_poll_follows_activity(spark, tmp_path):
    events = [("k", 0, "poll", 0.9), ("k", 50, "poll", 0.9), ("k", 100, "poll", 0.9), ("k", 110, "activity", 0.0), ("k", 120, "poll", 0.9), ("k", 220, "poll", 0.1), ("k", 330, "poll", 0.9), ("k", 340, "finish", 320.0), ("k", 350, "gate", 0.0), ("k", 360, "poll", 0.9)]
    stream = streamed(spark, tmp_path, [events[:4], events[4:]], "conversation_id string, at_ms long, kind string, value double", "polls")
    got = run(activity.poll(stream, 100, 50, 0.5), spark, tmp_path, "answers").orderBy("at_ms").collect()
    assert [(r.at_ms, r.status) for r in got] == [(0, "scheduled"), (50, "scheduled"), (100, "ready"), (120, "cancelled"), (220, "skipped"), (330, "ready"), (350, "skipped"), (360, "scheduled")]
    assert [r.scheduled_ms for r in got] == [100, 100, 100, 220, 320, 320, None, 460]


def test_activity_pending_and_recent(spark, tmp_path):
    stream = streamed(spark, tmp_path, [[("k", 5), ("j", 1)], [("k", 3)]], "conversation_id string, at_ms long", "seen")
    assert {r.conversation_id: r.last_ms for r in run(activity.last_activity(stream), spark, tmp_path, "latest", "complete").collect()} == {"k": 5, "j": 1}
    events = spark.createDataFrame([("c", 1, "input", "1", "a"), ("c", 2, "ack", "x", None), ("c", 3, "input", "2", "b"), ("c", 4, "input", "2", "b"), ("c", 5, "input", "3", "d"), ("d", 1, "input", "9", "q"), ("d", 2, "discard", "y", None)], "caller string, at_ms long, kind string, message_id string, text string")
    assert {r.caller: (r.generation, r.pending, r.n_pending) for r in activity.coalesced_input(events).collect()} == {"c": (3, "b\nd", 2), "d": (1, "", 0)}
    messages = spark.createDataFrame([("c", f"k{i % 2}", f"{i:02}", i, str(i)) for i in range(30)], "caller string, conversation_id string, message_id string, at_ms long, text string")
    got = activity.recent_context(messages, 10, 12).where("conversation_id = 'k0'").orderBy("place").collect()
    # the caller's ten last and the conversation's ten last together, each once
    assert [r.at_ms for r in got] == sorted({*range(20, 30), *range(10, 30, 2)}, reverse=True)[:12]
    audit = spark.createDataFrame([("k", 86_400_000 + 5), ("k", 5), ("j", 7)], "conversation_id string, sent_ms long")
    limits = activity.send_limits(audit, spark.createDataFrame([("k", 86_400_000 + 9), ("j", 7)], "conversation_id string, last_ms long"), 86_400_000 + 50, 1)
    assert {r.conversation_id: (r.today, r.limit_reached, r.unanswered) for r in limits.collect()} == {"k": (1, True, False), "j": (0, False, True)}
    assert [r.sent_ms for r in activity.audit_tail(audit, 2).collect()] == [86_400_005, 7]
