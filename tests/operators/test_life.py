from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from colloquy.operators import intervals, life

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
NOON = 1704110400000  # 2024-01-01 12:00


def test_first_interval_against_all_pairs(spark):
    rng = random.Random(2)
    spans = [(k, rng.choice("ab"), s := rng.randrange(10**10), s + rng.choice((-5, 0, 1, 30_000, HOUR, 17 * DAY, 900 * DAY, 9000 * DAY))) for k in range(200)] + [(900, "a", None, 5), (901, None, 0, 10**12)]
    points = [(k, rng.choice("abc"), rng.choice((rng.randrange(10**10), *(x[2] or 0 for x in spans[:30]), *(x[3] for x in spans[:30])))) for k in range(400)] + [(1000, "a", None), (1001, None, 5)]
    p = spark.createDataFrame(points, "id int, key string, at long")
    i = spark.createDataFrame(spans, "place int, key string, lo long, hi long")
    plan = intervals.first_interval(p, i, "key", "id", "at", "lo", "hi", ["place"])
    got = {r.id: (r.place, r.lo, r.hi) for r in plan.collect()}
    want = {}
    for k, key, at in points:
        fits = [(n, lo, hi) for n, c, lo, hi in spans if key is not None and c == key and at is not None and lo is not None and lo <= at <= hi]
        want[k] = min(fits, default=(None, None, None))
    assert got == want and sum(v[0] is not None for v in got.values()) > 50
    shown = plan._jdf.queryExecution().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_unions_of_intervals(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 2, 2), ("a", 7, 9), ("a", 9, 8), ("b", 0, 100), ("b", 5, 6), ("b", 50, 101)], "k string, lo long, hi long")
    assert sorted(map(tuple, intervals.merged_intervals(rows, "k", "lo", "hi").collect())) == [("a", 1, 5, 3), ("a", 7, 9, 1), ("b", 0, 101, 3)]


def item(**change):
    return {"id": "e1", "from": "2024-01-01 10:00", "to": "2024-01-01T12:00", "activity": "walk", "availability": " Busy ", "topic": "parks"} | change


def test_plans_are_validated_item_by_item(spark):
    items = [item(), item(id="e2", to="2024-01-01 12:30:00"), "noise", item(id=" "), item(id=5), item(topic=None), item(**{"from": "ten"}), item(id="e3", availability="flying", activity="x" * 200), {}, item(id="e4", to="2024-01-02")]
    frame = spark.createDataFrame([("p", json.dumps(items)), ("many", json.dumps([item(id=str(k)) for k in range(20)])), ("no", "{}")], "key string, j string")
    plans = frame.select("key", life.daily_plan(F.try_variant_get(F.try_parse_json("j"), "$", "array<variant>")).alias("plan"))
    got = {r["key"]: r.plan for r in plans.collect()}
    assert [(x["id"], x["availability"], len(x["activity"])) for x in got["p"]] == [("e1", "busy", 4), ("e2", "busy", 4), ("e3", "available", 80), ("e4", "busy", 4)]
    assert [x["id"] for x in got["many"]] == [str(k) for k in range(12)] and got["no"] == []
    points = spark.createDataFrame([(k, "p", at) for k, at in enumerate((NOON - 2 * HOUR, NOON, NOON + 30 * MINUTE, NOON + 31 * MINUTE, NOON - 3 * HOUR, NOON + 12 * HOUR + 1))], "n int, key string, at long")
    found = {r.n: r.plan_id for r in life.planned(points, life.plan_rows(plans, "key"), "key", "n", "at").collect()}
    assert found == {0: "e1", 1: "e1", 2: "e2", 3: "e4", 4: None, 5: None}


def due(spark, rows, interval=60, samples=0, wake=8, sleep=23):
    schema = "n int, now_ms long, current struct<updated_at:string,next_update_at:string>, text string, trigger string, before string"
    frame = spark.createDataFrame(rows, schema)
    d = life.update_due(F.col("now_ms"), F.col("current"), F.col("text"), F.col("trigger"), F.col("before"), interval, F.lit(wake), F.lit(sleep), F.lit(samples))
    return {r.n: r.d for r in frame.select("n", d.alias("d")).collect()}


def test_when_a_state_is_decided_anew(spark):
    fresh = ("2024-01-01T11:30:00", "2024-01-01 13:00")
    night = NOON + 11 * HOUR
    late = ("2024-01-01T22:30:00", "2024-01-02 01:00")
    got = due(spark, [
        (0, NOON, None, "", "", "available"), (1, NOON, fresh, "", "proactive", "available"), (2, NOON, fresh, "", "proactive:manual", "available"), (3, NOON, ("2024-01-01T11:00:00", fresh[1]), "", "", "available"), (4, NOON, ("never", fresh[1]), "", "", "available"),
        (5, NOON, ("", fresh[1]), "hello", "", "available"), (6, NOON, (fresh[0], "2024-01-01 12:00"), "", "", "available"), (7, NOON, (fresh[0], "soon"), "", "", "available"), (8, NOON, fresh, " ", "", "sleeping"), (9, NOON, fresh, "x", "", "sleeping"),
        (10, NOON, fresh, "Are you AWAKE?", None, "available"), (11, NOON, fresh, "I can’t sleep", "", "available"), (12, night, late, "I can’t sleep", "", "available"), (13, night, late, "fine", "", "available"), (14, NOON, fresh, None, None, None),
    ])
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True, 10: True, 11: False, 12: True, 13: False, 14: False}
    # for one who sleeps by day, noon is night; without an interval nothing is old
    assert due(spark, [(0, NOON, fresh, "失眠", "", "busy")], samples=50, wake=18, sleep=4)[0]
    assert not due(spark, [(0, NOON, ("2023-01-01T11:00:00", fresh[1]), "", "", "busy")], interval=0)[0]


def test_decisions_are_applied(spark):
    answers = {
        0: {"current_activity": " reading  a book ", "availability": "busy", "next_update_at": "2024-01-01 14:00", "reply_delay_seconds": "90.7", "reason": "r", "daily_plan": [item(), "x"]},
        1: {"current_activity": "half-awake", "availability": "sleeping", "next_update_at": "2024-01-01 20:00", "mood": "m", "reply_delay_seconds": 99999, "reply_delay_reason": "d", "reason": "r"},
        2: {"availability": "sleeping"}, 3: {"apply": False, "mood": "m"}, 4: "no answer", 5: {"next_update_at": "2024-01-01 12:01", "current_event_id": "own"}, 6: {"next_update_at": "2024-03-01 12:01", "apply": "false"},
    }
    rows = spark.createDataFrame([(k, NOON, "```json\n" + json.dumps(v) + "\n```", ("old", "soup", "calm", "tea", ""), "plan1") for k, v in answers.items()], "n int, now_ms long, answer string, before struct<activity:string,meal:string,mood:string,topic:string,event_id:string>, plan_id string")
    done = life.applied(rows.withColumn("patch", life.decision(F.col("answer"))), max_delay=3600)
    got = {r.n: r for r in done.collect()}
    a = got[0].state
    assert (a.activity, a.meal, a.availability, a.next_update_at, a.reply_delay_seconds, a.reply_delay_reason, a.event_id, a.time_slot, a.updated_at) == ("reading a book", "soup", "busy", "2024-01-01 14:00", 90, "r", "plan1", "noon", "2024-01-01T12:00:00")
    assert [x["id"] for x in got[0].patch.plan] == ["e1"]
    assert (got[1].state.next_update_at, got[1].state.reply_delay_seconds, got[1].state.reply_delay_reason, got[1].state.mood) == ("2024-01-01 12:25", 3600, "d", "m")
    assert got[2].state.next_update_at == "2024-01-01 22:00" and got[3].state is None and got[4].state is None
    assert (got[5].state.next_update_at, got[5].state.event_id) == ("2024-01-01 12:10", "own") and got[6].state.next_update_at == "2024-01-01 22:00"


def test_timelines_and_habits(spark):
    states = spark.createDataFrame([("a", k) for k in range(100)] + [("b", 5)], "key string, at long")
    got = life.timeline(states, "key", "at").collect()
    assert sorted((r["key"], r.at, r.place) for r in got) == [("a", k, k - 19) for k in range(20, 100)] + [("b", 5, 1)]
    items = spark.createDataFrame([("o", "friend", f"c{k}", 0.4 + k / 20, k == 3) for k in range(10)] + [("o", "self", "x", 0.9, False), ("o", "friend", " ", 0.9, False), ("o", "friend", "n", 0.95, None)], "owner string, subject string, claim string, confidence double, sensitive boolean")
    assert [r.claim for r in life.habit_candidates(items).orderBy("place").collect()] == ["n", "c9", "c8", "c7", "c6", "c5"]
    told = items.withColumn("target_fields", F.when(F.col("claim") == "c9", F.array(F.lit("recent_meal"))))
    assert [r.claim for r in life.habit_candidates(told).collect()] == ["c9"]
