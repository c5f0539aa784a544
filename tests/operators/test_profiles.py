from __future__ import annotations

import random

from pyspark.sql import functions as F

from colloquy.operators import profiles as P
from colloquy.operators import sequence

HOUR, DAY = 3_600_000, 86_400_000
START = 1704067200000  # a Monday at 0 o'clock
MESSAGES = "source string, message_id string, seq long, timestamp_ms long, role string, kind string, text string"


def talk(seed=1, n=60):
    rng, at, rows = random.Random(seed), START, []
    words = ["good morning", "吃了吗", "are you okay, you look tired", "我刚到家，好累", "nothing", "晚安", "[图片]", "what about tomorrow?", "hi", "x" * 100]
    for s in range(n):
        at += rng.choice((40 * 60_000, 3 * HOUR, 9 * HOUR, 2 * DAY))
        for k in range(rng.randint(1, 9)):
            rows.append(("s", f"{s}-{k}", len(rows), at, rng.choice(("self", "friend")), "text", rng.choice(words)))
            at += 60_000
    return rows


def test_lines_are_read_back(spark):
    text = "Ann: hi: there\r\nMe：ok\nno colon\n Bob : x\nTA:\n"
    (row,) = spark.createDataFrame([(text,)], "t string").select(P.speaker_lines(F.col("t"), ["Ann"], ["Bea"]).alias("x")).collect()
    assert [tuple(x) for x in row.x] == [("friend", "hi: there"), ("self", "ok"), ("other", "x"), ("friend", "")]
    (row,) = spark.range(1).select(P.timed_line(F.lit(START), F.lit("friend"), F.lit("hi"), "Asia/Shanghai")).collect()
    assert row[0] == "[2024-01-01 08:00] friend: hi"


def plain_profile(rows, gap):
    """Openings of sessions after a pause, counted by hand."""
    sessions = {}
    for r in rows:
        sessions.setdefault(r[1].split("-")[0], []).append(r)
    sessions = list(sessions.values())
    usable = lambda t: t.strip() and t != "[图片]"
    hours, speakers, own = {}, {}, 0
    for a, b in zip(sessions, sessions[1:]):
        human = [r for r in b if usable(r[6])]
        if (b[0][3] - a[-1][3]) // 60_000 < gap or not human:
            continue
        if human[0][4] == "self":
            own += 1
            continue
        h = human[0][3] // HOUR % 24
        hours[h] = hours.get(h, 0) + 1
        before = [r for r in a if usable(r[6])]
        who = before[-1][4] if before else "unknown"
        speakers[who] = speakers.get(who, 0) + 1
    peak, top = max(hours.values()), max(speakers.values())
    return sum(hours.values()), own, len(sessions), [round((hours.get(h, 0) + 1) / (peak + 1), 3) for h in range(24)], {k: round((speakers.get(k, 0) + 1) / (top + 1), 3) for k in P.SPEAKERS}


def test_profile_of_messages_and_of_their_windows(spark):
    rows = talk()
    sessions = sequence.sessionize(spark.createDataFrame(rows, MESSAGES), 30)
    (got,) = P.profile_of_messages(sessions).collect()
    want = plain_profile(rows, 120)
    assert (got.sample_size, got.self_started_sessions, got.total_sessions, got.hour_weights, got.speaker_weights) == want and got.sample_size > 10
    assert len(got.samples) == 12 and [x.opened_ms for x in got.samples] == sorted((x.opened_ms for x in got.samples), reverse=True)
    assert max(len(x.opening) for x in got.samples) <= 80
    windows = sequence.window_chunks(sequence.sliding_windows(sessions, 4, 2)).withColumn("session_id", F.concat_ws("-", "source", F.lpad(F.col("session_no").cast("string"), 4, "0"))).drop("session_no")
    (again,) = P.profile_of_windows(windows, ["friend"], ["self"]).collect()
    # windows begin with the session and not with its first usable line: hours can differ, the rest can't
    same = ("sample_size", "self_started_sessions", "total_sessions", "idle_gap_weights", "speaker_weights")
    assert [again[c] for c in same] == [got[c] for c in same] and [x.opening for x in again.samples] == [x.opening for x in got.samples]


def test_profile_of_a_report_and_the_ladder(spark):
    openings = spark.createDataFrame([
        ("a", "friend", START, 200, "care", 3, 1, "are you okay", "tail"), ("a", "friend", START + 1, 100, "care", 3, 1, "x", ""), ("a", "friend", START + 2, 300, "other", 4, 1, "[图片]", ""), ("a", "self", START + 3, 500, "other", 5, 1, "y", ""), ("a", "friend", START + 4, None, "other", 5, 1, "y", ""),
    ], "source string, initiator string, opened_ms long, gap_minutes long, opening_type string, hour int, weekday int, opening string, previous_tail string")
    totals = spark.createDataFrame([("a", 7), ("b", 3), ("c", 2)], "source string, total_sessions long")
    report = P.profile_of_report(openings, totals)
    got = {r.source: r for r in report.collect()}
    assert (got["a"].sample_size, got["a"].self_started_sessions, got["a"].total_sessions) == (1, 1, 7) and got["a"].hour_weights[3] == 1.0 and got["a"].hour_weights[4] == 0.5 and got["a"].speaker_weights["unknown"] == 1.0
    assert got["b"].sample_size == 0 and set(got["b"].hour_weights) == {0.0} and got["b"].samples == []
    stored = report.where("source != 'a'").withColumn("sample_size", F.when(F.col("source") == "b", 9).otherwise(0).cast("long"))
    ladder = {r.source: (r.rung, r.sample_size) for r in P.first_with_samples(report, stored, report.where("source = 'd'")).collect()}
    assert ladder == {"a": (0, 1), "b": (1, 9), "c": (0, 0)}


def test_earliest_schedule(spark):
    rows = spark.createDataFrame([(0, 10.0, None), (0, 500.0, None), (0, None, None), (0, 119.9, 50_000_000), (0, 119.95, None)], "now long, idle double, quiet long")
    got = [r[0] for r in rows.select(P.earliest_schedule_ms(F.col("now"), F.col("idle"), F.col("quiet"), 60)).collect()]
    assert got == [6_600_000, 60_000, 60_000, 50_000_000, 60_000]


def quality(spark, rows, reasons=False):
    schema = "source string, initiator string, gap_minutes long, opening string, opening_type string" + ", reason string" * reasons
    (row,) = P.opening_quality(spark.createDataFrame(rows, schema)).collect()
    return row


def test_quality_metrics_and_issues(spark):
    fine = [("a", "friend", 200, f"how was the long day {k}", "question_probe") for k in range(30)]
    good = quality(spark, fine + [("a", "self", 500, "x", "other"), ("a", "friend", None, "x", "other"), ("a", "friend", 119, "x", "other")])
    assert (good.status, good.issues, good.fallback_risk, good.total_openings, good.eligible, good.specific_ratio) == ("ready", [], "low", 33, 30, 1.0)
    few = quality(spark, fine[:11])
    assert (few.status, few.issues, few.meaningful) == ("not_ready", ["too_few"], 11)
    some = quality(spark, fine[:20] + [("a", "friend", 200, "[图片] [回复 x]。", "other")] * 9)
    assert (some.status, some.issues, some.placeholder, some.placeholder_only, some.meaningful_ratio, some.fallback_risk) == ("limited", ["few", "low_information"], 9, 9, 0.6897, "high")
    poor = quality(spark, fine[:10] + [("a", "friend", 200, "…！", "other")] * 20)
    assert (poor.status, poor.issues, poor.placeholder_only) == ("not_ready", ["meaningless", "unclassified"], 0)
    vague = quality(spark, fine[:8] + [("a", "friend", 200, "嗯 [表情]", "short_ping")] * 22)
    assert (vague.status, vague.issues, vague.specific_ratio) == ("limited", ["placeholders", "unspecific"], 0.2667)
    long = quality(spark, fine[:8] + [("a", "friend", 200, "12345678", "short_ping")] * 22)
    assert long.issues == [] and long.specific == 30
    told = quality(spark, [(*r, "care" if k < 20 else None) for k, r in enumerate(fine)], True)
    assert (told.issues, told.attribution_ratio, told.status) == (["unattributed"], 0.6667, "limited")


def test_next_time_of_a_profile(spark):
    def weights(**by):
        return [by.get(f"h{k}", 0.1) for k in range(24)]

    monday = [0.0] * 7
    rows = spark.createDataFrame([
        (0, START + 60_000, weights(h5=1.0, h3=0.7), [1.0] * 7), (1, START + 60_000, weights(h5=1.0, h3=0.8), [1.0] * 7), (2, START, [0.0] * 24, [1.0] * 7), (3, START, weights(h5=1.0), monday), (4, START, weights(h1=0.3), [1.0] * 7), (5, START + 6 * HOUR, weights(h5=1.0), [0.5, 0.0] + [1.0] * 5),
    ], "n int, at long, hours array<double>, days array<double>")
    got = {r.n: r.t - START for r in rows.select("n", P.next_profile_ms(F.col("at"), F.col("hours"), F.col("days")).alias("t")).collect()}
    # 0.7 is below three quarters of the peak; 0.3 is below 0.45; on Tuesday nobody writes, and Wednesday is too far
    assert got == {0: 5 * HOUR + 60_000, 1: 3 * HOUR + 60_000, 2: 0, 3: 0, 4: 0, 5: 6 * HOUR}
