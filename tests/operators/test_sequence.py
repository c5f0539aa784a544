from __future__ import annotations

import random

from pyspark.sql import functions as F

from colloquy.functions.cleaning import usable_text
from colloquy.operators import folds, sequence

SCHEMA = "message_id string, source string, session_no long, seq long, timestamp_ms long, role string, kind string, text string"


def chat(spark, rows):
    data = [(f"m{i}", "s", 0, i, i * 1000, role, kind, text) for i, (role, kind, text) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_response_pairs_leave_out_what_has_no_text(spark):
    rows = [
        ("self", "text", "a"), ("self", "recalled", "[撤回]"), ("friend", "text", "lost"), ("self", "text", "b"), ("self", "text", "c"), ("friend", "placeholder", "[图片]"), ("friend", "recalled", "[撤回]"),
        ("friend", "text", "x"), ("system", "system", "joined"), ("friend", "placeholder", "[图片] see"), ("friend", "text", "y"), ("friend", "text", "z"), ("self", "text", "d"), ("self", "text", " "), ("self", "text", "e"), ("friend", "text", "w"),
    ]
    got = sequence.response_pairs(chat(spark, rows), 3).orderBy("run_no").collect()
    assert [(r.user_text, r.friend_reply) for r in got] == [("b\n\nc", "x\n\n[图片] see\n\ny"), ("e", "w")]


def brute_context(texts, i, budget):
    out = []
    for side, limit in ((range(i - 1, -1, -1), budget), (range(i + 1, len(texts)), max(1, budget // 2))):
        used, took = 0, []
        for j in side:
            cost = len(texts[j].strip())
            if used and used + cost > limit:
                break
            took.append(j)
            used += cost
        out.append("\n".join(f"friend: {texts[j].strip()}" for j in sorted(took) if texts[j].strip()))
    return tuple(out)


def test_context_by_characters(spark):
    rng = random.Random(1)
    for budget in (1, 5, 12, 30):
        texts = ["x" * rng.choice([0, 0, 1, 3, 7, 20]) for _ in range(25)]
        got = sequence.budget_context(chat(spark, [("friend", "text", t) for t in texts]), budget).orderBy("seq").collect()
        assert [(r.context_before, r.context_after) for r in got] == [brute_context(texts, i, budget) for i in range(len(texts))]


def test_human_ends_and_openings(spark):
    rows = [("system", "system", "hi"), ("friend", "text", "[图片]"), ("friend", "text", "first"), ("friend", "recalled", "gone"), ("self", "text", "answer"), ("friend", "text", "more"), ("self", "text", "[语音]")]
    ends = sequence.human_ends(chat(spark, rows), usable_text(F.col("text"))).first()
    assert (ends.first_text, ends.last_text, ends.first_role) == ("first", "more", "friend")
    run = sequence.opening_runs(chat(spark, rows)).first()
    assert (run.initiator, run.opening, run.n_opening, run.response) == ("friend", "[图片]\nfirst\ngone", 3, "answer")


def test_even_sample_and_occurrence(spark):
    for n in (1, 2, 7, 10, 23):
        frame = spark.createDataFrame([("k", i, f"{i // 3}") for i in range(n)], "k string, i int, p string")
        got = sorted(r.i for r in sequence.even_sample(frame, 7, ["k"], ["i"]).collect())
        assert got == (list(range(n)) if n <= 7 else [i * n // 7 for i in range(7)])
    cut = sequence.even_sample(frame, 7, ["k"], ["i"], F.col("p")).collect()
    assert len({r.p for r in cut}) == len(cut)


def brute_fit(costs, budget):
    out, used, bin_ = [], 0, 0
    for k, c in enumerate(costs):
        if k and used and used + c > budget or (k and out[-1] == bin_ and used + c > budget):
            bin_, used = bin_ + 1, 0
        out.append(bin_)
        used += c
    return out


def test_next_fit_over_batches(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        data = {k: [rng.choice([1, 2, 5, 9, 30]) for _ in range(rng.randint(1, 60))] for k in "abcde"}
        frame = spark.createDataFrame([(k, i, c) for k, cs in data.items() for i, c in enumerate(cs)], "k string, i int, c int").repartition(3)
        got = {}
        for r in folds.next_fit(frame, ["k"], ["i"], "c", 10, "b").orderBy("k", "i").collect():
            got.setdefault(r.k, []).append(r.b)
        assert got == {k: brute_fit(cs, 10) for k, cs in data.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segments_break_at_markers_and_pauses(spark):
    turns = [(0, 0, 30, "a"), (60, 60, 30, "b"), (120, 120, 5, "对了 c"), (180, 180, 5, "d"), (900, 900, 5, "e"), (960, 960, 500, "f"), (1000, 1000, 1, "g")]
    frame = spark.createDataFrame([("k", i, s * 1000, e * 1000, c, t) for i, (s, e, c, t) in enumerate(turns)], "session_key string, turn_no long, start_ms long, end_ms long, chars long, text string")
    got = [r.segment_no for r in folds.segment_turns(frame, 100, 300, 2, 8).orderBy("turn_no").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3]


def brute_cover(segments, n):
    out, cursor = [], 0
    for s, e in sorted((max(0, min(s, n - 1)), max(max(0, min(s, n - 1)), min(e, n - 1))) for s, e in segments):
        if e < cursor:
            if s > cursor:
                out.append((cursor, s - 1))
            continue
        if s > cursor:
            out.append((cursor, s - 1))
        out.append((max(s, cursor), e))
        cursor = e + 1
    return out + ([(cursor, n - 1)] if cursor < n else [])


def test_cover_is_a_partition(spark):
    rng = random.Random(3)
    for n in (1, 5, 12):
        proposals = [(rng.randint(-2, n + 2), rng.randint(-2, n + 2)) for _ in range(rng.randint(1, 6))]
        frame = spark.createDataFrame([("k", s, e, n) for s, e in proposals], "session_key string, start_turn long, end_turn long, n_turns long")
        got = [(r.start_turn, r.end_turn) for r in folds.cover(frame).orderBy("segment_no").collect()]
        assert got == brute_cover(proposals, n)
    empty = spark.createDataFrame([("k", None, None, 3)], "session_key string, start_turn long, end_turn long, n_turns long")
    assert [(r.start_turn, r.end_turn) for r in folds.cover(empty).collect()] == [(0, 2)]


def test_analysis_blocks_join_and_split_sessions(spark):
    data = [("s", k, k * 10_000 + i, i, "x" * 300) for k, n in enumerate((1, 1, 6, 1)) for i in range(n)]
    frame = spark.createDataFrame(data, "source string, session_no long, timestamp_ms long, seq long, text string")
    blocks = folds.analysis_blocks(frame, 1000, F.col("text")).orderBy("start_ms").collect()
    assert sum(b.n_messages for b in blocks) == 9 and all(b.block_id.startswith("blk-") and len(b.block_id) == 24 for b in blocks)
    assert [list(b.sessions) for b in blocks] == [[0, 1], [2], [2, 3]] or all(len(b.text) <= 1000 + 2 * len(b.sessions) for b in blocks)
