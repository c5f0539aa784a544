from __future__ import annotations

import json

from pyspark.sql import functions as F

from colloquy.functions import items as I


def answers(spark, **by):
    return spark.createDataFrame([(k, v if isinstance(v, str) else "Here it is: ```json\n" + json.dumps(v) + "\n```") for k, v in by.items()], "k string, answer string")


def test_bad_entries_go_one_by_one(spark):
    schema = {"name": ("text", True), "n": ("number", True), "tags": ("texts", False)}
    rows = answers(spark, a={"items": [{"name": "x", "n": 1}, {"name": " ", "n": 1}, {"name": "y", "n": "1"}, {"name": "z", "n": 2.5, "tags": ["a", "b"], "more": {}}, {"name": "w", "n": 1, "tags": ["a", 1]}, "x", None, [], {"name": "v", "n": True}, {"name": "u", "n": 0, "tags": None}]}, b={"items": {}}, c="{broken", d={"other": []}, e='{"items": []} {}')
    got = {r.k: [(x.name, x.n, x.tags) for x in r.x] for r in rows.select("k", I.checked(I.answer_items(F.col("answer"), "items"), schema).alias("x")).collect()}
    assert got == {"a": [("x", 1.0, None), ("z", 2.5, ["a", "b"]), ("u", 0.0, None)], "b": [], "c": [], "d": [], "e": []}


def test_the_last_score_of_an_id_counts(spark):
    rows = answers(spark, q={"ranked": [{"id": "a", "score": 0.2}, {"id": "b", "score": 7}, {"id": "a", "score": -1}, {"id": 5, "score": 1}, {"id": "", "score": 1}, {"id": "c", "score": "1"}, {"score": 1}, "x"]}, r={"ranked": "no"})
    assert sorted(map(tuple, I.rerank_scores(rows, "k").collect())) == [("q", "a", 0.0), ("q", "b", 1.0)]


def test_bounds_by_turn_or_number(spark):
    turns = spark.createDataFrame([("s", 0, 10, 12), ("s", 1, 13, 13), ("s", 2, 14, 19), ("t", 0, 1, 1)], "k string, turn_no long, start_seq long, end_seq long")
    rows = answers(spark, s={"segments": [{"start_turn": 0, "end_turn": "1"}, {"start_seq": 11, "end_seq": 13}, {"start_turn": 1, "start_seq": 14, "end_seq": 19}, {"start_seq": 1, "end_seq": 13}, {"start_turn": True, "end_turn": 1}, {"start_turn": 5, "end_turn": 9}, 3]}, t={"segments": [{"start_seq": 1, "end_seq": 1}]})
    got = sorted(map(tuple, I.proposed_segments(rows, turns, "k").collect()))
    assert got == [("s", 0, 0, 1), ("s", 1, 0, 1), ("s", 2, 2, 2), ("s", 5, 5, 9), ("t", 0, 0, 0)]


def test_attributions_of_known_openings(spark):
    openings = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], "k string, opening_id string")
    one = lambda i, c="care", f=0.5: {"opening_id": i, "category": c, "confidence": f}
    rows = answers(spark, a={"analyses": [one("1"), one("1", "play"), one("9"), one("2", 5), one("2", "news")]}, b={"analyses": [one("3", "")]})
    first, counts = I.attributions(rows, openings, "k")
    assert sorted((r.k, r.opening_id, r.category) for r in first.collect()) == [("a", "1", "care"), ("a", "2", "news")]
    assert sorted(map(tuple, counts.collect())) == [("a", 2, 2, True), ("b", 1, 0, False), ("c", 1, 0, False)]
    told = spark.createDataFrame([("x", "care"), ("x", None), ("x", "care"), ("y", "play"), ("z", None)], "owner string, category string")
    assert {r.owner: (r.status, r.analyzed, r.reason_counts) for r in I.attribution_status(told).collect()} == {"x": ("partial", 2, {"care": 2}), "y": ("completed", 1, {"play": 1}), "z": ("failed", 0, {})}


def test_evidence_comes_back_from_the_sources(spark):
    sources = spark.createDataFrame([("p", k, [f"e{k}", "shared"], [f"f{k}", "g"]) for k in range(20)], "k string, source_id long, evidence array<string>, target_fields array<string>")
    habit = lambda ids, **more: {"category": "sleep", "claim": " late  nights ", "confidence": 0.7, "source_ids": ids, **more}
    rows = answers(spark, p={"habits": [habit([3, 1, 3, 99, "2", "x", True]), habit([]), habit([99]), habit("1"), {"source_ids": [1]}, habit(list(range(20)), target_fields=["own"]), *(habit([5]) for _ in range(30))]})
    got = sorted((r.place, r) for r in I.repaired_habits(rows, sources, "k").collect())
    assert len(got) == 16 and [p for p, _ in got][:3] == [0, 5, 6]
    a, b = got[0][1], got[1][1]
    assert (a.claim, a.source_ids, a.evidence, a.target_fields) == ("late nights", [3, 1, 2], ["e3", "shared", "e1", "e2"], ["f3", "g", "f1", "f2"])
    assert b.source_ids == list(range(12)) and b.evidence == ["e0", "shared", "e1", "e2", "e3", "e4"] and b.target_fields == ["own"]
