from __future__ import annotations

import json

import pytest

from colloquy.operators import blockmap as B

CACHE = "block_id string, version int, language string, result string"


def blocks(spark, n=6):
    return spark.createDataFrame([(f"b{k}", f"text {k}") for k in range(n)], "block_id string, text string")


def result(*events, habits=(), experimental=()):
    return {"events": [{"date": d, "title": t, "summary": t, "importance": i, "kind": "k", "evidence": [f"e {t}"]} for d, t, i in events], "habits": [{"subject": "friend", "claim": c, "confidence": f, "evidence": [c]} for c, f in habits], "experimental": [{"subject": "self", "claim": c, "confidence": 0.1} for c in experimental]}


def ask(text):
    if text.endswith("1"):
        raise B.Refused("against my guidelines")
    if text.endswith("2"):
        return "no object"
    return json.dumps(result(("2024-01-01", text, 2)))


def test_only_blocks_without_a_result_are_mapped(spark):
    none = spark.createDataFrame([], CACHE)
    first = B.map_blocks(B.missing_blocks(blocks(spark), none), ask).collect()
    assert {r.block_id: r.error for r in first} == {"b0": None, "b1": "Refused: against my guidelines", "b2": "not a result", "b3": None, "b4": None, "b5": None}
    cache = B.merged_cache(none, spark.createDataFrame(first, CACHE + ", error string"))
    assert sorted(r.block_id for r in B.missing_blocks(blocks(spark), cache).collect()) == ["b1", "b2"]
    # a changed block has another id; another version or language holds nothing
    assert sorted(r.block_id for r in B.missing_blocks(blocks(spark, 7), cache).collect()) == ["b1", "b2", "b6"]
    assert B.missing_blocks(blocks(spark), cache, language="zh").count() == 6 == B.missing_blocks(blocks(spark), cache, version=4).count()
    again = B.merged_cache(cache, B.map_blocks(B.missing_blocks(blocks(spark), cache), lambda t: json.dumps(result())))
    assert again.count() == 6 and B.missing_blocks(blocks(spark), again).isEmpty()
    report = {r.error: r.n for r in B.block_report(spark.createDataFrame(first, CACHE + ", error string")).collect()}
    assert report == {"": 4, "Refused": 1, "not a result": 1}


def test_other_failures_end_the_job(spark):
    def broken(text):
        raise OSError("no network")

    with pytest.raises(Exception, match="no network"):
        B.map_blocks(blocks(spark), broken).collect()


def test_experimental_parts_are_kept_apart(spark):
    rows = spark.createDataFrame([("b", 5, "en", json.dumps(result(("2024-01-01", "t", 1), experimental=("x",)))), ("c", 5, "en", None)], CACHE)
    ordinary, experimental = B.split_cache(rows)
    (a,), (b,) = ordinary.collect(), experimental.collect()
    assert "experimental" not in json.loads(a.result) and json.loads(a.result)["events"][0]["title"] == "t"
    assert json.loads(b.result)["experimental"][0]["claim"] == "x" and set(json.loads(b.result)) == {"experimental"}


def results(spark, per_month):
    at, rows = 1704067200000, []
    for month, n in enumerate(per_month):
        for k in range(n):
            start = at + month * 31 * 86_400_000 + k * 1000
            rows.append(("o", start, start + 500, json.dumps(result((f"2024-{month + 1:02}-01", f"trip {month}" if k % 2 else f"event number {k}", k % 5), habits=((f"habit {k}", k / 100),)))))
    frame = spark.createDataFrame(rows, "owner string, start_ms long, end_ms long, result string")
    from pyspark.sql import functions as F

    return frame.withColumn("result", F.from_json("result", B.RESULT))


def test_few_messages_are_not_reduced(spark):
    assert B.reduced_months(results(spark, (3, 2)), None, 50_000).count() == 5


def test_months_are_reduced_in_rounds_of_eight(spark):
    def count(label, items):
        """Adds up what it is told, and remembers the size of the largest group."""
        items = json.loads(items)
        n = sum(x["events"][0]["importance"] if x["events"][0]["kind"] == "sum" else 1 for x in items)
        return json.dumps({"events": [{"date": label, "title": str(len(items)), "summary": "", "importance": n, "kind": "sum", "evidence": []}]})

    got = {r.month: r for r in B.reduced_months(results(spark, (70, 9, 1)), count, 60_000).collect()}
    assert set(got) == {"2024-01", "2024-02", "2024-03"}
    top = {m: r.result.events[0] for m, r in got.items()}
    assert (top["2024-01"].importance, top["2024-01"].title, top["2024-01"].date) == (70, "2", "2024-01-r3-1")
    assert (top["2024-02"].importance, top["2024-02"].title) == (9, "2") or top["2024-02"].importance == 8 + 1
    assert top["2024-03"].kind == "k" and got["2024-01"].end_ms - got["2024-01"].start_ms == 69_500


def test_refused_groups_are_merged_by_rule(spark):
    def refuse(label, items):
        raise B.Refused("no")

    (row,) = B.reduced_months(results(spark, (10,)), refuse, 60_000).collect()
    titles = [e.title for e in row.result.events]
    assert titles.count("trip 0") == 1 and len(titles) == len(set(titles)) and row.result.events[0].importance == 4
    assert [h.confidence for h in row.result.habits] == sorted((h.confidence for h in row.result.habits), reverse=True) and row.result.personality == []
