from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import relations, stats


def test_burst_profile_and_scenes(spark):
    pairs = spark.createDataFrame([("a", "哈哈哈哈"), ("a", "啊啊啊啊 [图片]"), ("a", "see you at the station tomorrow"), ("b", "fine, thanks for asking")], "k string, reply string")
    (row,) = stats.burst_profile(pairs, "k").collect()
    assert (row.k, row.n, row.confidence, row.image) == ("a", 2, "low", 0.5)
    scenes = spark.createDataFrame([("a", "casual", 5), ("a", "care", 2), ("a", "x", 9), ("b", "x", 1), ("b", "y", 3), ("b", "z", 2)], "k string, scene string, n long")
    queries = spark.createDataFrame([(1, "a", "nothing special"), (2, "b", "nothing special"), (3, "c", "hi")], "query_id long, k string, query string")
    got = sorted((r.query_id, r.place, r.scene) for r in stats.selected_scenes(queries, scenes, "k").collect())
    assert got == [(1, 1, "casual"), (2, 1, "y"), (2, 2, "z")]


def test_listings_are_cut_after_their_order(spark):
    windows = spark.createDataFrame([(f"w{k}", (k * 7) % 10, k) for k in range(10)], "id string, start_time_ms long, end_time_ms long")
    assert [r.start_time_ms for r in relations.listed_windows(windows, 4).collect()] == [0, 1, 2, 3]
    stickers = spark.createDataFrame([("a", "ai", ["x"], 5), ("b", "shared", ["x", "y"], 9), ("c", "user", ["x"] * 9, 1), ("d", "ai", None, 1), ("e", "ai", ["z"], 2)], "id string, owner string, tags array<string>, created_at_ms long")
    assert [r.id for r in relations.offered_stickers(stickers, 3).collect()] == ["b", "e", "a"]


def test_keys_and_eligibility(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("a1", None), ("a", 1)], "s string, n int").select(S.cache_key(F.col("s"), F.col("n")).alias("k"))
    keys = [r.k for r in rows.collect()]
    assert len(set(keys)) == 3 and keys[0] == keys[3]
    got = {r.s: (r.p, r.c) for r in spark.createDataFrame([("human_original",), ("live",), ("odd",), (None,)], "s string").select("s", S.persona_eligible(F.col("s")).alias("p"), S.continuity_eligible(F.col("s")).alias("c")).collect()}
    assert got == {"human_original": (True, False), "live": (False, True), "odd": (False, False), None: (False, False)}


def test_strict_json_and_times(spark):
    texts = ['{"a":1} more {"b":2}', '{"a": {"b": 1}} trailing }', 'so: {"a": "}"} end', '{"a":1}, {"b":2}', "{}", "none", '{"a":1}{"b":2}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.json_object(F.col("t"))).collect()]
    assert got == [None, None, '{"a": "}"}', None, "{}", None, None]
    times = ["2024-01-01T10:00:61Z", "2024-01-01T10:00:59Z", "2024-01-01T10:00+08:00", "2024-01-01T10:00+25:00", "2024-02-30T10:00Z"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(S.zoned_iso(F.col("t"))).collect()] == [False, True, True, False, False]
    urls = ["http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://127.1/", "https://8.8.8.8/x", "http://example.com", "http://1.2.3/"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(S.safe_url(F.col("u"))).collect()] == [False, False, False, False, True, True, False]
