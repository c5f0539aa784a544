from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import merges, relations, retrieval


def test_event_merge_follows_the_leader(spark):
    rows = [
        ("o", "2024-01-01", "trip", "to the sea with friends", 1, "a", ["q1"]), ("o", "2024-01-03", "trip", "other words", 3, "b", ["q2", "q1"]), ("o", "2024-01-05", "trip", "late", 1, "c", ["q3"]),
        ("o", "2024-01-04", "sea trip", "other words", 2, "d", ["q4"]), ("o", "not a date", "trip", "x", 1, "e", []), ("p", "2024-01-01", "trip", "y", 1, "f", []),
    ]
    frame = spark.createDataFrame(rows, "owner string, date string, title string, summary string, importance int, kind string, evidence array<string>")
    got = sorted((r.owner, r.date, r.title, r.importance, r.kind, tuple(r.evidence)) for r in merges.merge_events(frame).collect())
    assert got == [("o", "2024-01-01", "trip", 3, "b", ("q1", "q2", "q4")), ("o", "2024-01-05", "trip", 1, "c", ("q3",)), ("o", "not a date", "trip", 1, "e", ()), ("p", "2024-01-01", "trip", 1, "f", ())]


def test_claims_of_one_group_are_merged(spark):
    rows = [("s", "friend", "likes long walks in the rain", 0.9, ["a"], ["m"]), ("s", "friend", "likes long walks in rain", 0.5, ["b", "a"], ["n"]), ("s", "self", "likes long walks in the rain", 0.4, ["c"], []), ("s", "friend", "hates mornings", 0.7, [], [])]
    frame = spark.createDataFrame(rows, "owner string, subject string, claim string, confidence double, evidence array<string>, contexts array<string>")
    got = sorted((r.subject, r.claim, r.confidence, tuple(r.evidence), tuple(r.contexts)) for r in merges.merge_claims(frame, ["owner", "subject"], {"evidence": 6, "contexts": 4}).collect())
    assert got == [("friend", "hates mornings", 0.7, (), ()), ("friend", "likes long walks in the rain", 0.9, ("a", "b"), ("m", "n")), ("self", "likes long walks in the rain", 0.4, ("c",), ())]


def test_merges_take_nulls(spark):
    events = spark.createDataFrame([("o", "2024-01-01", None, None, None, None, None), ("o", "2024-01-01", None, "x", 2, "k", ["e", None]), ("o", None, "t", "y", 1, "k", None)], "owner string, date string, title string, summary string, importance int, kind string, evidence array<string>")
    got = sorted((str(r.date), r.title, r.summary, r.importance, tuple(r.evidence)) for r in merges.merge_events(events).collect())
    assert got == [("2024-01-01", "", "x", 2, ("e",)), ("None", "t", "y", 1, ())]
    claims = spark.createDataFrame([("s", None, None, None), ("s", None, 0.5, ["a"]), ("s", "walks", 0.2, None)], "owner string, claim string, confidence double, evidence array<string>")
    got = sorted((r.claim, r.confidence, tuple(r.evidence)) for r in merges.merge_claims(claims, ["owner"], {"evidence": 3}).collect())
    assert got == [("", 0.0, ()), ("", 0.5, ("a",)), ("walks", 0.2, ())]


def test_upsert_keeps_the_key_unique(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 3), ("a", 2), ("c", 5)], "id string, v int")
    assert sorted(map(tuple, relations.upsert(old, new).collect())) == [("a", 3), ("b", 1), ("c", 5)]
    assert sorted(map(tuple, relations.upsert(old, new, order=-F.col("v")).collect())) == [("a", 2), ("b", 1), ("c", 5)]


def test_null_texts_are_remembered_once(spark):
    log = spark.createDataFrame([("c", "x")], "conversation_id string, text string")
    turns = spark.createDataFrame([("c", None), ("c", "x"), ("c", None), ("d", "x")], log.schema)
    once = relations.remember(log, turns)
    assert once.count() == 3 and relations.remember(once, turns).count() == 3


def test_best_of_a_group_by_rising_text(spark):
    rows = spark.createDataFrame([("g", "abc", 1), ("g", "ab", 1), ("g", "é", 2), ("h", "z", 0)], "g string, t string, n int")
    got = relations.best_per_group_then_fill(rows, "g", [("n", True), ("t", False)], 3).collect()
    assert [(r.t, r.is_best) for r in got] == [("é", True), ("z", True), ("ab", False)]
    assert [r.t for r in relations.best_per_group_then_fill(rows, "g", [("t", False)], 2).collect()] == ["ab", "z"]
    mixed = rows.where("n < 2")
    assert [r.t for r in relations.best_per_group_then_fill(mixed, "g", [("n", True), ("t", False)], 2).collect()] == ["ab", "z"]


def test_selection_and_nearest(spark):
    events = spark.createDataFrame([("o", f"2024-{m:02}-{d:02}", f"t{m}{d}", d) for m in (1, 2) for d in (1, 2, 3)], "owner string, date string, title string, importance int")
    assert [r.title for r in merges.select_events(events, 3).collect()] == ["t13", "t22", "t23"]
    openings = spark.createDataFrame([("s", 23, 1, 5), ("s", 0, 1, 4), ("s", 1, 3, 9), ("s", 12, 1, 8), ("s", 23, 0, 9)], "source string, hour int, weekday int, opened_ms long")
    assert [(r.hour, r.opened_ms) for r in merges.nearest_openings(openings, 23, 1, 3).orderBy("place").collect()] == [(23, 5), (23, 9), (0, 4)]
    found = spark.createDataFrame([("o", "x", c, 0.5, ["e"] * n) for c, n in (("a", 1), ("b", 3), ("c", 2))], "owner string, section string, claim string, confidence double, evidence array<string>")
    assert [r.claim for r in merges.strongest(found, {"x": 2}).orderBy("place").collect()] == ["b", "c"]


def test_people_files_and_caches(spark):
    messages = spark.createDataFrame([("u1", None, "text", None), ("u2", "Own", "text", None), ("u3", None, "system", "friend"), ("me", None, "text", None), ("u1", None, "text", "self")], "sender_uid string, sender_name string, kind string, role string")
    people = spark.createDataFrame([("u1", "Ann", "friend"), ("u1", "Ann", "friend"), ("u2", "Bob", None)], "uid string, name string, role string")
    got = [(r.sender_uid, r.sender_name, r.role) for r in relations.with_people(messages, people, ["me"]).collect()]
    assert sorted(got) == sorted([("u1", "Ann", "friend"), ("u2", "Own", "other"), ("u3", "u3", "system"), ("me", "me", "self"), ("u1", "Ann", "self")])
    refs = spark.createDataFrame([(1, "img/A.png"), (2, "x\\b.png"), (3, "c.png"), (4, "d.png"), (5, "e.png")], "ref_id int, path string")
    files = spark.createDataFrame([("img/a.PNG",), ("other/a.png",), ("y/b.png",), ("z/1_2_c.png",), ("p/d.png",), ("q/d.png",)], "path string")
    assert {r.ref_id: r.file for r in relations.refs_with_files(refs, files).collect()} == {1: "img/a.PNG", 2: "y/b.png", 3: "z/1_2_c.png", 4: None, 5: None}
    openings = spark.createDataFrame([("1", "hi", "friend"), ("2", "hi", "self"), ("3", "yo", "self")], "opening_id string, opening string, initiator string")
    cache = spark.createDataFrame([("1", "care", "hi", "friend", "en"), ("2", "care", "hi", "friend", "en"), ("3", "", "yo", "self", "en")], "opening_id string, category string, opening string, initiator string, language string")
    assert {r.opening_id: r.category for r in relations.cached_attributions(openings, cache, "en").collect()} == {"1": "care", "2": None, "3": None}
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_sha string")
    described = spark.createDataFrame([("a", "a cat", False), ("a", "", False), ("b", "[图片：识别失败]", False)], "image_sha string, description string, deleted boolean")
    assert {r.image_sha: (r.reused, r.state) for r in relations.reuse_descriptions(images, described).collect()} == {"a": ("a cat", "reusable"), "b": (None, "failed"), "c": (None, "pending")}
    with_vector, without = relations.with_embeddings(spark.createDataFrame([("a",), ("b",)], "chunk_id string"), spark.createDataFrame([("a", [1.0]), ("b", None)], "chunk_id string, vector array<double>"))
    assert [r.chunk_id for r in with_vector.collect()] == ["a"] and [r.chunk_id for r in without.collect()] == ["b"]


def test_upkeep(spark):
    schema = "id string, text string, source string, confirmed boolean, trust_level double, deleted boolean, created_at_ms long, attachments array<string>"
    live = spark.createDataFrame([("1", "a", "ai_generated", True, 0.1, False, 1000, []), ("2", "b", "live", True, 0.1, True, 1000, [])], schema)
    new = spark.createDataFrame([("2", "B", None), ("3", "c", "user_new")], "id string, text string, source string")
    got = {r.id: r for r in relations.append_live(live, new, 99).collect()}
    assert set(got) == {"1", "2", "3"} and (got["2"].text, got["2"].source, got["2"].deleted, got["2"].created_at_ms, got["3"].source) == ("B", "live", False, 99, "user_new")
    with_conversation = live.withColumn("conversation_id", F.lit("k"))
    day = 86_400_000
    assert relations.purge_count(with_conversation, 10 * day, older_than_days=3).first().n == 1
    assert relations.purge_count(with_conversation, 10 * day, conversation="other").first().n == 0
    assert {r.id: r.deleted for r in relations.purge(with_conversation, 10 * day).collect()} == {"1": True, "2": True}
    log = spark.createDataFrame([("k", "a")], "conversation_id string, text string")
    assert relations.remember(log, spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), ("j", "a")], "conversation_id string, text string")).count() == 3
    kv = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("x", None, 3), (None, "4", 4)], "k string, v string, o int")
    assert [(r.k, r.v) for r in relations.latest_by_key(kv, "k", F.col("o"), "v").collect()] == [("x", "2")]
    memories = relations.upsert_memories(spark.createDataFrame([], "id string, text string, kind string, importance int, source string, conversation_id string, created_at_ms long, updated_at_ms long, deleted boolean"), spark.createDataFrame([("m", "t")], "id string, text string"), 7)
    assert tuple(memories.first()) == ("m", "t", "note", 1, "chat", "", 7, 7, False)


def test_retrieval_over_five_routes(spark):
    def row(i, route, vector, text, **more):
        base = {"chunk_id": i, "route": route, "vector": vector, "deleted": False, "text": text, "friend_reply": None, "description": None, "source": "human_original", "role": "friend", "conversation_id": "", "session": f"s{i}", "warmth": 0.0, "timestamp_ms": 1_000 * i}
        return base | more

    near, far = [1.0, 0.1], [0.0, 1.0]
    rows = [
        row(1, "pair", near, "q", friend_reply="a good answer"), row(2, "pair", near, "q", friend_reply="[图片]"), row(3, "friend", near, "在干嘛"), row(4, "friend", far, "words"), row(5, "window", near, "Me: hi"), row(6, "window", near, "Sam: hello"),
        row(7, "image", near, "", description=" "), row(8, "image", near, "", description="a cat"), row(9, "live", near, "said", source="ai_generated", conversation_id="k"), row(10, "live", near, "said too", source="ai_generated", conversation_id="j"),
        row(11, "live", far, "mine", source="user_new", conversation_id="k"), row(12, "live", near, "(AI 主动开启话题)", source="user_new", conversation_id="j"), row(13, "live", near, "old", source="live", role="assistant"), row(14, "friend", near, "gone", deleted=True),
    ]
    schema = "chunk_id long, route string, vector array<double>, deleted boolean, text string, friend_reply string, description string, source string, role string, conversation_id string, session string, warmth double, timestamp_ms long"
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    queries = spark.createDataFrame([(100, [1.0, 0.0], "在干什么", "k"), (101, [1.0, 0.0], "hello", "")], "query_id long, query_vector array<double>, query_text string, conversation_id string")
    got = retrieval.retrieve(frame, queries, ["Sam"], 20_000).collect()
    by_query = {q: {r.chunk_id: r for r in got if r.query_id == q} for q in (100, 101)}
    assert set(by_query[100]) == {1, 4, 6, 8, 9, 11} and set(by_query[101]) == {1, 3, 4, 6, 8, 11}
    # the newest of the conversation comes first on the live route
    assert abs(by_query[100][11].rrf - 1 / 61) < 1e-12 and abs(by_query[100][9].rrf - 1 / 62) < 1e-12
    assert by_query[101][1].position == 1
    kept = retrieval.retrieve(frame, queries, ["Sam"], 20_000, long_term=True).where("query_id = 101").collect()
    assert {9, 10} <= {r.chunk_id for r in kept}


def test_result_helpers(spark):
    hits = spark.createDataFrame([(1, "pair", i, "" if i == 2 else "t") for i in range(1, 12)], "query_id long, kind string, position int, text string")
    assert sorted(r.position for r in retrieval.shown_results(hits).collect()) == [1, 3, 4, 5, 6, 7, 8]
    scores = spark.createDataFrame([(1, i, 1.0 - i / 100) for i in range(20)] + [(2, i, 1.0 / (i + 1)) for i in range(20)] + [(3, 1, 1.0)], "query_id long, vec_id long, score double")
    text = F.when(F.col("query_id") == 2, "a longer question than that").otherwise("a longer question than this")
    assert {r.query_id: r.rerank for r in retrieval.gate_rerank(scores, text).collect()} == {1: True, 2: False, 3: False}
    ranked = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 1), (3, 8, 2)], "query_id long, vec_id long, rank int")
    assert tuple(retrieval.retrieval_health(ranked).first()) == (3, 0.666667, True)
