from __future__ import annotations

import pytest

from colloquy.operators import summaries as S

LIMITS = S.SummaryLimits(trigger_messages=5, trigger_chars=10_000, keep_messages=2, recent_chars=1000, batch_chars=256, max_chars=500)
SCHEMA = "conversation_id string, version int, covered long, prefix_digest string, summary string"


def talk(n, key="one", edited=None):
    return [(key, i, "user" if i % 2 == 0 else "assistant", edited if edited and i == 0 else f"message-{i}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conversation_id string, seq int, role string, content string").repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(summary, batch):
    return summary + "|" + ",".join(m["content"] for m in batch)


def run(spark, rows, stored, write=listed, limits=LIMITS):
    states, shown = S.update_summaries(frame(spark, rows), stored, write, limits)
    kept = spark.createDataFrame(states.collect(), SCHEMA)
    rest = {}
    for r in S.recent(frame(spark, rows), shown).orderBy("place").collect():
        rest.setdefault(r.conversation_id, []).append(r.content)
    return kept, {r.conversation_id: r.summary for r in shown.collect()}, rest


def test_short_conversations_are_left(spark):
    kept, shown, rest = run(spark, talk(4), none(spark))
    assert kept.count() == 0 and shown == {"one": ""} and rest["one"] == [f"message-{i}" for i in range(4)]


def test_a_valid_prefix_is_kept_and_only_new_messages_are_sent(spark):
    first, shown, rest = run(spark, talk(8), none(spark))
    assert rest["one"] == ["message-6", "message-7"] and shown["one"] == "|" + ",".join(f"message-{i}" for i in range(6))
    assert first.first().covered == 6
    same, again, rest = run(spark, talk(10), first)
    assert again == shown and rest["one"] == [f"message-{i}" for i in range(6, 10)] and same.collect() == first.collect()
    more, last, rest = run(spark, talk(14), first)
    assert last["one"] == shown["one"] + "|" + ",".join(f"message-{i}" for i in range(6, 12)) and rest["one"] == ["message-12", "message-13"] and more.first().covered == 12


@pytest.mark.parametrize("change", ["edited", "other", "version", "long", "cut", "blank"])
def test_states_that_are_not_valid_are_replaced(spark, change):
    first, shown, _ = run(spark, talk(8), none(spark))
    old = first.first()
    stored = {
        "edited": old, "other": old, "version": ("one", 2, *old[2:]), "long": (*old[:4], "x" * 501), "cut": (old[0], 1, 5, *old[3:]), "blank": (*old[:4], " "),
    }[change]
    rows = talk(8, edited="new") if change == "edited" else talk(8, "two") if change == "other" else talk(8)
    _, now, _ = run(spark, rows, spark.createDataFrame([tuple(stored)], SCHEMA))
    key = "two" if change == "other" else "one"
    assert now[key].startswith("|") and now[key].count("|") == 1 and now[key].count("message") == (5 if change == "edited" else 6)


def test_two_messages_exchanged_are_an_edit(spark):
    rows = talk(8)
    first, _, _ = run(spark, rows, none(spark))
    rows[0], rows[2] = (*rows[0][:3], rows[2][3]), (*rows[2][:3], rows[0][3])
    _, now, _ = run(spark, rows, first, lambda s, b: s + f"{len(b)} ")
    assert now["one"] == "6"


def test_long_messages_are_cut_and_nothing_is_lost(spark):
    rows = [("one", 0, "user", "x" * 700), ("one", 1, "assistant", "response"), ("one", 2, "system", "instruction"), ("two", 0, "user", "y")]
    limits = S.SummaryLimits(5, 200, 2, 100, 256, 2000)
    history = S.prefixes(frame(spark, rows))
    heads = S.summary_heads(history, none(spark), limits)
    batches = S.summary_batches(history, heads, limits).orderBy("batch_no", "place", "piece").collect()
    by = {}
    for b in batches:
        by.setdefault(b.batch_no, []).append(b.content)
    assert all(sum(map(len, v)) <= 256 for v in by.values()) and "".join(b.content for b in batches) == "x" * 700 + "response" and {b.conversation_id for b in batches} == {"one"}
    _, shown, rest = run(spark, rows, none(spark), S.by_length, limits)
    assert shown["one"] == '[["user",256]] [["user",256]] [["user",188],["assistant",8]]' and "one" not in rest and rest["two"] == ["y"]


def test_failures_leave_the_stored_state(spark):
    first, _, _ = run(spark, talk(8), none(spark))

    def fail(summary, batch):
        raise OSError("no answer")

    for write in (fail, lambda s, b: "  "):
        kept, shown, rest = run(spark, talk(20) + talk(3, "two"), first, write)
        assert kept.collect() == first.collect() and shown["one"] == first.first().summary and len(rest["one"]) == 14 and len(rest["two"]) == 3
    history = S.prefixes(frame(spark, talk(20)))
    heads = S.summary_heads(history, first, LIMITS)
    assert "no answer" in S.summarised(S.summary_batches(history, heads, LIMITS), heads, fail, LIMITS).first().error


def test_many_conversations_in_one_task(spark):
    rows = [r for k in range(40) for r in talk(6 + k % 9, f"c{k:02}")]
    kept, shown, rest = run(spark, rows, none(spark), lambda s, b: s + "".join(m["content"][8:] + " " for m in b))
    want = {}
    for k in range(40):
        n = 6 + k % 9
        want[f"c{k:02}"] = " ".join(str(i) for i in range(n - 2 + n % 2)) if n > 5 else ""
    assert shown == want and kept.count() == 40
