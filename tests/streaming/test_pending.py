from __future__ import annotations

import random
from datetime import timedelta

from colloquy.streaming import pending
from colloquy.streaming.pending import BoundedBuffer, PendingInput

from .test_streams import START, run, streamed

EVENTS = "caller string, at timestamp, n long, kind string, message_id string, text string, generation long, message_ids array<string>"


def event(n, kind, message=None, text=None, generation=None, ids=None, caller="c"):
    return (caller, START + timedelta(seconds=n), n, kind, message, text, generation, ids)


SCRIPT = [
    event(1, "input", "a", "one "), event(2, "input", "b", " two"), event(3, "ack", generation=1), event(4, "ack", generation=2), event(5, "input", "c", "x"), event(6, "update", text="seen: x", generation=3), event(7, "input", "c", "again"),
    event(8, "cancel", generation=4), event(9, "ack", generation=4), event(10, "input", "d", " "), event(11, "discard", ids=["zz"]), event(12, "discard", ids=["c", "d"]), event(13, "input", "e", "y"), event(14, "input", "f", "z"), event(15, "discard", ids=["e"]), event(16, "discard"),
    event(17, "discard"), event(18, "odd"),
]
WANT = [
    (1, True, 1, "one", 1, None), (2, True, 2, "one\n\ntwo", 2, 1), (3, False, 2, "one\n\ntwo", 2, None), (4, True, 2, "", 0, None), (5, True, 3, "x", 1, None), (6, True, 3, "seen: x", 1, None), (7, True, 4, "seen: x", 1, 3), (8, True, 4, "seen: x", 1, 4),
    (9, False, 4, "seen: x", 1, None), (10, True, 5, "seen: x", 2, None), (11, False, 5, "seen: x", 2, None), (12, True, 5, "", 0, 5), (13, True, 6, "y", 1, None), (14, True, 7, "y\n\nz", 2, 6), (15, True, 7, "z", 1, None), (16, True, 7, "", 0, 7), (17, False, 7, "", 0, None), (18, False, 7, "", 0, None),
]


def answers(rows, caller="c"):
    return sorted(((round((r["at"] - START.replace(tzinfo=None)).total_seconds()), r["ok"], r["generation"], r["pending"], r["n_pending"], r["outdated"]) for r in rows if r["caller"] == caller), key=str)


def test_generations_acks_and_discards(spark):
    got = pending.settled(spark.createDataFrame(SCRIPT, EVENTS), PendingInput, "caller", "at", "n")
    assert answers(got.collect()) == sorted(WANT, key=str)


def test_a_stream_of_shuffled_parts_gives_the_same(spark, tmp_path):
    rng = random.Random(5)
    rows = SCRIPT + [event(rng.randrange(1, 19), rng.choice(("input", "ack", "discard")), f"m{k % 3}", f"t{k}", rng.randrange(6), None, "other") for k in range(40)]
    rows = [(*r[:2], k, *r[3:]) for k, r in enumerate(rows)]
    rng.shuffle(rows)
    parts = [rows[:20], rows[20:], [event(10_000, "input", "z", "z", caller="end")], [event(10_001, "ack", caller="end")]]
    stream = pending.streamed(streamed(spark, tmp_path, parts, EVENTS, "pending"), PendingInput, "caller", "at", "n", late="1 minute")
    got = run(stream, spark, tmp_path, "settled_inputs").collect()
    want = pending.settled(spark.createDataFrame(rows, EVENTS), PendingInput, "caller", "at", "n").collect()
    assert answers(got) == sorted(WANT, key=str) and answers(got, "other") == answers(want, "other") and len(answers(got, "other")) == 40


TURNS = "shard string, at timestamp, n long, conversation_id string, turn_id string"


def turns(seed, n=150):
    rng, at, out = random.Random(seed), 0, []
    for k in range(n):
        at += rng.choice((1, 2, 20, 90))
        out.append(("s", START + timedelta(seconds=at), k, rng.choice("abcdef"), f"t{k:03}"))
    return out


def plain(rows, size, most, idle):
    """The buffer, told turn by turn."""
    held, number, out = {}, {}, []

    def flush(c):
        for place, (t, _) in enumerate(held.pop(c)):
            out.append((c, number.get(c, 0), place, t, False))
        number[c] = number.get(c, 0) + 1

    for _, at, _, c, t in rows:
        for k in [k for k, v in held.items() if (at - v[-1][1]).total_seconds() >= idle]:
            flush(k)
        if sum(map(len, held.values())) >= size:
            out.append((c, None, None, t, True))
            continue
        held.setdefault(c, []).append((t, at))
        if len(held[c]) >= most:
            flush(c)
    for c in list(held):
        flush(c)
    return out


def shown(rows):
    return sorted(((r.conversation_id, r.batch_no, r.place, r.turn_id, r.dropped) for r in rows if r.conversation_id != "z"), key=lambda x: x[3])


def test_a_full_buffer_drops_and_counts(spark):
    rows = turns(3)
    options = {"size": 9, "max_turns": 4, "idle_seconds": 300}
    done = pending.settled(spark.createDataFrame(rows, TURNS), BoundedBuffer, "shard", "at", "n", **options)
    want = sorted(plain(rows, 9, 4, 300), key=lambda x: x[3])
    assert shown(done.collect()) == want
    (count,) = pending.dropped(done, "shard").collect()
    assert (count.written, count.dropped) == (sum(not x[4] for x in want), sum(x[4] for x in want)) and count.dropped > 5


def test_the_buffer_as_a_stream(spark, tmp_path):
    rows = turns(4)
    options = {"size": 9, "max_turns": 4, "idle_seconds": 300}
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    parts = [mixed[:70], mixed[70:], [("s", START + timedelta(days=2), 999, "z", "zz")], [("s", START + timedelta(days=4), 1000, "z", "zz2")]]
    stream = pending.streamed(streamed(spark, tmp_path, parts, TURNS, "bounded"), BoundedBuffer, "shard", "at", "n", late="1 day", **options)
    assert shown(run(stream, spark, tmp_path, "bounded_rows").collect()) == sorted(plain(rows, 9, 4, 300), key=lambda x: x[3])
