from __future__ import annotations

import json

from colloquy.sources import importing
from colloquy.sources.chat import Identities, read_payloads

WHO = Identities(own=["me"], friends=["ann"])
HEAD = {"tool": {"format": "any-chat", "version": "1.0"}, "conversation": {"type": "private"}}


def put(folder, name, messages, ids=True):
    said = [{**({"id": f"m{k}"} if ids else {}), "sender_uid": u, "timestamp_ms": at * 60_000, "text": t, **more} for k, (u, at, t, more) in enumerate(messages)]
    (folder / name).write_text(json.dumps({**HEAD, "messages": said}, ensure_ascii=False), encoding="utf-8")


TALK = [("me", 0, "hi", {}), ("me", 1, "there?", {}), ("ann", 2, "yes 抱抱", {}), ("ann", 3, "", {"attachments": [{"type": "image", "name": "a.png"}]}), ("me", 4, "ok u_AbCdEfGhIjKlMnOpQrSt12-w", {}), ("ann", 90, "call 13912345678", {}), ("me", 91, "no", {"reply_to_id": "m5"})]


def test_an_import_makes_all_stored_rows(spark, tmp_path):
    put(tmp_path, "a.json", TALK)
    put(tmp_path, "b.json", TALK[:3])
    (tmp_path / "c.json").write_text("{}")
    done = importing.import_chats(read_payloads(spark, str(tmp_path)), WHO)
    messages = sorted(done["messages"].collect(), key=lambda r: r.seq)
    # the overlapping file adds nothing; ids and phone numbers are replaced
    assert len(messages) == 7 and {r.file[-6:] for r in messages} == {"a.json"} and [r.session_no for r in messages] == [0] * 5 + [1] * 2
    assert "AbCdEf" not in messages[4].text and "139" not in messages[5].text and messages[3].text == "[图片]"
    friend = sorted(done["friend_messages"].collect(), key=lambda r: r.timestamp_ms)
    assert [r.message_id for r in friend] == ["m2", "m5"] and friend[0].warmth > 0 and "there?" in friend[0].context_before and friend[0].id.startswith("friend-") and friend[0].source == "human_original" and not friend[0].deleted
    (pair,) = done["response_pairs"].collect()
    assert (pair.text, pair.friend_reply, pair.user_message_ids, pair.friend_message_ids, pair.start_seq, pair.end_seq) == ("hi\n\nthere?", "yes 抱抱", ["m0", "m1"], ["m2"], 0, 2)
    windows = done["dialogue_windows"].collect()
    assert len(windows) == 2 and {w.has_media for w in windows} == {True, False} and len({w.id for w in windows}) == 2
    (totals,) = done["totals"].collect()
    assert (totals.n_files, totals.n_failed, totals.messages, totals.chunks) == (3, 2, 7, 5)
    again = importing.import_chats(read_payloads(spark, str(tmp_path)), WHO)
    assert {r.id for k in ("friend_messages", "response_pairs") for r in again[k].collect()} == {r.id for r in friend} | {pair.id}


def test_identity_takes_platform_ids_only(spark, tmp_path):
    put(tmp_path, "a.json", TALK[:2] + TALK[:1])
    put(tmp_path, "b.json", TALK[:1], ids=False)
    put(tmp_path, "c.json", TALK[:2], ids=False)
    rows = importing.distinct_messages(importing.messages_of(read_payloads(spark, str(tmp_path)), WHO)).collect()
    # two ids are two messages; without ids equal contents are one
    assert sorted(r.message_id for r in rows) == ["local-0", "local-1", "m0", "m1", "m2"]
