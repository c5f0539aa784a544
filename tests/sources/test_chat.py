from __future__ import annotations

import hashlib
import json

import pytest

from colloquy.sources import chat, importing

WHO = chat.Identities(own=["me", "whatsapp:You"], friends=["ann", "whatsapp:Ann%20B"], zone="Asia/Shanghai")


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")

    header = {"tool": {"format": "Any-Chat", "version": "1.2"}, "conversation": {"type": "private"}}
    people = [{"uid": "u1", "role": "self"}, {"uid": "u2", "role": "friend"}]
    said = [
        {"id": "a", "sender_uid": "u1", "timestamp_ms": 2000, "text": "hi", "seq": "7"}, {"senderUid": "u2", "senderName": "Two", "timestamp": 1000, "attachments": [{"type": "image", "name": "x.png"}]},
        {"id": "c", "sender_uid": "ann", "timestamp_ms": 3000.0, "kind": "video", "recalled": "true"}, {"id": "d", "sender_uid": "u2", "sender_role": "other", "timestamp_ms": 4000, "system": 0, "kind": "odd", "reply_to_id": "a"},
    ]
    put("a.json", "﻿" + json.dumps({**header, "participants": people, "messages": [*said, None, 3]}))
    put("b.jsonl", "\n".join(json.dumps(x) for x in [{"_type": "header", **header}, *({"_type": "participant", **p} for p in people), *({"_type": "message", **m} for m in said)]) + "\n\n")
    put("c.jsonl", "\n".join(json.dumps(x) for x in [{"sender_uid": "me", "timestamp_ms": 5, "text": "bare"}, {"sender_uid": "u9", "timestamp": "6", "text": "two"}]))
    put("bad.jsonl", '{"_type": "header", "tool": {"format": "any-chat", "version": "1.0"}}\n{"_type": "other"}\n')
    put("broken.jsonl", '{"sender_uid": "me", "timestamp_ms": 5}\n[1]\n')
    put("group.json", json.dumps({**header, "conversation": {"type": "group"}, "messages": said}))
    qq = [
        {"id": "1", "seq": "12", "timestamp": "1000", "sender": {"uid": "me", "name": "Me"}, "type": "type_1", "content": {"text": "yo", "resources": []}}, {"id": "2", "timestamp": 2000, "sender": {"uin": 5, "remark": "R"}, "type": "type_2", "content": {"resources": [{"type": "image"}, {"type": "odd"}, {}]}},
        {"id": "3", "timestamp": 3000, "sender": {"uid": "ann"}, "content": {"text": "re", "reply": {"sourceMsgId": "1", "text": "y" * 200}}}, {"id": "4", "timestamp": 4000, "system": "true", "content": {"text": "joined"}}, {"id": "5", "timestamp": 5000, "type": "json"}, {"id": "6", "timestamp": 6000, "recalled": True, "sourceMsgInfo": {"sourceMsgId": "2"}}, "noise",
    ]
    put("qq.json", json.dumps({"chatInfo": {"selfUid": "me"}, "messages": qq}))
    discord = [
        {"id": "10", "type": "Default", "timestamp": "2024-01-02T03:04:05.678+00:00", "content": " hi ", "author": {"id": "me", "name": "M", "nickname": "Nick"}}, {"id": "11", "type": "Reply", "timestamp": "2024-01-02T11:04:06", "content": "", "author": {"id": "ann"}, "attachments": [{"fileName": "a.PNG"}, {"url": "http://x/b.png?y"}, {"fileName": "c.bin"}], "stickers": [{}], "reference": {"messageId": "10"}},
        {"id": "12", "timestamp": "2024-01-02T03:04:07Z", "content": "", "author": {"id": "z"}, "embeds": [{}]}, {"id": "13", "timestamp": "2024-01-02T03:04:07Z", "content": "", "author": {"id": "z"}}, {"id": "14", "type": "GuildMemberJoin", "timestamp": "2024-01-02T03:04:08Z", "content": "", "author": {"id": "z"}}, {"id": "15", "timestamp": "never", "content": "x", "author": {"id": "z"}},
    ]
    put("discord.json", json.dumps({"guild": {}, "channel": {"id": "1", "type": "DirectTextChat"}, "exportedAt": "2024", "messages": discord}))
    put("wa.txt", "‎1/2/24, 9:05 PM - Messages are encrypted\n13/2/24, 12:00 AM - Ann B: hello: there\nsecond line\n\n13/2/24, 12:00 AM - You: <Media omitted>\n[13.2.99, 23:59:59] You: old\n13/2/24, 12:00 AM - Ann B: hello: there\nsecond line\n\nnot a date 99/99/24, 9:00 - x\n31/2/24, 9:00 - You: never\n")
    put("wa.md", "# WhatsApp chat\nlost\n## 2024年3月5日\n[08:01] **Ann B:** hi\nmore\n---\n## 2024年3月6日\n[09:00:01] __joined__\n# head\n")
    put("empty.json", " ")
    return str(tmp_path)


def by_file(rows, name):
    return sorted((r for r in rows if r.file.endswith("/" + name)), key=lambda r: (r.seq, r.message_id))


def test_all_formats_of_a_folder(spark, folder):
    rows = importing.read_chats(spark, folder, WHO).collect()
    assert {r.file.rsplit("/", 1)[1]: r.format for r in rows} == {"a.json": "canonical", "b.jsonl": "canonical", "c.jsonl": "canonical", "qq.json": "qq", "discord.json": "discord", "wa.txt": "whatsapp", "wa.md": "whatsapp"}
    for name in ("a.json", "b.jsonl"):
        got = {r.timestamp_ms: r for r in by_file(rows, name) if r.timestamp_ms}
        assert [(got[t].role, got[t].kind, got[t].seq) for t in (1000, 2000, 3000, 4000)] == [("friend", "placeholder", 1), ("self", "text", 7), ("friend", "recalled", 2), ("other", "unknown", 3)]
        assert got[1000].placeholders == ["[图片]"] and got[1000].has_media and got[1000].sender_name == "Two" and got[4000].reply_to_id == "a" and got[2000].message_id == "a"
    bare = by_file(rows, "c.jsonl")
    assert [(r.role, r.text, r.timestamp_ms, r.seq) for r in bare] == [("self", "bare", 5, 0), ("other", "two", 6, 1)] and bare[0].message_id.startswith("c-") and bare[0].message_id.endswith("-1")
    qq = {r.message_id: r for r in by_file(rows, "qq.json")}
    assert {k: (r.role, r.kind) for k, r in qq.items()} == {"1": ("self", "text"), "2": ("other", "placeholder"), "3": ("friend", "reply"), "4": ("system", "system"), "5": ("other", "placeholder"), "6": ("other", "recalled")}
    assert (qq["1"].seq, qq["2"].seq, qq["2"].placeholders, qq["2"].sender_name) == (12, 1, ["[图片]", "[odd]", "[附件]"], "R") and (qq["3"].reply_to_id, qq["3"].reply_to_summary) == ("1", "y" * 120)
    d = {r.message_id: r for r in by_file(rows, "discord.json")}
    assert {k: (r.role, r.kind, r.placeholders) for k, r in d.items()} == {"discord:10": ("self", "text", []), "discord:11": ("friend", "reply", ["[图片]", "[文件]", "[表情]"]), "discord:12": ("other", "placeholder", ["[链接]"]), "discord:14": ("system", "system", [])}
    assert d["discord:10"].timestamp_ms == 1704164645678 and d["discord:11"].timestamp_ms == 1704164646000 and d["discord:10"].sender_name == "Nick" and d["discord:11"].reply_to_id == "discord:10"


def test_whatsapp_lines(spark, folder):
    rows = importing.read_chats(spark, folder, WHO, "whatsapp").collect()
    w = by_file(rows, "wa.txt")
    assert [(r.seq, r.role, r.kind, r.text) for r in w] == [(0, "system", "system", "Messages are encrypted"), (1, "friend", "text", "hello: there\nsecond line"), (2, "self", "placeholder", ""), (3, "self", "text", "old"), (4, "friend", "text", "hello: there\nsecond line\n\nnot a date 99/99/24, 9:00 - x")]
    # 1 February 2024, 21:05 in Shanghai; the year 99 is 1999
    assert w[0].timestamp_ms == 1706792700000 and w[3].timestamp_ms == 918921599000 and w[2].placeholders == ["[附件]"]
    assert w[1].message_id == "whatsapp:" + hashlib.sha256(f"{w[1].timestamp_ms}\0whatsapp:Ann%20B\0{w[1].text}".encode()).hexdigest()[:24] + ":0"
    md = by_file(rows, "wa.md")
    assert [(r.role, r.text) for r in md] == [("friend", "hi\nmore"), ("system", "joined")] and md[0].timestamp_ms == 1709596860000


def test_inspection_and_named_reader(spark, folder):
    got = {r.file.rsplit("/", 1)[1]: r for r in importing.inspect_chats(spark, folder).collect()}
    assert got["qq.json"].format == "qq" and got["qq.json"].n_messages == 6 and {p.uid for p in got["qq.json"].people} == {"me", "5", "ann"}
    assert {n: got[n].error for n in ("bad.jsonl", "broken.jsonl", "group.json", "empty.json")} == {"bad.jsonl": "no known format", "broken.jsonl": "line 2 isn't a JSON object", "group.json": "no known format", "empty.json": "empty file"}
    assert {r.format for r in importing.read_chats(spark, folder, WHO, "qq").collect()} == {"qq"}
    with pytest.raises(ValueError):
        importing.read_chats(spark, folder, WHO, "fax")
