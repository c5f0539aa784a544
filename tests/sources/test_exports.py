from __future__ import annotations

import hashlib
import json

import pytest

from colloquy.sources import exports, importing
from colloquy.sources.chat import Identities, read_payloads

WHO = Identities(own=["wxid_me", "me", "telegram:Me%20Too"], friends=["ann", "telegram:Ann"])


def put(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def lines(*records):
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in records) + "\n"


def rows(spark, folder, name=None):
    return sorted(importing.read_chats(spark, str(folder), WHO, name).collect(), key=lambda r: (r.file, r.seq, r.message_id))


WEFLOW = {
    "weflow": {"format": "Arkme-JSON", "version": "1"}, "session": {"wxid": "ann"},
    "senders": [{"senderID": 1, "wxid": "wxid_me", "displayName": "Me"}, {"senderID": "2", "wxid": "ann", "nickname": "Ann"}, {"senderID": 3, "wxid": "late"}, {"senderID": 3, "wxid": "later", "displayName": "L"}, {"senderID": -4, "wxid": "x"}, "noise"],
    "messages": [
        {"localId": 11, "createTime": 1704067200, "type": "文本消息", "content": " hi ", "isSend": 1, "senderID": 1, "platformMessageId": "p1"},
        {"localId": "12", "createTime": "1704067201", "type": "图片消息", "content": None, "isSend": 0, "senderID": 2},
        {"createTime": 1704067202, "type": "系统消息", "content": "\"Ann\" 撤回了一条消息", "isSend": 0, "senderID": 2},
        {"createTime": 1704067203, "type": "系统消息", "content": "welcome", "isSend": 0, "senderID": 9},
        {"createTime": 1704067204, "type": "文本消息", "content": "[微笑] [捂脸]", "isSend": 0, "senderID": 9},
        {"createTime": 1704067205, "type": "文本消息", "content": "[微笑][图片]", "isSend": 2, "senderID": 3},
        {"createTime": 1704067206, "type": "引用消息", "content": "1 [a] [引用 Ann：where]  ", "isSend": 1, "senderID": 1, "replyToMessageId": "p0", "quotedContent": "where", "quotedSender": "Ann"},
        {"createTime": 1704067207, "type": "新类型", "content": "", "isSend": 0, "senderID": 2}, "noise",
        {"createTime": 1704067208, "type": "文本消息", "content": "", "isSend": "", "senderID": None},
    ],
}


def test_weflow_senders_kinds_and_quotations(spark, tmp_path):
    put(tmp_path, "w.json", WEFLOW)
    put(tmp_path, "bare.json", {k: v for k, v in WEFLOW.items() if k != "weflow"})
    got = [r for r in rows(spark, tmp_path) if r.file.endswith("w.json")]
    assert {r.format for r in got} == {"weflow"} and len(rows(spark, tmp_path)) == 2 * len(got)
    by = {(r.timestamp_ms - 1704067200000) // 1000: r for r in got}
    assert {k: (r.role, r.kind) for k, r in by.items()} == {
        0: ("self", "text"), 1: ("friend", "placeholder"), 2: ("friend", "recalled"), 3: ("system", "system"), 4: ("friend", "placeholder"), 5: ("other", "text"), 6: ("self", "reply"), 7: ("friend", "placeholder"), 8: ("other", "unknown"),
    }
    assert (by[0].message_id, by[0].seq, by[0].sender_name, by[0].text) == ("p1", 11, "Me", "hi") and (by[1].message_id, by[1].seq, by[1].sender_name, by[1].placeholders) == ("local-1", 12, "Ann", ["[图片]"])
    assert (by[4].placeholders, by[4].text, by[5].text, by[5].sender_name, by[5].sender_uid) == (["[表情]"], "", "[微笑][图片]", "L", "later") and by[7].placeholders == ["[新类型]"]
    assert (by[6].text, by[6].reply_to_id, by[6].reply_to_summary) == ("1 [a]", "p0", "Ann：where") and by[8].seq == 9 and by[3].sender_uid == ""


def test_a_named_reader_takes_what_no_match_would(spark, tmp_path):
    put(tmp_path, "odd.json", {"senders": WEFLOW["senders"], "messages": WEFLOW["messages"]})
    assert rows(spark, tmp_path) == [] and len(rows(spark, tmp_path, "weflow")) == 9
    put(tmp_path, "odd.json", {"messages": [{"id": "1", "timestamp": 5, "sender": {"uid": "me"}, "content": {"text": "x"}}]})
    assert [r.text for r in rows(spark, tmp_path, "qq")] == ["x"]


CHATLAB = {"chatlab": {"version": "0.0.2", "generator": "WeFlow"}, "meta": {"platform": "wechat", "type": "private", "ownerId": "me"}}
LAB = [
    {"sender": "me", "accountName": "M", "timestamp": 1704067200, "type": 0, "content": "hi", "platformMessageId": "a"}, {"sender": "ann", "groupNickname": "G", "accountName": "A", "timestamp": 1704067201000, "type": 4, "content": "media\\x\\pic.JPG?y=1"},
    {"sender": "ann", "timestamp": "1704067202", "type": "2", "content": ""}, {"sender": "", "timestamp": 1704067203, "type": 80, "content": "Ann Recalled a message"}, {"sender": "", "timestamp": 1704067204, "type": 80, "content": "joined"},
    {"sender": "me", "timestamp": 1704067205, "type": 25, "content": "yes [引用 Ann：q]"}, {"sender": "me", "timestamp": 1704067206, "type": 0, "content": "re", "replyToMessageId": "a"}, {"sender": "me", "timestamp": 1704067207, "content": ""}, {"sender": "me", "timestamp": 1704067208, "type": 99, "content": "clip.mp4"},
]


def test_weflow_chatlab_in_both_shapes(spark, tmp_path):
    put(tmp_path, "a.json", {**CHATLAB, "members": [{"platformId": "me"}], "messages": [*LAB, None]})
    put(tmp_path, "b.jsonl", lines({"_type": "header", **CHATLAB}, {"_type": "member", "platformId": "ann"}, *({"_type": "message", **m} for m in LAB)))
    put(tmp_path, "other.jsonl", lines({"_type": "header", **CHATLAB}, {"_type": "note"}))
    for name in ("a.json", "b.jsonl"):
        got = [r for r in rows(spark, tmp_path) if r.file.endswith(name)]
        assert {r.format for r in got} == {"weflow_chatlab"}
        assert [(r.timestamp_ms - 1704067200000) // 1000 for r in got] == list(range(9)) == [r.seq for r in got]
        assert [(r.role, r.kind) for r in got] == [("self", "text"), ("friend", "placeholder"), ("friend", "placeholder"), ("other", "recalled"), ("system", "system"), ("self", "reply"), ("self", "reply"), ("self", "unknown"), ("self", "placeholder")]
        assert [r.placeholders for r in got] == [[], ["[图片]"], ["[语音]"], [], [], [], [], [], ["[视频]"]] and [r.raw_type for r in got][6:8] == ["chatlab_0", "chatlab_99"]
        assert (got[1].sender_name, got[1].text, got[5].text, got[5].reply_to_summary, got[6].reply_to_id) == ("G", "", "yes", "[引用 Ann：q]", "a")
    assert got[0].message_id == "a" and got[2].message_id.startswith("b-") and got[2].message_id.endswith("-5")


DOUYIN = [
    {"sender": "me", "accountName": "M", "timestamp": 1704067200, "type": 0, "content": " hi "}, {"sender": "u", "timestamp": "1704067201000", "type": 1, "content": "https://cdn/x"}, {"sender": "u", "timestamp": 1704067202, "type": 0, "content": "[语音 3秒]"},
    {"sender": "u", "timestamp": 1704067203, "type": 0, "content": "[视频 1.5秒]"}, {"sender": "", "timestamp": 1704067204, "type": 0, "content": "[通话成功] 3"}, {"sender": "u", "timestamp": 1704067205, "type": 0, "content": "re", "replyTo": {"replyTo": "9", "replyToAuthor": "M", "replyToContent": "hi"}},
    {"sender": "u", "timestamp": 1704067206, "type": 24, "content": ""}, {"sender": "u", "timestamp": 1704067207, "type": 77, "content": "odd"}, {"sender": "u", "timestamp": 1704067208, "type": 0, "content": "[分享内容]"},
    {"sender": "", "timestamp": 1704067209, "type": 0, "content": "nobody"}, {"sender": "u", "timestamp": 0, "type": 0, "content": "x"}, {"sender": "u", "timestamp": "soon", "type": 0, "content": "x"}, {"sender": "u", "timestamp": 1704067210, "type": 0, "content": ""}, {"sender": "u", "timestamp": 1704067211, "type": 5, "content": "x"},
]


def test_douyin(spark, tmp_path):
    head = {"chatlab": {"generator": "douyin-chat-export"}, "meta": {"platform": "Douyin", "ownerId": "me"}}
    put(tmp_path, "a.json", {**head, "messages": DOUYIN})
    put(tmp_path, "b.jsonl", lines({"_type": "header", **head}, *({"_type": "message", **m} for m in DOUYIN)))
    put(tmp_path, "group.json", {**head, "meta": {"platform": "douyin", "type": "group"}, "messages": DOUYIN})
    everything = rows(spark, tmp_path)
    for name in ("a.json", "b.jsonl"):
        got = [r for r in everything if r.file.endswith(name)]
        assert [(r.seq, r.kind, r.role, r.text, r.placeholders) for r in got] == [
            (0, "text", "self", "hi", []), (1, "placeholder", "other", "", ["[图片]"]), (2, "placeholder", "other", "", ["[语音]"]), (3, "placeholder", "other", "", ["[视频]"]), (4, "system", "system", "[通话成功] 3", []), (5, "reply", "other", "re", []),
            (6, "placeholder", "other", "", ["[链接]"]), (7, "unknown", "other", "odd", []), (8, "placeholder", "other", "", ["[链接]"]), (13, "placeholder", "other", "", ["[表情]"]),
        ]
        assert got[1].timestamp_ms == 1704067201000 and (got[5].reply_to_id, got[5].reply_to_summary, got[5].raw_type) == ("9", "M: hi", "chatlab_0")
    assert not [r for r in everything if r.file.endswith("group.json")]
    info = {r.file.rsplit("/", 1)[1]: r for r in importing.inspect_chats(spark, str(tmp_path)).collect()}
    assert [(p.uid, p.role_hint) for p in info["a.json"].people] == [("u", "friend"), ("me", "self")] == [(p.uid, p.role_hint) for p in info["b.jsonl"].people]


def node(number, body, classes="message default clearfix"):
    return f'<div class="{classes}" id="message{number}"><div class="body">{body}</div></div>'


def date(second, zone=" UTC+08:00"):
    return f'<div class="pull_right date details" title="01.01.2024 08:00:{second:02}{zone}">08:00</div>'


TELEGRAM = '<html><body><div class="page_header"><div class="content"><div class="text bold"> Ann &amp; Me </div></div></div><div class="page_body"><div class="history">' + "".join((
    node(-1, '<div class="body details">1 January 2024</div>', "message service"), node(1, date(0) + '<div class="from_name"> Ann </div><div class="text">one<br>two <a href="x">link</a> &lt;3</div>'),
    node(2, date(1) + '<div class="text">joined<p>unclosed</div>', "message default clearfix joined"), node(3, date(2) + "pinned <b>it</b>", "message service"), node(4, date(3) + '<div class="text">still Ann</div>', "message default joined"),
    node(5, date(4) + '<div class="text">nobody</div>'), node(6, date(5) + '<div class="from_name">Me Too</div><div class="reply_to details">In reply to <a href="#go_to_message1" onclick="">this</a></div><div class="text">re</div>'),
    node(7, date(6) + '<div class="media_wrap clearfix"><a class="photo_wrap clearfix" href="photos/a%20b+c.jpg"><img class="photo" src="t.jpg"></a><a class="photo_wrap" href="http://x/y.jpg"></a><a class="photo_wrap" href="../up.png"></a></div>', "message joined"),
    node(8, date(7) + '<div class="media_wrap"><div class="media clearfix media_voice_message"></div><a class="sticker_wrap" href="stickers/s.webp"></a><a class="media media_file" href="v.MP4"></a><div class="media media_call"></div></div>', "message joined"),
    node(9, date(8) + '<div class="media_wrap"><span>?</span></div>', "message joined"), node(10, date(9, "") + '<div class="text">no zone</div>', "message joined"), '<div class="message" id="message11">no body</div>', node(12, '<div class="from_name">Ann</div><div class="text">no date</div>'),
    node(13, date(10) + '<div class="text">after the undated</div>', "message joined"),
)) + "</div></div></body></html>"


def test_telegram_nodes_senders_and_media(spark, tmp_path):
    put(tmp_path, "messages.html", TELEGRAM)
    put(tmp_path, "page.html", "<html><body>no chat</body></html>")
    got = rows(spark, tmp_path)
    space = "telegram:" + hashlib.sha256(b"Ann & Me").hexdigest()[:16] + ":message"
    assert {r.format for r in got} == {"telegram"}
    assert [(r.message_id.removeprefix(space), r.sender_name, r.role, r.kind, r.text) for r in got] == [
        ("1", "Ann", "friend", "text", "one\ntwo link <3"), ("2", "Ann", "friend", "text", "joinedunclosed"), ("3", "", "system", "system", "08:00 pinned it"), ("4", "Ann", "friend", "text", "still Ann"), ("6", "Me Too", "self", "reply", "re"),
        ("7", "Me Too", "self", "placeholder", ""), ("8", "Me Too", "self", "placeholder", ""), ("9", "Me Too", "self", "placeholder", ""), ("13", "Ann", "friend", "text", "after the undated"),
    ]
    assert [r.timestamp_ms for r in got][:2] == [1704067200000, 1704067201000] and got[4].reply_to_id == space + "1"
    assert [r.placeholders for r in got][5:8] == [["[图片]"], ["[语音]", "[表情]", "[视频]", "[通话]"], ["[附件]"]]
    refs = sorted((r.message_id.removeprefix(space), r.path) for r in importing.image_refs(read_payloads(spark, str(tmp_path))).collect())
    assert refs == [("7", "photos/a b+c.jpg"), ("8", "stickers/s.webp")]


def test_broken_pages_do_not_stop_the_reader(spark, tmp_path):
    put(tmp_path, "a.html", "</div></p>" + TELEGRAM[: len(TELEGRAM) // 2] + "<div class=")
    put(tmp_path, "b.html", "<div class='history'><div class='message' " + 'id="message1"><div class=body>' + "<b>" * 50 + "</div></div>")
    assert {r.file.rsplit("/", 1)[1] for r in rows(spark, tmp_path)} == {"a.html"}


def test_qq_chunks_and_hints(spark, tmp_path):
    said = [{"id": "1", "timestamp": 5, "sender": {"uid": "me"}, "content": {"text": "x"}}, {"timestamp": 6, "sender": {"uid": "ann"}, "content": {"resources": [{"type": "image", "filename": "a.png"}, {"type": "image", "localPath": "A.PNG"}], "elements": [{"type": "image", "data": {"localPath": "r/b.png"}}]}}]
    put(tmp_path, "c.jsonl", lines(*said))
    put(tmp_path, "bad.jsonl", lines(*said, {"timestamp": 1}))
    put(tmp_path, "broken.jsonl", lines(*said) + "\n{oops\n")
    put(tmp_path, "whole.json", {"chatInfo": {"selfUid": "me"}, "messages": said})
    got = rows(spark, tmp_path)
    assert [(r.format, r.text, r.kind) for r in got if r.file.endswith("c.jsonl")] == [("qq", "x", "text"), ("qq", "", "placeholder")]
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"c.jsonl", "whole.json"}
    info = {r.file.rsplit("/", 1)[1]: r for r in importing.inspect_chats(spark, str(tmp_path)).collect()}
    assert info["broken.jsonl"].error == "line 4 isn't a JSON object" and info["bad.jsonl"].error == "no known format"
    assert [(p.uid, p.role_hint) for p in info["whole.json"].people] == [("ann", "friend"), ("me", "self")] and {p.role_hint for p in info["c.jsonl"].people} == {"unknown"}
    refs = sorted((r.file.rsplit("/", 1)[1], r.message_id[-2:], r.path) for r in importing.image_refs(read_payloads(spark, str(tmp_path))).collect())
    assert refs == [("c.jsonl", "-2", "A.PNG"), ("c.jsonl", "-2", "r/b.png")]


def test_images_of_a_folder_end_to_end(spark, tmp_path):
    head = {"tool": {"format": "any-chat", "version": "1.0"}, "conversation": {"type": "private"}}
    image = lambda name: [{"type": "image", "name": name}]
    said = [
        {"id": str(k), "sender_uid": ("me", "ann")[k % 2], "timestamp_ms": 1000 * k, "text": f"t{k}", "attachments": image(n)}
        for k, n in enumerate(("img/one.png", "two.png", "three.png", "twice.png", "none.png", "five.png"))
    ]
    put(tmp_path, "chat.json", {**head, "messages": said})
    for name, data in (("img/one.png", b"1"), ("deep/two.png", b"2"), ("x/2024_three.png", b"3"), ("a/twice.png", b"4"), ("b/twice.png", b"5"), ("five.png", b"1"), ("big.png", b"0" * 100), ("text.txt", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    payloads = read_payloads(spark, str(tmp_path / "chat.json"))
    messages = importing.messages_of(payloads, WHO)
    files = importing.image_files(spark, str(tmp_path), most_bytes=50)
    assert files.count() == 6
    sha = hashlib.sha256(b"2").hexdigest()
    described = spark.createDataFrame([(sha, "a cat", False), (hashlib.sha256(b"3").hexdigest(), "[Image: recognition failed]", False)], "image_sha string, description string, deleted boolean")
    done = importing.import_images(messages, importing.image_refs(payloads), files, described).cache()
    got = {r.message_id: r for r in done.collect()}
    assert {k: (r.state, r.file and r.file.rsplit("/", 1)[1]) for k, r in got.items()} == {
        "0": ("pending", "one.png"), "1": ("reusable", "two.png"), "2": ("failed", "2024_three.png"), "3": ("missing", None), "4": ("missing", None), "5": ("pending", "five.png"),
    }
    assert got["1"].reused == "a cat" and got["1"].chunk_id == f"image-1-{sha[:16]}" and "t0" in got["1"].context_before and "t2" in got["1"].context_after
    assert tuple(importing.image_report(done).first()) == (6, 4, 2, 3, 1, 1, 1)


def test_unknown_reader(spark, tmp_path):
    with pytest.raises(ValueError):
        importing.read_chats(spark, str(tmp_path), WHO, "fax")


def test_empty_folder_of_texts(spark, tmp_path):
    put(tmp_path, "a.txt", "")
    assert rows(spark, tmp_path) == [] and exports.telegram_nodes(read_payloads(spark, str(tmp_path))).collect() == []
