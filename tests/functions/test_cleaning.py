from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.functions import cleaning as C
from colloquy.functions import scalars as S


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("column", "cases"),
    [
        (C.normalize_brackets, {"[图片: a.png] x": "[图片] x", "[/汪汪][[爱心]]": "[表情][表情]", "[微笑][位置]": "[表情][位置]", "[Toasted] [附件]": "[表情] [附件]", "[a longer piece of text]": "[a longer piece of text]"}),
        (lambda t: C.rewrite_mentions(t, ["明", "小明"], ["Sam"]), {"@小明 @明 @Sam @x": "@你 @你 @我 @x"}),
        (lambda t: C.rewrite_uids(t, ["u_ExampleSelfUid00000-w"], []), {"@u_ExampleSelfUid00000-w": "@你", "see ExampleSelfUid00000.": "see @你.", "xExampleSelfUid00000": "xExampleSelfUid00000", "u_AbCdEfGhIjKlMnOpQrSt12": "@某人"}),
        (C.redact_private, {"4111 1111 1111 1111": "[银行卡]", "4111111111111112": "4111111111111112", "11010519491231002X": "[身份证]", "110105194912310021": "110105194912310021", "13912345678": "[手机号]", "a139123456789": "a139123456789",
                            "联系a.b@c.cn。": "[邮箱]。", "+x@y.org": "+[邮箱]", "x@y": "x@y", "1.2.3.4 1.2.3": "[IP] 1.2.3", "e" * 50: "e" * 50}),
        (C.low_signal, {"привет": False, "你好": False, "[图片]！！": True, "[sticker:a] ...": True, "ok [sticker:b": False, "[sticker:b": True, "": True, "１２": False}),
        (lambda t: C.echoes(F.lit("你在干什么？"), t), {"在干嘛": True, "[图片]在干嘛呀": False, "干嘛呢": True, "hi": False}),
        (lambda t: C.window_has_signal(t, ["Sam", "S"]), {"hello": True, "[图片]": False, "Me: hi\nSam: [图片]": False, "Me: hi\nS: yes": True, "Other: yes": False}),
        (C.usable_text, {"[图片]": False, "[Image]": False, "[图片] x": True, " ": False}),
        (lambda t: C.sanitize_reply(t, ["ok"]), {"[图片]：hello": "hello", "a<life-event>x</life-event> b": "ab", "hi <schedule-hint>to": "hi", "[sticker:ok][sticker:no] x": "[sticker:ok] x", "，、 hi  there ": "hi there", "[表情]": "Mm", "": "", "[[a]] [/b]:c": "c"}),
        (lambda t: C.tag_blocks(t, ["life-event", "life-update"]), {"<life-event> a  b </life-event><LIFE-UPDATE>c</LIFE-UPDATE><life-event>a b</life-event>": ["a b", "c"], "none": []}),
        (C.sticker_only, {"[sticker:a]！": True, "[sticker:a] hello": False, "hi": False}),
        (lambda t: C.truncate(t, 8), {"a  b": "a b", "0123456789": "0123456..."}),
        (C.is_burst, {"哈哈哈哈": True, "hello": False, "啊啊啊好": True}),
        (C.scene, {"good night": "sleep", "gamer": "casual", "想你了": "miss_you", "nothing": "casual", "Steam sale": "game"}),
        (lambda t: C.opening_type(t, F.lit(23)), {"晚安": "night_ping", "早": "greeting", "想你": "affection", "12": "short_ping", "嗯嗯！": "short_ping", "[回复] x": "continue_topic", "": "other", "a much longer line of text": "other"}),
        (S.parse_int, {"12": 12, "3.9": 3, "x": 0, "": 0, None: 0, "-4": -4}),
        (S.parse_bool, {"Yes": True, "0": False, "2": True, "no": False, None: False}),
        (lambda t: S.parse_kind(t, F.lit("image")), {"TEXT": "text", "video": "placeholder", "odd": "unknown", "": "placeholder"}),
        (S.json_object, {'```json\n{"a": 1}\n```': '{"a": 1}', "{oops": None, "no": None, "{bad}": None}),
        (S.is_refusal, {"I cannot  help with that": True, '{"a": 1} cannot help with': False, "sure": False}),
        (S.urls, {"see https://a.com/x, a.com and b.org/y。": ["https://a.com/x", "https://a.com", "https://b.org/y"], "me@mail.com": [], "HTTP://X.io/": ["HTTP://X.io/"], "none": []}),
        (S.safe_url, {"http://example.com/a": True, "ftp://example.com": False, "http://127.0.0.1": False, "http://10.1.2.3/x": False, "http://8.8.8.8": True, "http://LOCALHOST:80": False, "http://169.254.1.1": False, "http://[::1]/": False, "x": False}),
        (S.zoned_iso, {"2024-01-02T03:04:05Z": True, "2024-01-02T03:04+08:00": True, "2024-13-02T03:04Z": False, "2024-01-02T03:04": False}),
        (S.recurrence, {"freq=daily;interval=2": "FREQ=DAILY;INTERVAL=2", "FREQ=OFTEN": None, "COUNT=2": None, "FREQ=WEEKLY;X=1": None, "": None}),
        (S.source_label, {"live": "Runtime memory", "x": "Memory excerpt"}),
    ],
)
def test_cases(spark, column, cases):
    assert values(spark, list(cases), column) == list(cases.values())


def test_clean_message_in_order(spark):
    rows = [
        ("hi", "recalled", "", None, "[撤回]"), (" ", "system", "", None, "[系统消息]"), ("[x] a", "text", "discord_default", None, "[x] a"), ("\x01[x] a", "text", "type_1", ["[图片]"], "[表情] a [图片]"),
        ("", "placeholder", "", ["[语音]"], "[语音]"), ("", "unknown", "type_9", None, "[type_9]"), (None, "unknown", None, None, "[未知消息]"), ("[图片] b", "text", "", ["[图片]"], "[图片] b"), ("13912345678 @Alex", "text", "", [], "[手机号] @你"),
    ]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, k string, r string, p array<string>")
    got = frame.orderBy("i").select(C.clean_message(F.col("t"), F.col("k"), F.col("r"), F.col("p"), ["Alex"])).collect()
    assert [r[0] for r in got] == [r[4] for r in rows]


def test_lists_labels_and_memories(spark):
    one = spark.createDataFrame([(["a  b", "None", "c" * 200, None, "d", "e", "f"], ["q 1", "zz", "q1", " "], "text with q1 in it")], "x array<string>, e array<string>, s string")
    kept, found = one.select(S.bounded_list(F.col("x")), S.grounded(F.col("e"), F.col("s"))).first()
    assert kept == ["a b", "c" * 119 + "…", "d", "e"] and found == ["q 1", "q1"]
    labels = spark.createDataFrame([("happy", "a topic name", "7"), ("odd", None, "x"), (None, "t", "1.9")], "m string, t string, i string")
    assert [tuple(r[0]) for r in labels.select(S.label(F.col("m"), F.col("t"), F.col("i"), ["happy"])).collect()] == [("happy", "a topic ", 3), ("unknown", "", 1), ("unknown", "t", 1)]
    memory = spark.createDataFrame([("plan", 2, "User likes tea", "like tea"), ("plan", 0, "User likes tea", "like tea"), ("plan", 2, "Likes tea", "like tea"), ("x", 2, "User likes tea", "like tea"), ("plan", 2, "User likes tea", "tea")], "k string, i int, s string, e string")
    assert [r[0] for r in memory.select(S.memory_accepted(F.col("k"), F.col("i"), F.col("s"), F.col("e"), F.lit("I like tea a lot"), ["plan"])).collect()] == [True, False, False, False, False]
