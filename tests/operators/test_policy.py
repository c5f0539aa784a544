from __future__ import annotations

import json

from colloquy.operators import policy as P

SCHEMA = "n int, text string, has_images boolean, has_evidence boolean, has_live boolean, memory string, availability string, reply_delay int"


def rows(spark, *cases):
    full = [(k, t, *(more[0] if more else (False, True, False, "", "available", 0))) for k, (t, *more) in enumerate(cases)]
    return spark.createDataFrame(full, SCHEMA)


def test_rules_in_their_order(spark):
    got = {r.n: r for r in P.decided(rows(
        spark, ("hello, there friend",), ("I want to die, haha",), ("别理我",), ("发张图 看看",), ("sticker please",), ("闭嘴",), ("好累 闭嘴",), ("抱抱",), ("抱抱 哈哈",), ("hahaha!",), ("qwerty12",), ("在干嘛",), (None,), ("不想活了 别理我",),
        ("照片 哈哈",), ("这张到底怎么样呀我的朋友", (True, True, False, "", "busy", 99)), ("就这样吧好的好的", (False, False, True, " ", "available", 0)), ("就这样吧好的好的", (False, False, False, "m", None, None)), ("stickers everywhere, tonight",), ("生气 抱抱",),
    )).collect()}
    shown = {k: (r.mode, r.user_state, r.risk, r.focus, r.max_length) for k, r in got.items()}
    assert shown == {
        0: ("calm", "normal", "low", "human_style", "short"), 1: ("serious", "unsafe", "high", "relationship_memory", "medium"), 2: ("silence", "angry", "medium", "none", "very_short"), 3: ("image", "normal", "low", "ai_continuity", "short"), 4: ("sticker", "normal", "low", "human_style", "short"),
        5: ("calm", "angry", "medium", "human_style", "very_short"), 6: ("serious", "tired", "medium", "relationship_memory", "medium"), 7: ("clingy", "intimate", "low", "human_style", "short"), 8: ("clingy", "intimate", "low", "human_style", "very_short"), 9: ("playful", "joking", "low", "human_style", "very_short"),
        10: ("chaotic", "chaotic", "low", "human_style", "very_short"), 11: ("calm", "normal", "low", "life_state", "short"), 12: ("calm", "normal", "low", "human_style", "short"), 13: ("serious", "unsafe", "high", "relationship_memory", "medium"), 14: ("image", "joking", "low", "ai_continuity", "very_short"),
        15: ("calm", "normal", "low", "user_new", "short"), 16: ("topic_shift", "normal", "low", "none", "short"), 17: ("topic_shift", "normal", "low", "relationship_memory", "short"), 18: ("calm", "normal", "low", "human_style", "short"), 19: ("serious", "normal", "medium", "relationship_memory", "medium"),
    }
    assert not got[2].should_reply and got[1].should_reply and got[1].advise == ["stay", "seek_help", "urgent_help"] and got[0].advise == ["brief"] and got[3].use_image and got[4].use_sticker and not got[1].use_image
    assert (got[15].delay, got[0].delay) == (15, 0) and got[15].avoid == ["internals", "imitating_ai", "always_there"] and got[6].avoid == ["internals", "imitating_ai", "sarcasm", "clinging", "challenging", "joking", "own_focus"]


def test_a_model_can_only_raise_the_risk(spark):
    cases = {
        "plain words, of a day": {"reply_mode": "tease", "user_state": "sad", "risk_level": "medium", "retrieval_focus": "life_state", "extra_instructions": ["brief", " be  kind ", "None", 5, "a", "b", "c", "d"], "extra_do_not": "x"},
        "好累": {"risk_level": "low", "reply_mode": "silence", "user_state": "other", "retrieval_focus": 5},
        "发图": {"reply_mode": "calm", "user_state": "unsafe"},
        "想死": {"reply_mode": "playful", "risk_level": "low"},
        "别理我": {"reply_mode": "calm", "should_reply": True},
        "I like green tea a lot": {"relationship_memory": {"kind": "preference", "summary": "User likes green tea", "evidence": "green tea", "importance": 2}},
        "I like red tea a lot": {"relationship_memory": {"kind": "preference", "summary": "User likes green tea", "evidence": "green tea", "importance": 2}},
        "I like tea a lot, true": {"relationship_memory": {"kind": "preference", "summary": "User likes tea", "evidence": "like tea", "importance": True}},
        "broken answer of it": None,
    }
    base = P.decided(rows(spark, *((t,) for t in cases)))
    answers = spark.createDataFrame([(t, "no json {" if v is None else json.dumps(v)) for t, v in cases.items()], "text string, answer string")
    got = {r.text: r for r in P.refined(base.join(answers, "text")).collect()}
    old = {r.text: r for r in base.collect()}
    a, b, c, d, e, *memories = (got[t] for t in cases)
    assert (a.mode, a.user_state, a.risk, a.focus, a.advise, a.avoid) == ("tease", "sad", "medium", "life_state", ["brief", "be kind", "a", "b"], ["internals", "imitating_ai"])
    assert (b.mode, b.user_state, b.risk, b.focus) == ("serious", "tired", "medium", "relationship_memory")
    assert (c.mode, c.risk, c.use_image, c.max_length, c.focus, c.should_reply) == ("serious", "high", False, "medium", "relationship_memory", True) and c.advise[-3:] == ["stay", "seek_help", "urgent_help"]
    for r in (d, e):
        assert all(r[f] == old[r.text][f] for f in P._FIELDS)
    assert tuple(memories[0].new_memory) == ("User likes green tea", "preference", 2) and [m.new_memory for m in memories[1:]] == [None, None, None]
    assert all(memories[3][f] == old[memories[3].text][f] for f in P._FIELDS)
