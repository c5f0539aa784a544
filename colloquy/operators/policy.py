"""How to answer a message: an ordered table of rules, and a model's corrections within safe bounds.

Each rule has a condition over the message and the decision so far, and what it changes.
They are folded over the columns of the decision in their order, so later rules see what
earlier ones decided. Notes are codes (what to avoid, what to do); their wording is the
business of whoever prompts a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import squeeze
from ..functions.items import kind_of, text_of
from ..functions.scalars import bounded_list, json_object, memory_accepted, strict_json

# fixed values: words that the rules look for
WORDS = {
    "image": ("发图", "发张图", "图片", "照片", "截图", "给图", "看看图", "看看照片", "send a picture", "send a photo", "show me a picture", "send an image"),
    "sticker": ("表情", "表情包", "贴纸", "sticker", "来个表情", "发个表情", "send a sticker", "send me a sticker"),
    "serious": ("怎么办", "难受", "崩溃", "焦虑", "害怕", "委屈", "生气", "吵架", "压力", "失眠", "睡不着", "累死", "好累", "不舒服", "疼", "病", "anxious", "scared", "overwhelmed", "can't sleep", "cannot sleep", "exhausted", "in pain"),
    "unsafe": ("想死", "不想活", "自杀", "割腕", "跳楼", "死了算了", "活不下去", "kill myself", "end my life", "want to die", "don't want to live", "suicide", "suicidal"),
    "angry": ("烦死", "别烦", "闭嘴", "滚", "别说了", "不想听", "你别", "气死", "shut up", "leave me alone", "stop bothering me"),
    "silence": ("别说话", "先别回", "别理我", "让我静静", "安静会", "算了不聊", "don't reply", "do not reply", "stop talking", "leave me alone", "need some quiet"),
    "intimate": ("想你", "抱抱", "亲亲", "贴贴", "陪我", "撒娇", "哄我", "miss you", "hug me", "hold me"),
    "joke": ("哈哈", "hhh", "笑死", "草", "绷不住", "蚌埠住", "抽象", "发疯", "haha", "lol", "lmao"),
    "life": ("在干嘛", "在干什么", "吃了吗", "睡了吗", "醒了吗", "忙吗", "what are you doing", "are you busy", "have you eaten", "are you awake"),
}
STATES_OF = (("tired", ("睡不着", "失眠", "好累", "累死")), ("anxious", ("焦虑", "害怕", "压力")), ("sad", ("难受", "委屈", "崩溃")))
MODES = ("serious", "playful", "clingy", "calm", "tease", "topic_shift", "silence", "image", "sticker", "chaotic")
STATES = ("normal", "tired", "angry", "sad", "anxious", "joking", "chaotic", "intimate", "unsafe")
FOCUSES = ("human_style", "user_new", "ai_continuity", "relationship_memory", "life_state", "none")
RISKS = ("low", "medium", "high")
MEMORY_KINDS = ("preference", "boundary", "plan", "rhythm", "fact", "relationship")
_FIELDS = ("should_reply", "mode", "risk", "user_state", "focus", "use_image", "use_sticker", "delay", "max_length", "avoid", "advise")
_UNSAFE = {"should_reply": True, "mode": "serious", "risk": "high", "focus": "relationship_memory", "max_length": "medium", "use_image": False, "use_sticker": False}
_UNSAFE_AVOID, _UNSAFE_ADVISE = ("provoking", "methods", "silence"), ("stay", "seek_help", "urgent_help")


def says(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of some words: Latin ones as whole words in any case, others anywhere."""
    low, out = F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(False)
    latin = [w for w in words if w.isascii()]
    if latin:
        out = out | low.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(latin) + r")(?![\p{L}\p{N}_])")
    for w in words:
        if not w.isascii():
            out = out | F.contains(text, F.lit(w))
    return out


def _codes(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def decided(rows: DataFrame, most_delay: int = 15) -> DataFrame:
    """Rows with the decision's fields.

    ``rows`` has text, has_images, has_evidence (of human style), has_live, memory (text),
    availability and reply_delay.
    """
    text = squeeze(F.coalesce("text", F.lit("")))
    bare = F.regexp_replace(text, r"\s+", "")
    odd = (bare != "") & (bare.rlike("^[a-zA-Z0-9]{5,}$") | ((F.length(bare) <= 8) & (F.size(F.array_distinct(F.split(bare, ""))) >= F.greatest(F.lit(5), F.length(bare) - 1))))
    found = {f"_{k}": says(text, w) for k, w in WORDS.items()} | {"_odd": odd, "_h": F.regexp_count(F.lower(text), F.lit("h")) >= 3, "_feels": F.lit("normal")}
    for state, words in reversed(STATES_OF):
        found["_feels"] = F.when(says(text, words), state).otherwise(found["_feels"])
    flag = lambda c: F.coalesce(c, F.lit(False))
    remembered = F.trim(F.coalesce("memory", F.lit(""))) != ""
    start = {
        "should_reply": F.lit(True), "mode": F.lit("calm"), "risk": F.lit("low"), "user_state": F.lit("normal"), "use_image": F.lit(False), "use_sticker": F.lit(False), "delay": F.lit(0), "max_length": F.lit("short"), "avoid": _codes("internals", "imitating_ai"), "advise": _codes(),
        "focus": F.when(flag("has_evidence"), "human_style").when(flag("has_live"), "ai_continuity").when(remembered, "relationship_memory").otherwise("none"),
    }
    out = rows.withColumns(found).withColumns(start)
    c, low = F.col, F.col("risk") == "low"
    shown = c("mode").isin("image", "sticker", "clingy")
    away = c("availability").isin("sleeping", "busy", "away")
    # condition, changes, what to avoid, what to do; the first two end the fold
    table = (
        (c("_image"), {"mode": "image", "focus": "ai_continuity", "use_image": True}, (), ("no_false_image",)),
        (c("_sticker"), {"mode": "sticker", "use_sticker": True}, (), ("own_sticker",)),
        (flag("has_images"), {"focus": "user_new"}, (), ("image_first", "no_false_camera")),
        (c("_angry"), {"risk": "medium", "user_state": "angry", "mode": "calm", "max_length": "very_short"}, ("sarcasm", "clinging", "challenging"), ("deescalate",)),
        (c("_serious"), {"risk": F.when(low, "medium").otherwise(c("risk")), "user_state": c("_feels"), "mode": "serious", "focus": "relationship_memory", "max_length": "medium"}, ("joking", "own_focus"), ("feelings_first",)),
        (c("_intimate") & low, {"user_state": "intimate", "mode": "clingy", "focus": "human_style"}, ("sentimentality",), ("mild_closeness",)),
        ((c("_joke") | c("_h")) & low, {"user_state": F.when(c("mode") != "clingy", "joking").otherwise(c("user_state")), "mode": F.when(shown, c("mode")).otherwise("playful"), "max_length": "very_short"}, (), ("match_mood",)),
        (c("_odd") & low & ~shown, {"user_state": "chaotic", "mode": "chaotic", "max_length": "very_short"}, (), ("light_chaos",)),
        (c("_life"), {"focus": "life_state"}, (), ("answer_from_life",)),
        (flag(away) & low, {"delay": F.least(F.coalesce("reply_delay", F.lit(0)), F.lit(most_delay))}, ("always_there",), ()),
        (~flag("has_evidence") & (c("mode") == "calm"), {"mode": "topic_shift", "focus": F.when(remembered, "relationship_memory").otherwise("none")}, (), ("ask_naturally",)),
    )
    ended = c("_unsafe") | c("_silence")
    for when, changes, avoid, advise in table:
        out = out.withColumn("_on", when & ~ended)
        values = {k: F.when(F.col("_on"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in changes.items()}
        for name, notes in (("avoid", avoid), ("advise", advise)):
            if notes:
                values[name] = F.when(F.col("_on"), F.concat(name, _codes(*notes))).otherwise(F.col(name))
        out = out.withColumns(values)
    silent = {"should_reply": False, "mode": "silence", "risk": "medium", "user_state": "angry", "focus": "none", "max_length": "very_short"}
    last = {k: F.when(c("_unsafe"), F.lit((_UNSAFE | {"user_state": "unsafe"}).get(k))).when(c("_silence"), F.lit(silent[k])).otherwise(c(k)) for k in silent}
    last["avoid"] = F.when(c("_unsafe"), F.concat("avoid", _codes(*_UNSAFE_AVOID))).when(c("_silence"), F.concat("avoid", _codes("pressing"))).otherwise(c("avoid"))
    last["advise"] = F.when(c("_unsafe"), _codes(*_UNSAFE_ADVISE)).when(c("_silence"), _codes("short_calming", "respect_quiet")).when(F.size("advise") == 0, _codes("brief")).otherwise(c("advise"))
    return out.withColumns(last).select(*rows.columns, *_FIELDS)


def _one_of(item: Column, name: str, allowed: tuple[str, ...], fallback: Column) -> Column:
    v = text_of(item, f"$.{name}")
    return F.when(v.isin(*allowed), v).otherwise(fallback)


def refined(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Decisions with a model's corrections, and a memory of the relation that it proposes.

    A decision on safety or silence stays, and so does one whose answer can't be read. Risk
    only rises, silence isn't chosen, modes of images and stickers stay, and a state found
    unsafe brings the decision for that. Up to four notes are added to each kind.
    """
    item = strict_json(json_object(F.col(answer)))
    out = rows.withColumn("_x", F.when((F.col("user_state") != "unsafe") & (F.col("mode") != "silence"), item))
    x, c = F.col("_x"), F.col
    mode = _one_of(x, "reply_mode", tuple(m for m in MODES if m != "silence"), c("mode"))
    rank = lambda r: F.coalesce(F.array_position(_codes(*RISKS), r), F.lit(0))
    risk = _one_of(x, "risk_level", RISKS, c("risk"))
    unsafe = F.coalesce(text_of(x, "$.user_state") == "unsafe", F.lit(False))
    texts = lambda name: F.transform(F.filter(F.coalesce(F.try_variant_get(x, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")), lambda y: F.schema_of_variant(y) == "STRING"), lambda y: F.try_variant_get(y, "$", "string"))
    added = lambda name, extra, more: F.array_distinct(F.concat(c(name), bounded_list(texts(extra), 4, 120), F.when(unsafe, _codes(*more)).otherwise(_codes())))
    new = {
        "mode": F.when(c("mode").isin("image", "sticker"), c("mode")).otherwise(mode), "user_state": _one_of(x, "user_state", STATES, c("user_state")), "risk": F.when(rank(risk) > rank(c("risk")), risk).otherwise(c("risk")),
        "focus": _one_of(x, "retrieval_focus", FOCUSES, c("focus")), "avoid": added("avoid", "extra_do_not", _UNSAFE_AVOID), "advise": added("advise", "extra_instructions", _UNSAFE_ADVISE),
    }
    for k, v in _UNSAFE.items():
        new[k] = F.when(unsafe, F.lit(v)).otherwise(new.get(k, c(k)))
    m = F.try_variant_get(x, "$.relationship_memory", "variant")
    grade = F.when(kind_of(m, "$.importance").rlike("^(?:TINYINT|SMALLINT|INT|BIGINT)"), F.try_variant_get(m, "$.importance", "int"))
    kind, summary, evidence = (F.coalesce(F.try_variant_get(m, f"$.{f}", "string"), F.lit("")) for f in ("kind", "summary", "evidence"))
    fine = F.coalesce(memory_accepted(kind, grade, summary, evidence, F.coalesce("text", F.lit("")), MEMORY_KINDS), F.lit(False))
    memory = F.when(fine, F.struct(squeeze(summary).alias("text"), kind.alias("kind"), grade.alias("importance")))
    kept = {k: F.when(x.isNotNull(), v).otherwise(c(k)) for k, v in new.items()}
    return out.withColumns(kept | {"new_memory": memory}).drop("_x", answer)
