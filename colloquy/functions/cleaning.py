"""Cleaning of messages: control marks, bracket tokens, mentions, ids, private data.

Every function takes and gives columns; nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
FACE = "[表情]"
GENERIC_UID = r"@?u_[A-Za-z0-9_-]{20,24}"
_SPACE = r"[\s\p{Z}]"


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def _tokens(names: Sequence[str]) -> str:
    return r"\[(?:" + "|".join(names) + r")\]"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def replace_where(text: Column, pattern: str, valid: Callable[[Column], Column], replacement: str) -> Column:
    """Each match of ``pattern`` that is ``valid`` replaced; the others stay."""

    def replaced(t: Column) -> Column:
        found, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern)
        whole = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.when(valid(m), F.lit(replacement)).otherwise(m), F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(whole, "")).otherwise(t)

    return once(text, replaced)


def normalize_brackets(text: Column, keep_faces: bool = False) -> Column:
    """Media tokens without file names, and all face tokens as one.

    Four syntaxes are faces: ``[/x]``, ``[[x]]``, one to four ideographs, and any one
    to twelve symbols in single brackets, but for the reserved tokens. With
    ``keep_faces`` only the slash form of the face token itself is rewritten.
    """
    text = F.regexp_replace(text, r"\[(" + "|".join(L.NAMED_MEDIA) + r")[:：][^\]]+\]", "[$1]")
    if keep_faces:
        return F.replace(text, F.lit("[/表情]"), F.lit(FACE))
    reserved = r"(?!(?:" + "|".join(L.RESERVED_TOKENS) + r")\])"
    for pattern in (r"\[/[^\]\n]{1,16}\]", r"\[\[[^\]\n]{1,32}\]\]", r"\[" + reserved + r"[一-龥]{1,4}\]", r"\[" + reserved + r"[^\[\]\n]{1,12}\]"):
        text = F.regexp_replace(text, pattern, FACE)
    return text


def _alternatives(names: Sequence[str]) -> str:
    return "|".join(re.escape(n) for n in sorted(filter(None, names), key=len, reverse=True))


def rewrite_mentions(text: Column, own: Sequence[str], other: Sequence[str]) -> Column:
    """``@name`` from the other's point of view: own names are you, the other's are me; longest names first."""
    for names, to in ((own, "@你"), (other, "@我")):
        if any(names):
            text = F.regexp_replace(text, f"@(?:{_alternatives(names)})", to)
    return text


def uid_pattern(uid: str) -> str:
    """An account id in full, or its body between other symbols where that has ten symbols at least."""
    body = re.sub(r"-[A-Za-z0-9]$", "", uid.removeprefix("u_"))
    short = rf"|@?(?<![A-Za-z0-9]){re.escape(body)}(?![A-Za-z0-9])" if len(body) >= 10 else ""
    return f"@?{re.escape(uid)}{short}"


def rewrite_uids(text: Column, own: Sequence[str], other: Sequence[str]) -> Column:
    """Known account ids as you and me, any other as someone."""
    for uids, to in ((own, "@你"), (other, "@我")):
        for uid in filter(None, uids):
            text = F.regexp_replace(text, uid_pattern(uid), to)
    return F.regexp_replace(text, GENERIC_UID, "@某人")


def luhn_valid(card: Column) -> Column:
    """13 to 19 digits, spaces and hyphens aside, whose check digit is right."""
    digits = F.regexp_replace(card, "[ -]", "")
    return digits.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", digits)


def national_id_valid(text: Column) -> Column:
    """An 18-symbol id with a date from 1900 to 2099 and the right check symbol (ISO 7064, 11-2)."""
    weights = F.array(*[F.lit((1 << (17 - i)) % 11) for i in range(17)])
    digits = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.substr(text, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.zip_with(digits, weights, lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    check = F.substr(F.lit("10X98765432"), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    date = F.try_to_timestamp(F.substring(text, 7, 8), F.lit("yyyyMMdd"))
    fine = text.rlike(r"^[0-9]{6}(?:19|20)[0-9]{9}[0-9Xx]$") & date.isNotNull() & (F.upper(F.substring(text, 18, 1)) == check)
    return F.coalesce(fine, F.lit(False))


_WORD = r"\p{L}\p{N}_"
# fixed values: private data in the order of replacement, as (name, pattern, replacement, test of a match);
# a look at the first digit comes before the look behind, as most symbols of a text fail there
PRIVATE = (
    ("id_card", rf"(?=[1-9])(?<![{_WORD}])[1-9][0-9]{{5}}(?:18|19|20)[0-9]{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{{3}}[0-9Xx](?![{_WORD}])", "[身份证]", national_id_valid),
    ("bank_card", rf"(?=[0-9])(?<![{_WORD}])(?:[0-9][ -]?){{15,18}}[0-9](?![{_WORD}])", "[银行卡]", luhn_valid),
    ("mobile", r"(?=1)(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "[手机号]", None),
    # a run of local-part symbols is tried from its first word symbol only, so long words cost one pass
    ("email", rf"(?<![{_WORD}.+-])([.+-]*)[{_WORD}][{_WORD}.+-]*@[{_WORD}-]+(?:\.[{_WORD}-]+)*\.[{_WORD}-]*[{_WORD}]", "$1[邮箱]", None),
    ("ipv4", rf"(?=[0-9])(?<![{_WORD}])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![{_WORD}])", "[IP]", None),
)
#: What a text must hold for a rule to be tried at all.
_NEEDS = {"email": "@"}


def _where_needed(text: Column, needed: str, pattern: str, replacement: str) -> Column:
    return once(text, lambda t: F.when(F.contains(t, F.lit(needed)), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def redact_private(text: Column, rules: Sequence[tuple[str, str]] = ()) -> Column:
    """Own ``rules`` (pattern, replacement) first, then ``PRIVATE`` in order."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    for name, pattern, replacement, valid in PRIVATE:
        if valid is not None:
            text = replace_where(text, pattern, valid, replacement)
        elif name in _NEEDS:
            text = _where_needed(text, _NEEDS[name], pattern, replacement)
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_message(text: Column, kind: Column, raw_type: Column, placeholders: Column, own_names: Sequence[str] = (), other_names: Sequence[str] = (), own_uids: Sequence[str] = (), other_uids: Sequence[str] = (), rules: Sequence[tuple[str, str]] = (), private: bool = True, keep_faces: bool = False) -> Column:
    """A message's text in the fixed order of steps.

    Recalled messages become their token, system messages keep their text or get
    one. Others lose control marks, get brackets (not on platforms where brackets are
    text), mentions and ids rewritten, their missing placeholders appended, private
    data replaced, and a token where nothing is left.
    """
    raw = F.coalesce(text, F.lit(""))
    kind_of, given = F.coalesce(raw_type, F.lit("")), F.coalesce(placeholders, F.array().cast("array<string>"))
    out = F.regexp_replace(raw, CONTROL, "")
    out = once(out, lambda t: F.when(kind_of.rlike("^(?:discord_|telegram_|whatsapp_)"), t).otherwise(normalize_brackets(t, keep_faces)))
    out = rewrite_uids(rewrite_mentions(out, own_names, other_names), own_uids, other_uids)
    out = F.aggregate(given, out, lambda acc, p: F.when(F.contains(acc, p), acc).when(acc == "", p).otherwise(strip(F.concat(acc, F.lit(" "), p))))
    out = redact_private(out, rules) if private else out
    unknown = F.concat(F.lit("["), F.coalesce(F.nullif(kind_of, F.lit("")), F.lit("未知消息")), F.lit("]"))
    instead = F.when((kind == "placeholder") & (F.size(given) > 0), F.get(given, F.lit(0))).when(kind == "unknown", unknown).otherwise("")
    out = once(strip(out), lambda t: F.when(t == "", strip(instead)).otherwise(t))
    system = F.coalesce(F.nullif(strip(raw), F.lit("")), F.lit("[系统消息]"))
    return F.when(kind == "recalled", "[撤回]").when(kind == "system", system).otherwise(out)


# predicates -------------------------------------------------------------------------------------


def chunkable(kind: Column, text: Column) -> Column:
    """A message that can stand in an index: text beside placeholders, not recalled, not a system message."""
    rest = strip(F.regexp_replace(text, _tokens(L.EMPTY_TOKENS), ""))
    return (strip(text) != "") & ~kind.isin("recalled", "system") & ((kind != "placeholder") | (rest != ""))


def persona_useful(kind: Column, text: Column) -> Column:
    """A message that language statistics count."""
    return ~kind.isin("recalled", "system", "placeholder") & (strip(text) != "")


def usable_text(text: Column) -> Column:
    """Text that isn't one lone placeholder."""
    alone = "(?i)^" + _tokens(L.STAT_TOKENS + L.STAT_TOKENS_EN) + "$"
    return (strip(text) != "") & ~strip(text).rlike(alone)


_LOW_TOKENS = r"\[(?:图片|语音|视频|文件|表情|动画表情|撤回|系统消息)\]|\[\[[^\]]+\]\]"
_STICKER, _PART_STICKER = r"\[sticker(?::|=)[^\]\s]+\]", r"\s*\[sticker(?::|=)[^\]\s]*$"


def low_signal(text: Column) -> Column:
    """Nothing left without placeholders, stickers, the beginning of one, and noise."""
    for pattern in (_LOW_TOKENS, _STICKER, _PART_STICKER, L.NOISE.replace(r"\s", r"\s\p{Z}")):
        text = F.regexp_replace(text, pattern, "")
    return text == ""


def short_query(text: Column) -> Column:
    """A short question without noise, other wordings as one."""
    text = F.regexp_replace(text, L.NOISE.replace(r"\s", r"\s\p{Z}"), "")
    for other, one in L.QUESTION_ALIASES:
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def echoes(query: Column, candidate: Column) -> Column:
    """Whether a candidate only repeats a question that is risky to echo."""
    asked = short_query(query)
    return asked.isin(*L.ECHO_RISKS) & (short_query(F.regexp_replace(candidate, _LOW_TOKENS, "")) == asked)


def window_has_signal(text: Column, names: Sequence[str]) -> Column:
    """Whether a line of one of ``names`` says something; windows without speakers count as plain text."""
    plain = ~text.rlike("[:：]")
    heads = [n + ":" for n in names if n]
    if not heads:
        return F.when(plain, ~low_signal(text)).otherwise(F.lit(False))
    head = "^(?:" + "|".join(re.escape(h) for h in heads) + ")"
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), strip)
    said = F.exists(lines, lambda x: x.rlike(head) & ~low_signal(strip(F.regexp_replace(x, head, ""))))
    return F.when(plain, ~low_signal(text)).otherwise(said)


# text for statistics and for show ---------------------------------------------------------------


def squeeze(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))


def statistics_text(text: Column, keep_faces: bool = False) -> Column:
    """Text without placeholders and bracketed names, for counts of words."""
    text = F.regexp_replace(text, _tokens(L.STAT_TOKENS), " ")
    return F.replace(text, F.lit("[/表情]"), F.lit(" ")) if keep_faces else F.regexp_replace(text, r"\[[^\[\]\n]{1,12}\]", " ")


def shown_text(text: Column) -> Column:
    """Text without placeholders, squeezed."""
    return squeeze(F.regexp_replace(text, _tokens(L.STAT_TOKENS), " "))


def truncate(text: Column, limit: int) -> Column:
    """Squeezed text, cut before ``limit`` symbols with an ellipsis where it is longer."""
    text = squeeze(text)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("..."))).otherwise(text)


_OUTPUT_STEPS = (
    r"\[回复[^\n\]]*(?:图片|语音|视频|文件|表情|动画表情)[^\n\]]*\]\s*[:：]?\s*",
    r"(?is)\s*(?:<life-(?:event|update)>.*?(?:</life-(?:event|update)>|$)|</life-(?:event|update)>)\s*",
    r"(?is)\s*(?:<schedule-hint>.*?(?:</schedule-hint>|$)|</schedule-hint>)\s*",
    r"\[(?:图片|语音|视频|文件|表情|动画表情|撤回|系统消息)(?:[:：][^\]]*)?\]\s*[:：]?\s*",
    r"\[\[[^\]]+\]\]\s*[:：]?\s*",
    r"\[/[^\]\n]{1,16}\]\s*[:：]?\s*",
    _PART_STICKER,
)


def sanitize_reply(text: Column, stickers: Sequence[str] | None = None, fallback: str = "Mm") -> Column:
    """A reply without protocol blocks, copied placeholders and unknown stickers.

    ``stickers`` None keeps every sticker. A text of which nothing is left is ``fallback``.
    """
    out = text
    for pattern in _OUTPUT_STEPS:
        out = F.regexp_replace(out, pattern, "")
    if stickers is not None:
        known = r"(?!(?:" + "|".join(map(re.escape, stickers)) + r")\])" if stickers else ""
        out = F.regexp_replace(out, r"\[sticker(?::|=)" + known + r"[^\]\s]+\]", "")
    lines = F.transform(F.split(F.regexp_replace(out, "[ \t]{2,}", " "), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s,，.。:：;；、~～]+", ""), rf"{_SPACE}+$", ""))
    out = strip(F.array_join(lines, "\n"))
    return F.when((out == "") & (strip(text) != ""), F.lit(fallback)).otherwise(out)


def tag_blocks(text: Column, tags: Sequence[str], most: int = 5, budget: int = 6400, each: int = 1200) -> Column:
    """Distinct contents of ``<tag>..</tag>`` blocks in order, ``most`` at most, cut to ``each`` and to ``budget`` symbols in all."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<(?:" + "|".join(tags) + r")>(.*?)</(?:" + "|".join(tags) + ")>"), F.lit(1))
    items = F.slice(F.array_distinct(F.filter(F.transform(found, squeeze), lambda x: x != "")), 1, most)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        apart = F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        room = F.lit(budget) - acc["used"] - apart
        cut = F.substr(x, F.lit(1), F.least(F.lit(each), room))
        return F.when(room > 0, F.struct(F.concat(acc["kept"], F.array(cut)).alias("kept"), (acc["used"] + apart + F.length(cut)).alias("used"))).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def stickers_of(text: Column) -> Column:
    """Names of the sticker tokens in a text."""
    return F.regexp_extract_all(text, F.lit(r"\[sticker(?::|=)([^\]\s]+)\]"), F.lit(1))


def sticker_only(text: Column) -> Column:
    """Whether a text has stickers and fewer than two symbols beside them."""
    rest = F.regexp_replace(F.regexp_replace(text, _STICKER, ""), r"\[sticker(?::|=)[^\]\s]*$", "")
    return F.contains(text, F.lit("[sticker:")) & (F.length(F.regexp_replace(rest, r"[\s,，.。:：;；、~～!！?？…·\-—]+", "")) < 2)


def warmth(text: Column, lexicon: Sequence[str] = L.WARMTH, full: int = 4) -> Column:
    """Share of ``full`` entries of the lexicon that occur in a text, at most 1."""
    hits = sum((F.contains(text, F.lit(x)).cast("int") for x in lexicon), F.lit(0))
    return F.least(F.lit(1.0), hits / full)


def opening_type(text: Column, hour: Column | None = None) -> Column:
    """Class of an opening message, by the first rule of ``OPENINGS`` that fits; night first."""
    text = strip(text)
    out = F.when(text == "", "other")
    if hour is not None:
        out = out.when(((hour >= 23) | (hour < 6)) & text.rlike("(?iu)" + L.NIGHT), "night_ping")
    for name, pattern in L.OPENINGS:
        out = out.when(text.rlike("(?iu)" + pattern), name)
    back = F.startswith(text, F.lit("[回复")) | ((F.length(text) <= 24) & text.rlike(L.BACK_REFERENCE)) | ((F.length(text) <= 100) & text.rlike("(?iu)" + L.BACK_REFERENCE_EN))
    short = (F.length(text) <= 8) & (text.rlike(r"^\p{Nd}+$") | F.lower(text).isin("hi", "hey") | text.rlike(rf"^[{_WORD}]{{1,4}}[~～!！。]?$"))
    return out.when(back, "continue_topic").when(short, "short_ping").otherwise("other")


def scene(text: Column) -> Column:
    """The first of ``SCENES`` whose phrases occur, else casual."""
    low, out = F.lower(text), F.lit("casual")
    for name, phrases, bounded in reversed(L.SCENES):
        anywhere = "|".join(re.escape(p.lower()) for p in phrases)
        words = "|".join(re.escape(p) for p in bounded)
        out = F.when(low.rlike(rf"{anywhere}|(?<![{_WORD}])(?:{words})(?![{_WORD}])"), name).otherwise(out)
    return out


def burst_probability(query: Column, has_samples: Column) -> Column:
    """How often a playful reply style may be borrowed for a query."""
    on = lambda p: query.rlike("(?iu)" + p)
    return F.when(~has_samples, 0.0).when(on(L.SERIOUS_TONE), 0.0).when(on(L.BURST), 0.45).when(on(L.LIGHT_TONE), 0.18).otherwise(0.05)


def is_burst(text: Column) -> Column:
    """Whether a reply is of the playful, chaotic kind."""
    text = shown_text(text)
    return text.rlike("(?iu)" + L.BURST) | ((F.length(text) <= 12) & text.rlike(L.BURST_SHORT))
