"""Scalar functions of the conversation model: tolerant parsing, URLs, times, scores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import squeeze, strip

# tolerant parsing --------------------------------------------------------------------------------


def parse_int(text: Column, default: int = 0) -> Column:
    """A whole number from text, also from a decimal one (towards zero)."""
    t = strip(text.cast("string"))
    return F.coalesce(t.try_cast("long"), t.try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def parse_bool(text: Column) -> Column:
    """Whether text says yes; numbers other than 0 do."""
    t = F.lower(strip(text.cast("string")))
    return F.coalesce(t.isin("true", "1", "yes", "y", "t") | (F.coalesce(t.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


# fixed values: kinds of messages, and media kinds that become placeholders
KINDS = ("text", "reply", "placeholder", "recalled", "system", "unknown")
MEDIA_KINDS = ("image", "audio", "video", "file", "sticker")
ROLES = ("self", "friend", "system", "other")


def parse_kind(kind: Column, raw_type: Column) -> Column:
    """A message kind from its name, or from the platform's type."""
    k = F.lower(strip(F.coalesce(F.nullif(kind, F.lit("")), F.nullif(raw_type, F.lit("")), F.lit("text"))))
    return F.when(k.isin(*KINDS), k).when(k.isin(*MEDIA_KINDS), "placeholder").otherwise("unknown")


def parse_role(role: Column) -> Column:
    """One of the four roles, or null."""
    r = F.lower(strip(role))
    return F.when(r.isin(*ROLES), r)


def strict_json(text: Column) -> Column:
    """The one JSON value that a text holds, as a variant; null if it isn't JSON or something follows.

    Spark's parsers stop after the first value, so it is read as the only item of an
    array that is followed by a mark, which must be there.
    """
    mark = "_whole_d1f7"
    whole = F.try_parse_json(F.concat(F.lit('{"x":['), text, F.lit(f'],"{mark}":1}}')))
    one = (F.size(F.try_variant_get(whole, "$.x", "array<variant>")) == 1) & (F.try_variant_get(whole, f"$.{mark}", "int") == 1)
    return F.when(one, F.try_variant_get(whole, "$.x[0]", "variant"))


def strict_object(text: Column) -> Column:
    """:func:`strict_json` where the value is an object, else null."""
    return F.when(F.startswith(strip(text), F.lit("{")), strict_json(text))


def json_object(text: Column) -> Column:
    """The outermost JSON object in a model's answer, or null where none parses."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(strict_object(found).isNotNull(), found)


# fixed values: what a refusing model says
REFUSALS = ("against my guidelines", "can't help with", "cannot help with", "can't assist with", "cannot assist with", "无法协助", "不能协助", "无法帮助")


def is_refusal(text: Column) -> Column:
    """Whether an answer without any JSON object says no."""
    return ~F.contains(text, F.lit("{")) & F.lower(squeeze(text)).rlike("|".join(map(re.escape, REFUSALS)))


def label(mood: Column, topic: Column, importance: Column, moods: Sequence[str]) -> Column:
    """A label within its bounds: known moods, eight symbols of topic, importance 0 to 3 (1 if it doesn't parse)."""
    m, value = strip(F.coalesce(mood, F.lit(""))), strip(importance.cast("string"))
    whole = F.coalesce(value.try_cast("int"), value.try_cast("double").try_cast("int"), F.lit(1))
    return F.struct(F.when(m.isin(*moods), m).otherwise("unknown").alias("mood"), F.substring(strip(F.coalesce(topic, F.lit(""))), 1, 8).alias("topic"), F.greatest(F.lit(0), F.least(F.lit(3), whole)).alias("importance"))


def bounded_list(items: Column, most: int = 4, limit: int = 120, skip: Sequence[str] = ("...", "…", "无", "none", "null")) -> Column:
    """Squeezed entries without fillers, cut to ``limit`` symbols, the first ``most``."""
    clean = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: squeeze(F.coalesce(x, F.lit(""))))
    kept = F.slice(F.filter(clean, lambda x: (x != "") & ~F.lower(x).isin(*skip)), 1, most)
    return F.transform(kept, lambda x: F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 1), F.lit("…"))).otherwise(x))


def grounded(evidence: Column, source: Column, most: int = 4, limit: int = 300) -> Column:
    """Distinct evidence that occurs in a source text, white space aside."""
    bare = lambda t: F.regexp_replace(t, r"[\s\p{Z}]+", "")
    return F.slice(F.array_distinct(F.filter(F.transform(evidence, lambda x: F.substring(strip(x), 1, limit)), lambda x: (x != "") & F.contains(bare(source), bare(x)))), 1, most)


def known_ids(ids: Column, known: Column, most: int = 12) -> Column:
    """Distinct ids that are known, in their order."""
    return F.slice(F.array_distinct(F.filter(ids, lambda x: F.array_contains(known, x))), 1, most)


def memory_accepted(kind: Column, importance: Column, summary: Column, evidence: Column, said: Column, kinds: Sequence[str]) -> Column:
    """Whether a proposed memory of a relation counts: known kind, 1 to 3, a summary about the user of 6 to 120 symbols, evidence that was said."""
    about = squeeze(summary)
    return kind.isin(*kinds) & importance.between(1, 3) & about.rlike("^(?:用户|User )") & F.length(about).between(6, 120) & (F.length(squeeze(evidence)) >= 4) & F.contains(squeeze(said), squeeze(evidence))


# URLs --------------------------------------------------------------------------------------------

_STOP = r"""\s<>'"，。！？、；：）)】"""
URL = rf"(?i)https?://[^{_STOP}]+"
# fixed values: top-level domains of addresses without a scheme
TOP_LEVEL = ("com", "cn", "net", "org", "top", "io", "dev", "app", "me", "xyz", "site", "ai", "cc", "club", "info", "wiki", "tech", "ink")
BARE = rf"(?i)(?<![@\p{{L}}\p{{N}}_.-])(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{'|'.join(TOP_LEVEL)})(?::[0-9]{{1,5}})?(?:/[^{_STOP}]*)?"
_TAIL = r"[，。！？、,.!?;；：:]+$"


def urls(text: Column, limit: int = 5) -> Column:
    """Distinct addresses of a text in order, full ones and bare domains; no trailing marks.

    Full addresses are blanked before bare domains are sought, so that none overlaps.
    """
    full = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, _TAIL, ""))
    # one pass over both keeps the order: what a blanked address leaves is never a domain
    both = F.regexp_extract_all(text, F.lit(f"(?:{URL})|(?:{BARE})"), F.lit(0))
    shown = F.transform(both, lambda u: F.when(u.rlike("(?i)^https?://"), F.regexp_replace(u, _TAIL, "")).otherwise(F.concat(F.lit("https://"), F.regexp_replace(u, _TAIL, ""))))
    out = F.when(text.rlike(BARE), shown).otherwise(full)
    return F.slice(F.array_distinct(F.filter(out, lambda u: u != "")), 1, limit)


def safe_url(url: Column) -> Column:
    """An http(s) address whose host is neither this machine nor a private or special literal address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    host = F.regexp_replace(host, r"^\[|\]$", "")
    part = lambda i: F.get(F.split(host, r"\."), F.lit(i)).try_cast("int")
    is_v4 = host.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")
    a, b, c = part(0), part(1), part(2)
    special = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = host.contains(":")
    # an address as one number, in hex or octal, or shortened, is this or another machine in disguise
    odd_v4 = host.rlike(r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}\.?$") & (~is_v4 | host.rlike(r"(?:^|\.)0[0-9]"))
    special6 = host.rlike(r"^(?:::1?$|fe[89ab]|f[cd]|ff|::ffff:|2001:db8)")
    fine = F.lower(url).rlike("^https?://") & host.isNotNull() & (host != "") & ~F.regexp_replace(host, r"^\.+|\.+$", "").isin("localhost", "localhost.localdomain")
    return F.coalesce(fine & ~odd_v4 & ~(is_v4 & F.coalesce(special, F.lit(True))) & ~(v6 & special6), F.lit(False))


# times -------------------------------------------------------------------------------------------


def local_hour(timestamp_ms: Column, zone: str = "UTC") -> Column:
    """Hour of the day in a named zone."""
    return F.hour(F.from_utc_timestamp(F.timestamp_millis(timestamp_ms), zone))


def local_weekday(timestamp_ms: Column, zone: str = "UTC") -> Column:
    """Day of the week in a named zone, Monday 0."""
    return F.weekday(F.from_utc_timestamp(F.timestamp_millis(timestamp_ms), zone))


def minute_of_day(timestamp_ms: Column, zone: str = "UTC") -> Column:
    """Minutes since midnight in a named zone."""
    at = F.from_utc_timestamp(F.timestamp_millis(timestamp_ms), zone)
    return F.hour(at) * 60 + F.minute(at)


def quiet(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day is quiet: from ``start`` to before ``end``, over midnight if that is earlier."""
    if start == end:
        return F.lit(False)
    return (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)


def quiet_end_ms(timestamp_ms: Column, start: int, end: int) -> Column:
    """When the quiet hours that a time lies in end; null outside them (times in UTC)."""
    day = F.floor(timestamp_ms / 86_400_000) * 86_400_000
    candidate = (day + end * 60_000).cast("long")
    later = F.when(candidate <= timestamp_ms, candidate + 86_400_000).otherwise(candidate)
    return F.when(quiet(F.floor(timestamp_ms / 60_000) % 1440, start, end), later)


def night_hour(hour: Column, wake: Column, sleep: Column, samples: Column) -> Column:
    """Whether an hour is night for a person: outside the waking hours, 22 to 6 where they aren't known."""
    usual = (hour >= 22) | (hour < 6)
    return F.when((samples < 30) | (wake == sleep), usual).when(wake <= sleep, ~hour.between(wake, sleep)).otherwise((sleep < hour) & (hour < wake))


def night_band(share: Column) -> Column:
    """How late a person is up, by the share of messages at night."""
    return F.when(share >= 0.4, "night_owl").when(share >= 0.2, "late").otherwise("regular")


def zoned_iso(text: Column) -> Column:
    """Whether text is an ISO 8601 time with a zone."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])$")
    return F.coalesce(shape & F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm")).isNotNull(), F.lit(False))


# fixed values: what a recurrence rule may repeat by, and its keys
FREQUENCIES = ("SECONDLY", "MINUTELY", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "YEARLY")
RULE_KEYS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYSECOND", "BYMINUTE", "BYHOUR", "BYDAY", "BYMONTHDAY", "BYMONTH", "BYYEARDAY", "BYWEEKNO", "BYSETPOS", "WKST")


def recurrence(rule: Column) -> Column:
    """A recurrence rule in upper case if its parts are known and have a valid frequency, else null."""
    text = F.upper(strip(rule))
    parts = F.filter(F.split(text, ";"), lambda p: p != "")
    shaped = F.forall(parts, lambda p: p.rlike("^(?:" + "|".join(RULE_KEYS) + r")=[A-Z0-9,;:\-+]+$") & (~F.startswith(p, F.lit("FREQ=")) | F.substring(p, 6, 99).isin(*FREQUENCIES)))
    return F.when(shaped & F.exists(parts, lambda p: F.startswith(p, F.lit("FREQ="))), text)


def task_id(trigger: Column, rule: Column, message: Column) -> Column:
    """Stable id of a scheduled task."""
    return F.concat(F.lit("t_"), F.substring(F.sha2(F.concat_ws("|", trigger, F.coalesce(rule, F.lit("")), message), 256), 1, 8))


def clamp(x: Column, low, high) -> Column:
    """``x`` within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def next_update_ms(now_ms: Column, proposed_ms: Column, state: Column) -> Column:
    """The next update of a state: the proposed time or the default, ten minutes to ten hours away."""
    return now_ms + clamp(F.coalesce(proposed_ms, default_update_ms(now_ms, state)) - now_ms, 600_000, 36_000_000)


def time_slot(hour: Column) -> Column:
    """Part of the day."""
    return F.when(hour.between(5, 10), "morning").when(hour.between(11, 13), "noon").when(hour.between(14, 17), "afternoon").when(hour.between(18, 22), "evening").otherwise("night")


def default_update_ms(now_ms: Column, state: Column) -> Column:
    """The next turn of the day, or eight o'clock while asleep and at the end of the day (times in UTC)."""
    day = (F.floor(now_ms / 86_400_000) * 86_400_000).cast("long")
    at = lambda h, days=0: day + F.lit(h * 3_600_000 + days * 86_400_000).cast("long")
    turns = [F.when(at(h) > now_ms, at(h)) for h in (11, 14, 18, 23)]
    return F.when(state == "sleeping", F.when(at(8) > now_ms, at(8)).otherwise(at(8, 1))).otherwise(F.coalesce(*turns, at(8, 1)))


# scores ------------------------------------------------------------------------------------------

# fixed values: weights of the features of an opportunity to write first
FEATURE_WEIGHTS = {"time_match": 0.24, "weekday_match": 0.08, "idle_gap_match": 0.2, "previous_speaker_match": 0.12, "opening_confidence": 0.12, "availability": 0.12, "evidence": 0.12}
AVAILABILITY = {"available": 1.0, "idle": 0.9, "busy": 0.35, "sleeping": 0.15, "away": 0.25, "unavailable": 0.2}


def feature_score(features: Mapping[str, Column]) -> Column:
    """Weighted sum of features, each within 0 and 1; missing ones count as 0."""
    return sum((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(features[k], F.lit(0.0)))) * w for k, w in FEATURE_WEIGHTS.items() if k in features), F.lit(0.0))


def availability_weight(state: Column) -> Column:
    """Weight of a life state; 0.75 without one, 0.65 for an unknown one."""
    out = F.when(state.isNull(), 0.75)
    for name, w in AVAILABILITY.items():
        out = out.when(state == name, w)
    return out.otherwise(0.65)


def reply_delay(should_reply: Column, life_delay: Column, decided_delay: Column, state: Column, sleeping_floor: int, most: int) -> Column:
    """Seconds to wait with a reply: the longer of two delays, a floor while asleep, within bounds."""
    raw = F.greatest(life_delay, decided_delay)
    raw = F.when(state == "sleeping", F.greatest(raw, F.lit(max(0, sleeping_floor)))).otherwise(raw)
    return F.when(should_reply, clamp(raw, 0, most)).otherwise(0)


# fixed values: names that provenance is shown by
SOURCE_LABELS = {
    "human_original": "Original chat excerpt", "human_original_image": "Historical image description", "history": "Original chat excerpt",
    "user_new": "Your recent messages", "ai_generated": "Previous AI reply", "live": "Runtime memory",
}


# fixed values: which provenance counts for what
PERSONA_SOURCES = ("human_original", "history")
CONTINUITY_SOURCES = ("user_new", "ai_generated", "live")


def persona_eligible(source: Column) -> Column:
    """Whether a row is evidence of how a person writes: only what people wrote themselves is."""
    return F.coalesce(source.isin(*PERSONA_SOURCES), F.lit(False))


def continuity_eligible(source: Column) -> Column:
    """Whether a row may be found again as part of a running conversation."""
    return F.coalesce(source.isin(*CONTINUITY_SOURCES), F.lit(False))


def cache_key(*parts: Column) -> Column:
    """Key of what was computed from some values: a digest of their JSON, nulls included."""
    named = [p.alias(f"p{i}") for i, p in enumerate(parts)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def source_label(source: Column) -> Column:
    """Shown name of a provenance."""
    known = F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(known, source), F.lit("Memory excerpt"))
