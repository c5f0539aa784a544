"""When a person writes first: scheduling profiles from messages, stored windows or reports, and the quality of their data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.cleaning import squeeze, strip
from .sequence import gap_bucket, human_ends, session_summary

# fixed values: what profiles weigh, and which openings have a topic
BUCKETS = ("short", "one_to_three_hours", "three_to_eight_hours", "overnight", "multi_day")
SPEAKERS = ("friend", "self", "other", "unknown")
OPENING_TYPES = ("greeting", "life_check", "care", "continue_topic", "self_share", "playful", "affection", "wake_ping", "short_ping", "question_probe", "night_ping", "other")
SPECIFIC_TYPES = ("care", "continue_topic", "self_share", "question_probe")
OPENING_TOKENS, REPLY_TOKEN, WORD_SYMBOL = r"\[(?:图片|表情|动画表情|语音|视频|文件|撤回)\]", r"\[回复[^\]]*\]", "[A-Za-z0-9一-鿿]"


# lines and sessions ------------------------------------------------------------------------------


def timed_line(at_ms: Column, role: Column, text: Column, zone: str = "UTC") -> Column:
    """A message with its local time and role, as analyses read it."""
    return F.concat(F.lit("["), F.date_format(F.from_utc_timestamp(F.timestamp_millis(at_ms), zone), "yyyy-MM-dd HH:mm"), F.lit("] "), role, F.lit(": "), text)


def speaker_lines(text: Column, friends: Sequence[str] = (), own: Sequence[str] = ()) -> Column:
    """Rendered lines as structs of role and text; a line without a colon, of either form, is none.

    The part before the first colon names the speaker: one of ``friends`` or TA, one of
    ``own`` or Me, else another.
    """
    friends, own = [*friends, "TA", "ta"], [*own, "Me", "User", "我", "用户"]

    def line(x: Column) -> Column:
        name = strip(F.regexp_extract(x, "(?s)^(.*?)[:：]", 1))
        said = strip(F.regexp_extract(x, "(?s)^.*?[:：](.*)$", 1))
        return F.struct(F.when(name.isin(*friends), "friend").when(name.isin(*own), "self").otherwise("other").alias("role"), said.alias("text"))

    return F.transform(F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: x.rlike("[:：]")), line)


def ends_of_messages(sessions: DataFrame, keys: Sequence[str] = ("source", "session_no")) -> DataFrame:
    """Sessions with their bounds and first and last human line: source, session_id, start_ms, end_ms, first_ms, first and last."""
    bounds = session_summary(sessions).select(*keys, "session_id", "start_ms", "end_ms")
    ends = human_ends(sessions, C.usable_text(F.col("text")), keys)
    line = lambda side: F.when(F.col(f"{side}_role").isNotNull(), F.struct(F.col(f"{side}_role").alias("role"), strip(F.col(f"{side}_text")).alias("text")))
    return bounds.join(ends, list(keys), "left").select("source", "session_id", "start_ms", "end_ms", F.coalesce("first_ms", "start_ms").alias("first_ms"), line("first").alias("first"), line("last").alias("last"))


def ends_of_windows(windows: DataFrame, friends: Sequence[str] = (), own: Sequence[str] = ()) -> DataFrame:
    """The same from stored windows (source, session_id, start_ms, end_ms, text), which overlap.

    Windows of a session are its union: its bounds are theirs, its first line that of
    the earliest window with one, its last that of the latest. Windows without a session go.
    """
    rows = windows.where(F.coalesce("session_id", F.lit("")) != "").withColumn("_l", F.filter(speaker_lines(F.coalesce("text", F.lit("")), friends, own), lambda x: C.usable_text(x["text"])))
    some = F.size("_l") > 0
    first, last = F.when(some, F.element_at("_l", 1)), F.when(some, F.element_at("_l", -1))
    one = rows.groupBy("source", "session_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by(first, F.when(some, F.struct("start_ms", "end_ms"))).alias("first"), F.max_by(last, F.when(some, F.struct("end_ms", "start_ms"))).alias("last"),
    )
    return one.select("source", "session_id", "start_ms", "end_ms", F.col("start_ms").alias("first_ms"), "first", "last")


# profiles ----------------------------------------------------------------------------------------


def _short(text: Column, limit: int) -> Column:
    text = squeeze(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def opening_samples(ends: DataFrame, min_gap_minutes: int = 120, zone: str = "UTC") -> DataFrame:
    """Sessions after a pause that somebody opened: initiator, opened_ms, gap_minutes, idle_bucket, previous_speaker, opening_type, hour, weekday, opening, previous_tail."""
    w = Window.partitionBy("source").orderBy("start_ms", "end_ms", "session_id")
    rows = ends.withColumns({"_end": F.lag("end_ms").over(w), "_last": F.lag("last").over(w)})
    # whole minutes, towards zero
    gap = ((F.col("start_ms") - F.col("_end")) / 60_000).cast("long")
    rows = rows.withColumn("gap_minutes", gap).where((F.col("gap_minutes") >= min_gap_minutes) & F.col("first").isNotNull())
    local = F.from_utc_timestamp(F.timestamp_millis("first_ms"), zone)
    rows = rows.withColumns({"hour": F.hour(local), "weekday": F.weekday(local), "opening": F.col("first.text")})
    return rows.select(
        "source", "session_id", F.col("first.role").alias("initiator"), F.col("first_ms").alias("opened_ms"), "gap_minutes", gap_bucket(F.col("gap_minutes")).alias("idle_bucket"), F.coalesce("_last.role", F.lit("unknown")).alias("previous_speaker"),
        C.opening_type(F.col("opening"), F.col("hour")).alias("opening_type"), "hour", "weekday", _short(F.col("opening"), 80).alias("opening"), _short(F.coalesce("_last.text", F.lit("")), 80).alias("previous_tail"),
    )


def samples_of_report(openings: DataFrame, min_gap_minutes: int = 120) -> DataFrame:
    """The same from a report's openings (source, initiator, opened_ms, gap_minutes, opening_type, hour, weekday, opening, previous_tail); who spoke before isn't known."""
    rows = openings.where((F.col("gap_minutes") >= min_gap_minutes) & ((F.col("initiator") == "self") | C.usable_text(F.col("opening"))))
    return rows.withColumns({"idle_bucket": gap_bucket(F.col("gap_minutes")), "previous_speaker": F.lit("unknown"), "opening": _short(F.col("opening"), 80), "previous_tail": _short(F.col("previous_tail"), 80)})


def scheduling_profiles(samples: DataFrame, sessions: DataFrame, latest: int = 12) -> DataFrame:
    """One row per source: counts, smoothed weights of hours, weekdays, gaps, speakers and kinds, and the latest openings.

    ``samples`` are :func:`opening_samples`, ``sessions`` has source and total_sessions. A
    weight is (count + 1) / (peak + 1) with three places, and 0 without any sample.
    """
    friend = samples.where("initiator = 'friend'")
    dims = {"hour": [str(h) for h in range(24)], "weekday": [str(d) for d in range(7)], "idle_bucket": BUCKETS, "previous_speaker": SPEAKERS, "opening_type": OPENING_TYPES}
    cells = friend.select("source", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dims])).alias("x")).groupBy("source", "x.d", "x.v").agg(F.count("*").alias("n"))
    maps = cells.groupBy("source").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("d") == d, F.struct("v", "n")))).alias(f"_{d}") for d in dims])
    started = samples.groupBy("source").agg(F.count_if(F.col("initiator") == "friend").alias("sample_size"), F.count_if(F.col("initiator") == "self").alias("self_started_sessions"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("opened_ms"), "session_id" if "session_id" in samples.columns else "opening"))
    item = F.struct("_n", F.struct("opened_ms", "opening_type", "opening", "previous_tail").alias("x"))
    shown = friend.withColumn("_n", place).where(F.col("_n") <= latest).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(item)), lambda y: y["x"]).alias("samples"))
    rows = sessions.join(started, "source", "left").join(maps, "source", "left").join(shown, "source", "left")

    def weight(d: str, v: Column) -> Column:
        held = F.col(f"_{d}")
        peak = F.array_max(F.map_values(held))
        return F.when(held.isNull() | (F.size(held) == 0), 0.0).otherwise(F.round((F.coalesce(F.try_element_at(held, v), F.lit(0)) + 1) / (peak + 1), 3))

    listed = lambda d: F.transform(F.array(*[F.lit(v) for v in dims[d]]), lambda v: weight(d, v))
    named = lambda d: F.map_from_arrays(F.array(*[F.lit(v) for v in dims[d]]), listed(d))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "source", n("sample_size"), n("self_started_sessions"), n("total_sessions"), listed("hour").alias("hour_weights"), listed("weekday").alias("weekday_weights"), named("idle_bucket").alias("idle_gap_weights"), named("previous_speaker").alias("speaker_weights"),
        named("opening_type").alias("opening_type_weights"), F.coalesce("samples", F.array().cast("array<struct<opened_ms:bigint,opening_type:string,opening:string,previous_tail:string>>")).alias("samples"),
    )


def profile_of_messages(sessions: DataFrame, min_gap_minutes: int = 120, zone: str = "UTC") -> DataFrame:
    """Profiles from messages with their session."""
    ends = ends_of_messages(sessions)
    return scheduling_profiles(opening_samples(ends, min_gap_minutes, zone), ends.groupBy("source").agg(F.count("*").alias("total_sessions")))


def profile_of_windows(windows: DataFrame, friends: Sequence[str] = (), own: Sequence[str] = (), min_gap_minutes: int = 120, zone: str = "UTC") -> DataFrame:
    """Profiles rebuilt from stored windows."""
    ends = ends_of_windows(windows, friends, own)
    return scheduling_profiles(opening_samples(ends, min_gap_minutes, zone), ends.groupBy("source").agg(F.count("*").alias("total_sessions")))


def profile_of_report(openings: DataFrame, sessions: DataFrame, min_gap_minutes: int = 120) -> DataFrame:
    """Profiles from an analysis report's openings."""
    return scheduling_profiles(samples_of_report(openings, min_gap_minutes), sessions)


def first_with_samples(*ladder: DataFrame) -> DataFrame:
    """Of each source the first profile that has samples, else the first there is, and which one it is."""
    rows = None
    for k, profiles in enumerate(ladder):
        one = profiles.withColumn("rung", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.when(F.col("sample_size") > 0, 0).otherwise(1), "rung"))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def earliest_schedule_ms(now_ms: Column, idle_minutes: Column, quiet_end: Column, interval_seconds: int = 600, min_idle_minutes: float = 120) -> Column:
    """The earliest time of the next look: an interval away, once the pause is long enough, after the quiet hours."""
    base = F.lit(max(60, interval_seconds)).cast("long")
    rest = F.when(idle_minutes < min_idle_minutes, ((min_idle_minutes - idle_minutes) * 60).cast("long"))
    return F.greatest(now_ms + F.greatest(base, F.coalesce(rest, base)) * 1000, F.coalesce(quiet_end, now_ms))


def next_profile_ms(earliest_ms: Column, hour_weights: Column, weekday_weights: Column, zone: str = "UTC") -> Column:
    """The first time, in steps of a quarter of an hour within 36 hours, at which a person usually writes; the earliest where there is none.

    That is an hour with a weight of 0.45 and three quarters of the largest, on a weekday with any.
    """
    peak = F.array_max(hour_weights)
    steps = F.transform(F.sequence(F.lit(0), F.lit(36 * 4 - 1)), lambda k: earliest_ms + k.cast("long") * 900_000)
    local = lambda ms: F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    fits = lambda ms: (F.get(hour_weights, F.hour(local(ms))) >= F.greatest(F.lit(0.45), peak * 0.75)) & (F.get(weekday_weights, F.weekday(local(ms))) > 0)
    return F.when(peak > 0, F.coalesce(F.get(F.filter(steps, fits), F.lit(0)), earliest_ms)).otherwise(earliest_ms)


# quality -----------------------------------------------------------------------------------------


def opening_quality(openings: DataFrame, min_gap_minutes: int = 120, key: str = "source") -> DataFrame:
    """Metrics of the data behind a profile, what is wrong with it, and a verdict of three levels.

    ``openings`` has key, initiator, gap_minutes, opening, opening_type and reason (null
    where none was found; a missing column: none was asked for). Issues are codes in a
    fixed order; ratios have four places.
    """
    asked = "reason" in openings.columns
    bare = F.regexp_replace(squeeze(F.regexp_replace(F.regexp_replace(F.coalesce("opening", F.lit("")), OPENING_TOKENS, " "), REPLY_TOKEN, " ")), "^[。！？!?~～,，:： ]+|[。！？!?~～,，:： ]+$", "")
    symbols = F.regexp_count(bare, F.lit(WORD_SYMBOL))
    fits = (F.col("initiator") == "friend") & F.coalesce(F.col("gap_minutes") >= min_gap_minutes, F.lit(False))
    rows = openings.select(key, fits.alias("e"), (symbols > 0).alias("m"), F.coalesce(F.col("opening_type").isin(*SPECIFIC_TYPES) | (symbols >= 8), F.lit(False)).alias("s"), F.coalesce(F.col("opening").rlike(OPENING_TOKENS), F.lit(False)).alias("p"), (bare == "").alias("o"), (F.col("opening_type") == "other").alias("x"), (F.col("reason").isNotNull() if asked else F.lit(False)).alias("r"))
    on = lambda *c: F.count_if(F.forall(F.array("e", *c), lambda y: F.coalesce(y, F.lit(False))))
    one = rows.groupBy(key).agg(
        F.count("*").alias("total_openings"), on().alias("eligible"), on("m").alias("meaningful"), on("m", "s").alias("specific"), on("p").alias("placeholder"), on("o").alias("placeholder_only"), on("x").alias("_other"), on("r").alias("_attributed"),
    )
    ratio = lambda c: F.when(F.col("eligible") > 0, F.round(F.col(c) / F.col("eligible"), 4)).otherwise(0.0)
    one = one.withColumns({"meaningful_ratio": ratio("meaningful"), "specific_ratio": ratio("specific"), "placeholder_ratio": ratio("placeholder"), "other_ratio": ratio("_other"), "attribution_ratio": ratio("_attributed")})
    few, poor = F.col("eligible") < 12, F.col("meaningful_ratio") < 0.45
    issue = lambda cond, code: F.when(cond, F.lit(code))
    codes = F.array_compact(F.array(
        F.when(few, "too_few").when(F.col("eligible") < 30, "few"), F.when(poor, "meaningless").when(F.col("meaningful_ratio") < 0.7, "low_information"), issue(F.col("placeholder_ratio") > 0.35, "placeholders"), issue(F.col("specific_ratio") < 0.3, "unspecific"),
        issue(F.col("other_ratio") > 0.6, "unclassified"), issue(F.lit(asked) & (F.col("attribution_ratio") < 0.7), "unattributed"),
    ))
    risk = F.when((F.col("specific_ratio") < 0.3) | (F.col("meaningful_ratio") < 0.7), "high").when((F.col("placeholder_ratio") > 0.2) | (F.col("other_ratio") > 0.5), "medium").otherwise("low")
    one = one.withColumns({"issues": codes, "fallback_risk": risk})
    status = F.when(few | poor, "not_ready").when(F.size("issues") > 0, "limited").otherwise("ready")
    return one.withColumn("status", status).drop("_other", "_attributed")
