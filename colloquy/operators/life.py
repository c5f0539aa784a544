"""The daily life of a person: plans, what holds at a time, when a state is due, and what a decision makes of it.

Times of plans and states are texts without a zone, read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import squeeze, strip
from ..functions.scalars import clamp, default_update_ms, json_object, night_hour, parse_int, time_slot
from .intervals import first_interval

# fixed values: states of availability, and words that call for a new state
AVAILABILITIES = ("available", "busy", "sleeping", "away")
INTERRUPTS = ("在干嘛", "在干什么", "干嘛呢", "忙吗", "吃了吗", "吃饭", "睡了吗", "睡了没", "醒了吗", "起了吗", "起床", "怎么还没睡", "你呢", "what are you doing", "are you busy", "have you eaten", "are you awake", "are you asleep")
SLEEPLESS = ("睡不着", "没睡", "还没睡", "熬夜", "睡不下", "失眠", "can't sleep", "cannot sleep", "still awake", "insomnia", "staying up")
WOKEN = ("half-awake", "half awake", "woken", "just woke", "drowsy", "checking phone", "叫醒", "半醒", "迷糊", "看手机", "睁眼", "翻身", "翻了个身", "迷迷糊糊", "刚醒", "醒着")
PLAN_FIELDS = ("id", "from", "to", "activity", "availability", "topic")
FIELD_SYMBOLS, PLAN_ITEMS, TIMELINE = 80, 12, 80
WOKEN_MS, SHORTEST_MS, LONGEST_MS = 25 * 60_000, 10 * 60_000, 10 * 3_600_000


def plan_ms(text: Column) -> Column:
    """Milliseconds of a plan's time: date and minute, with a blank or T, seconds, or ISO 8601; null for others."""
    t = strip(text)
    short = F.substring(t, 1, 19)
    tries = [F.try_to_timestamp(short, F.lit(p)) for p in ("yyyy-M-d H:m", "yyyy-M-d'T'H:m", "yyyy-M-d H:m:s")]
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?$"), F.regexp_replace(t, r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", "").try_cast("timestamp"))
    return F.unix_millis(F.coalesce(*tries, iso))


def shown_ms(ms: Column) -> Column:
    """A time as plans write it."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def availability(text: Column) -> Column:
    """A known state; ``available`` for others."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.when(t.isin(*AVAILABILITIES), t).otherwise("available")


def _says(text: Column, words: tuple[str, ...]) -> Column:
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def _text(item: Column, path: str) -> Column:
    """A field that is text, else null."""
    v = F.try_variant_get(item, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def daily_plan(items: Column) -> Column:
    """The valid items of a proposed plan (a variant array), twelve at most.

    An item has all ``PLAN_FIELDS`` as text that isn't blank, and times that parse. Fields
    are cut to 80 symbols; a state that isn't known is ``available``.
    """
    field = lambda x, f: F.substring(strip(F.coalesce(_text(x, f"$.{f}"), F.lit(""))), 1, FIELD_SYMBOLS)
    rows = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.struct(*[field(x, f).alias(f) for f in PLAN_FIELDS]))
    known = F.filter(rows, lambda r: F.forall(F.array(*[r[f] for f in PLAN_FIELDS]), lambda t: t != "") & plan_ms(r["from"]).isNotNull() & plan_ms(r["to"]).isNotNull())
    return F.slice(F.transform(known, lambda r: r.withField("availability", availability(r["availability"]))), 1, PLAN_ITEMS)


def plan_rows(plans: DataFrame, key: str, plan: str = "plan") -> DataFrame:
    """One row per item of a plan (array of structs): key, place, its fields, from_ms and to_ms."""
    rows = plans.select(key, F.posexplode(plan).alias("place", "x")).select(key, "place", *[F.col(f"x.{f}").alias(f"plan_{f}") for f in PLAN_FIELDS])
    return rows.withColumns({"from_ms": plan_ms(F.col("plan_from")), "to_ms": plan_ms(F.col("plan_to"))})


def planned(points: DataFrame, rows: DataFrame, key: str, point_id: str, at: str) -> DataFrame:
    """Points in time with the first item of their key's plan that holds then; both ends belong to an item."""
    return first_interval(points, rows, key, point_id, at, "from_ms", "to_ms", ["place"])


def update_due(now_ms: Column, current: Column, text: Column, trigger: Column, before: Column, interval_minutes: int, wake: Column, sleep: Column, samples: Column) -> Column:
    """Whether a life state is decided anew.

    ``current`` is a struct of updated_at and next_update_at (texts), null without a state.
    In this order: no state; a proactive trigger that isn't manual; a state as old as
    ``interval_minutes`` (if positive; one whose time doesn't parse is old); due or without
    a time; then, with something said: asleep, words that ask, sleepless words at night.
    """
    updated = F.nullif(current["updated_at"], F.lit(""))
    stale = F.lit(False) if interval_minutes <= 0 else updated.isNotNull() & F.coalesce(now_ms - plan_ms(updated) >= interval_minutes * 60_000, F.lit(True))
    due = F.coalesce(now_ms >= plan_ms(current["next_update_at"]), F.lit(True))
    said = strip(F.coalesce(text, F.lit(""))) != ""
    hour = F.floor(F.pmod(now_ms, F.lit(86_400_000)) / 3_600_000).cast("int")
    asked = (before == "sleeping") | _says(text, INTERRUPTS) | (night_hour(hour, wake, sleep, samples) & _says(text, SLEEPLESS))
    trigger = F.coalesce(trigger, F.lit(""))
    return F.when(current.isNull(), True).when(F.startswith(trigger, F.lit("proactive")) & (trigger != "proactive:manual"), True).when(stale | due, True).otherwise(F.coalesce(said & asked, F.lit(False)))


_DECIDED = ("current_activity", "current_event_id", "recent_meal", "mood", "availability", "topic_seed", "next_update_at", "reply_delay_reason", "reason")


def decision(answer: Column) -> Column:
    """The fields of a model's decision as a struct of texts, reply_delay_seconds and plan; null if there is none or it says not to apply."""
    v = F.try_parse_json(json_object(answer))
    fields = [F.nullif(F.substring(squeeze(_text(v, f"$.{f}")), 1, FIELD_SYMBOLS), F.lit("")).alias(f) for f in _DECIDED]
    plan = daily_plan(F.try_variant_get(v, "$.daily_plan", "array<variant>"))
    out = F.struct(*fields, F.try_variant_get(v, "$.reply_delay_seconds", "string").alias("reply_delay_seconds"), plan.alias("plan"))
    refused = F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.apply", "variant")) == "BOOLEAN") & ~F.try_variant_get(v, "$.apply", "boolean"), F.lit(False))
    return F.when(v.isNotNull() & ~refused, out)


def next_update(now_ms: Column, proposed: Column, state: Column, activity: Column) -> Column:
    """Milliseconds of the next update: as proposed or by default, 10 minutes to 10 hours away, 25 minutes at most if woken from sleep."""
    at = now_ms + clamp(F.coalesce(plan_ms(proposed), default_update_ms(now_ms, state)) - now_ms, SHORTEST_MS, LONGEST_MS)
    return F.when((state == "sleeping") & _says(activity, WOKEN), F.least(at, now_ms + WOKEN_MS)).otherwise(at)


def applied(rows: DataFrame, max_delay: int, now: str = "now_ms", patch: str = "patch", before: str = "before", event: str = "plan_id") -> DataFrame:
    """Rows with the state that a decision makes: ``state``.

    ``patch`` is a :func:`decision`, ``before`` a struct of activity, meal, mood, topic and
    event_id that stands in for what the decision leaves out, ``event`` the item of the
    plan that holds at the time.
    """
    p, b, at = F.col(patch), F.col(before), F.col(now)
    state = availability(p["availability"])
    activity = F.coalesce(p["current_activity"], b["activity"])
    hour = F.floor(F.pmod(at, F.lit(86_400_000)) / 3_600_000).cast("int")
    due = next_update(at, p["next_update_at"], state, activity)
    new = F.struct(
        time_slot(hour).alias("time_slot"), F.coalesce(p["current_event_id"], F.nullif(b["event_id"], F.lit("")), F.col(event), F.lit("")).alias("event_id"), activity.alias("activity"), F.coalesce(p["recent_meal"], b["meal"]).alias("meal"),
        F.coalesce(p["mood"], b["mood"]).alias("mood"), F.coalesce(p["topic_seed"], b["topic"]).alias("topic"), state.alias("availability"), shown_ms(due).alias("next_update_at"),
        clamp(parse_int(F.coalesce(p["reply_delay_seconds"], F.lit("0"))), 0, max_delay).alias("reply_delay_seconds"), F.coalesce(p["reply_delay_reason"], p["reason"], F.lit("")).alias("reply_delay_reason"), F.coalesce(p["reason"], F.lit("")).alias("reason"),
        F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
    )
    return rows.withColumn("state", F.when(p.isNotNull(), new))


def timeline(states: DataFrame, key: str, at: str, most: int = TIMELINE) -> DataFrame:
    """The last ``most`` states of each key, oldest first."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    rows = states.withColumn("_n", place).where(F.col("_n") <= most)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(at))).drop("_n")


def habit_candidates(items: DataFrame, owner: str = "owner", least: float = 0.5, most: int = 6) -> DataFrame:
    """The surest habits of an owner's friend that aren't sensitive, for a day's plan.

    ``items`` has owner, subject, claim, confidence, sensitive and, if they are told,
    target_fields (an array): habits that bear on none of a state's fields are left out.
    """
    fine = (F.col("subject") == "friend") & (F.col("confidence") >= least) & ~F.coalesce("sensitive", F.lit(False)) & (strip(F.coalesce("claim", F.lit(""))) != "")
    if "target_fields" in items.columns:
        fine = fine & (F.size(F.coalesce("target_fields", F.array().cast("array<string>"))) > 0)
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("confidence"), "claim"))
    return items.where(fine).withColumn("place", place).where(F.col("place") <= most)
