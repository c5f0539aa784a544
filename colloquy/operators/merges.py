"""Merging of near-equal findings: greedy leaders within small groups.

Findings (events, observations, habits, signals) come a few for each block of
messages. Whether one joins a leader depends on the leaders before it, so a group
is folded in order by one task. Groups are what the rules compare at all: one
subject, one category, or a run of dates with no gap above the allowed days, so
their size doesn't grow with the number of owners.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams

SAME_EVENT, SAME_CLAIM, EVENT_DAYS = 0.48, 0.58, 3


def _distinct(items, most: int) -> list:
    return list(dict.fromkeys(x for x in items if x))[:most]


def _alike(a: dict, b: dict) -> float:
    """Jaccard similarity of the bigram sets of two rows."""
    x, y = a["_grams"], b["_grams"]
    return len(x & y) / len(x | y) if x and y else 0.0


def _filled(rows: DataFrame, texts: Sequence[str], numbers: dict[str, object], lists: Sequence[str]) -> DataFrame:
    """``rows`` without nulls in the columns that a fold compares: empty texts and lists, and the given numbers."""
    types = dict(rows.dtypes)
    empty = {c: F.lit("") for c in texts} | {c: F.lit(v).cast(types[c]) for c, v in numbers.items()} | {c: F.array().cast(types[c]) for c in lists}
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in empty.items()})


def _greedy(rows: list[dict], same: Callable[[dict, dict], bool], absorb: Callable[[dict, dict], None]) -> list[dict]:
    leaders: list[dict] = []
    for row in rows:
        leader = next((x for x in leaders if same(x, row)), None)
        if leader is None:
            leaders.append(dict(row))
        else:
            absorb(leader, row)
    return leaders


def _plain(frame: pd.DataFrame) -> list[dict]:
    rows = [{k: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for k, v in r.items()} for r in frame.to_dict("records")]
    for r in rows:
        r["_grams"] = frozenset(r["_grams"])
    return rows


def merge_events(events: DataFrame, owner: str = "owner") -> DataFrame:
    """Events of an owner within three days with one title, or alike texts, as one.

    ``events`` has owner, date (ISO text), title, summary, importance, kind and evidence
    (array). In order of date and falling importance each joins the first leader that
    fits; a more important one gives the leader its texts. Dates that don't parse
    never match. Evidence is distinct, five at most. Null texts and lists are empty, a
    null importance is 0.
    """
    events = _filled(events, ("title", "summary"), {"importance": 0}, ("evidence",))
    schema = events.select(owner, "date", "title", "summary", "importance", "kind", "evidence").schema
    names = schema.names
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")
    w = Window.partitionBy(owner).orderBy("_day")
    # a leader keeps its date, so events with a longer gap before them can't join an earlier one
    ready = events.select(*names, bigrams(F.concat("title", "summary")).alias("_grams")).withColumn("_day", day).withColumn("_new", F.when(F.datediff("_day", F.lag("_day").over(w)) <= EVENT_DAYS, 0).otherwise(1))
    ready = ready.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_day", "_new")

    def same(a: dict, b: dict) -> bool:
        try:
            near = abs((date.fromisoformat(a["date"]) - date.fromisoformat(b["date"])).days) <= EVENT_DAYS
        except (TypeError, ValueError):
            return False
        return near and (a["title"] == b["title"] or _alike(a, b) >= SAME_EVENT)

    def absorb(a: dict, b: dict) -> None:
        if b["importance"] > a["importance"]:
            a |= {k: b[k] for k in ("title", "summary", "importance", "kind", "_grams")}
        a["evidence"] = _distinct([*a["evidence"], *b["evidence"]], 5)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = _plain(frame[[*names, "_grams"]].sort_values(["date", "importance"], ascending=[True, False], kind="stable"))
        return pd.DataFrame(_greedy(rows, same, absorb), columns=names)

    return ready.groupBy(owner, "_group").applyInPandas(fold, schema)


def merge_claims(items: DataFrame, by: Sequence[str], lists: dict[str, int]) -> DataFrame:
    """Claims of one group (``by``) that are alike as one, the surest first.

    ``items`` has the group columns, claim, confidence and the array columns of
    ``lists``, which name how many distinct entries are kept. The first array is the
    evidence; of equally sure claims the one with more of it comes first. Null claims and
    lists are empty, a null confidence is 0.
    """
    items = _filled(items, ("claim",), {"confidence": 0}, list(lists))
    schema = items.select(*by, "claim", "confidence", *lists).schema
    names, evidence = schema.names, next(iter(lists))

    def absorb(a: dict, b: dict) -> None:
        a["confidence"] = max(a["confidence"], b["confidence"])
        for name, most in lists.items():
            a[name] = _distinct([*a[name], *b[name]], most)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = _plain(frame[[*names, "_grams"]])
        rows.sort(key=lambda r: (-r["confidence"], -len(r[evidence])))
        return pd.DataFrame(_greedy(rows, lambda a, b: _alike(a, b) >= SAME_CLAIM, absorb), columns=names)

    return items.select(*names, bigrams(F.col("claim")).alias("_grams")).groupBy(*by).applyInPandas(fold, schema)


def select_events(events: DataFrame, most: int = 100, owner: str = "owner") -> DataFrame:
    """The most important event of each month, then the most important others, ``most`` of an owner, by date."""
    month = F.substring("date", 1, 7)
    best = events.groupBy(owner, month.alias("month")).agg(F.max_by(F.struct("date", "title"), F.struct("importance", F.struct("date", "title"))).alias("_best"))
    marked = events.withColumn("month", month).join(best, [owner, "month"]).withColumn("is_best", F.struct("date", "title") == F.col("_best"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("is_best"), F.desc("importance"), F.desc("date"), F.desc("title")))
    return marked.withColumn("_n", place).where(F.col("_n") <= most).drop("_n", "_best", "month").orderBy(owner, "date", "title")


def strongest(items: DataFrame, cuts: dict[str, int], section: str = "section", owner: str = "owner") -> DataFrame:
    """The surest findings of each section of an owner, more evidence first, up to the section's number."""
    n = F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col(section))
    place = F.row_number().over(Window.partitionBy(owner, section).orderBy(F.desc("confidence"), F.desc(F.size("evidence")), "claim"))
    return items.withColumn("place", place).where(F.col("place") <= n)


def event_id(day: Column, kind: Column, title: Column) -> Column:
    """Stable id of a timeline event."""
    return F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws("\n", day, kind, title), 256), 1, 16))


def nearest_openings(openings: DataFrame, hour: int, weekday: int, most: int = 6, key: str = "source") -> DataFrame:
    """Openings closest to a time: same hour, same weekday, hours around the clock, then the latest."""
    apart = F.abs(F.col("hour") - hour)
    order = [F.desc(F.col("hour") == hour), F.desc(F.col("weekday") == weekday), F.least(apart, 24 - apart), F.desc("opened_ms")]
    return openings.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)
