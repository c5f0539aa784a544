"""Joins of points in time with closed intervals.

Intervals are put in classes by their length, each class with buckets of its own
width, so an interval has at most ``FACTOR`` + 2 buckets and a point one in each class.
The join is one on equal keys: nothing is compared with all intervals of a key, and
neither the length of an interval nor one key with most rows makes it quadratic by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTOR = 16
#: Widths of buckets in milliseconds: a minute, 16 minutes and so on to about two years.
WIDTHS = tuple(60_000 * FACTOR**k for k in range(6))


def _bucket(at: Column, width: Column | int) -> Column:
    return F.floor(at / width).cast("long")


def interval_matches(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval of its key that holds it, both ends included.

    ``points`` and ``intervals`` share the name ``key`` and no other. Nulls and intervals
    that end before they begin match nothing.
    """
    length = F.col(end) - F.col(start)
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(length < w * FACTOR, w).otherwise(width)
    fine = intervals.where(F.col(start) <= F.col(end)).withColumn("_w", width)
    dealt = fine.withColumn("_b", F.explode(F.sequence(_bucket(F.col(start), F.col("_w")), _bucket(F.col(end), F.col("_w")))))
    classes = F.array(*[F.struct(F.lit(w).cast("long").alias("_w"), _bucket(F.col(at), w).alias("_b")) for w in WIDTHS])
    asked = points.where(F.col(at).isNotNull()).withColumn("_c", F.explode(classes)).select("*", "_c._w", "_c._b").drop("_c")
    joined = asked.join(dealt.withColumn("_w", F.col("_w").cast("long")), [key, "_w", "_b"])
    return joined.where(F.col(at).between(F.col(start), F.col(end))).drop("_w", "_b")


def first_interval(points: DataFrame, intervals: DataFrame, key: str, point_id: str, at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Every point with the columns of the first interval of its key that holds it, by ``order``; nulls where none does.

    The first of a point is an aggregate over its matches, so none is sorted.
    """
    taken = [c for c in intervals.columns if c != key]
    found = interval_matches(points.select(key, point_id, at), intervals, key, at, start, end)
    first = found.groupBy(point_id).agg(F.min_by(F.struct(*taken), F.struct(*order)).alias("_i"))
    return points.join(first, point_id, "left").select(*points.columns, *[F.col(f"_i.{c}").alias(c) for c in taken])


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The union of a key's intervals as disjoint ones: key, start, end and how many were merged; those that touch are one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(start) <= F.col(end)).withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    numbered = marked.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_n").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_n")
