"""Descriptive statistics of messages, as combinable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import lexicons as L

MARKS = "[!?.,;:…~]"


def length_stats(messages: DataFrame, *keys: str) -> DataFrame:
    """Count, mean and median length, and the shares of short and long texts."""
    n = F.length("text")
    return messages.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"), F.avg((n < 8).cast("int")).alias("share_short"), F.avg((n > 30).cast("int")).alias("share_long"))


def punctuation_stats(messages: DataFrame, *keys: str) -> DataFrame:
    """Shares of messages with a mark, ending in one, asking and exclaiming."""
    share = lambda c: F.avg(c.cast("int"))
    text = F.col("text")
    return messages.groupBy(*keys).agg(
        F.sum(F.regexp_count(text, F.lit(MARKS))).alias("n_marks"), share(text.rlike(MARKS)).alias("share_with"), share(text.rlike(MARKS + r"\s*$")).alias("share_ending"),
        share(F.contains(text, F.lit("?"))).alias("share_asking"), share(F.contains(text, F.lit("!"))).alias("share_exclaiming"),
    )


_LONG = r"^[A-Za-z0-9_-]{15,}$"
_RUN = "[一-鿿]+|[A-Za-z]+"


def top_terms(messages: DataFrame, stopwords: tuple[str, ...], limit: int, least: int = 2, order: tuple[str, ...] = ("timestamp_ms", "seq")) -> DataFrame:
    """Most frequent words of text without placeholders, ties by first appearance.

    Words are runs of ideographs or of letters; stop words, words below ``least`` symbols
    and long runs as in ids and addresses don't count.
    """
    words = F.regexp_extract_all(F.lower(C.statistics_text(F.col("text"))), F.lit(_WORDS), F.lit(0))
    rows = messages.select(*order, F.posexplode(words).alias("pos", "term")).where((F.length("term") >= least) & ~F.col("term").isin(*stopwords) & ~F.col("term").rlike(_LONG))
    first = F.min(F.struct(*order, "pos"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), first.alias("_f")).orderBy(F.desc("n"), "_f", "term").limit(limit).select("term", "n")


_WORDS = "[一-鿿]+|[a-zß-öø-ÿ]+"


def top_phrases(messages: DataFrame, stopwords: tuple[str, ...], limit: int, sizes: tuple[int, ...] = (2, 3, 4), least: int = 2) -> DataFrame:
    """Most frequent parts of letter runs, stop words aside; the limit comes before the least count.

    Equal runs are counted before they are cut up.
    """
    runs = messages.select(F.explode(F.regexp_extract_all(C.statistics_text(F.col("text")), F.lit(_RUN), F.lit(0))).alias("run")).where((F.length("run") >= 2) & ~F.col("run").rlike(_LONG))
    runs = runs.groupBy("run").agg(F.count("*").alias("n"))
    gram = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - (n - 1)), lambda i: F.substr("run", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = runs.select("n", F.explode(F.concat(*[gram(n) for n in sizes])).alias("phrase")).where(~F.col("phrase").isin(*stopwords))
    return grams.groupBy("phrase").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "phrase").limit(limit).where(F.col("n") >= least)


def hourly_profile(messages: DataFrame, hour: Column, *keys: str) -> DataFrame:
    """Messages in each of the 24 hours, and the share of the busiest one's."""
    hours = messages.select(*keys).distinct() if keys else messages.sparkSession.range(1).select()
    domain = hours.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    counts = messages.withColumn("hour", hour).groupBy(*keys, "hour").agg(F.count("*").alias("n"))
    joined = domain.join(counts, [*keys, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    peak = F.max("n").over(Window.partitionBy(*keys)) if keys else F.max("n").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("level", F.when(peak > 0, F.round(F.col("n") / peak, 3)).otherwise(0.0))


def awake_range(profile: DataFrame, key: str, threshold: float = 0.35) -> DataFrame:
    """Longest circular run of hours at the threshold or above; the first of equal ones.

    No such hour, or all of them, gives the default 8 to 23.
    """
    double = profile.where(F.col("level") >= threshold).select(key, F.explode(F.array(F.col("hour"), F.col("hour") + 24)).alias("h"))
    w = Window.partitionBy(key).orderBy("h")
    runs = double.withColumn("_g", F.col("h") - F.row_number().over(w)).groupBy(key, "_g").agg(F.min("h").alias("start"), F.count("*").alias("n"))
    best = runs.groupBy(key).agg(F.max_by(F.struct("start", "n"), F.struct("n", -F.col("start"))).alias("b"))
    everyone = profile.select(key).distinct().join(best, key, "left")
    fine = F.col("b").isNotNull() & (F.col("b.n") < 24)
    return everyone.select(key, F.when(fine, F.pmod(F.col("b.start"), F.lit(24))).otherwise(8).cast("long").alias("wake_hour"), F.when(fine, F.pmod(F.col("b.start") + F.col("b.n") - 1, F.lit(24))).otherwise(23).cast("long").alias("sleep_hour"))


def smoothed_weights(counts: DataFrame, value: str) -> DataFrame:
    """(count + 1) / (peak + 1) of each value, 3 places; all zero without any count."""
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(value, "n", F.when(peak > 0, F.round((F.col("n") + 1) / (peak + 1), 3)).otherwise(0.0).alias("weight"))


def latency_stats(rows: DataFrame, kind: str, value: str, failed: Column) -> DataFrame:
    """Count, failures, and the order statistics n/2 and 0.95 n, not interpolated; nulls come first.

    Equal values are counted before anything is ordered, and the counts are summed by
    ranges of values, so the few kinds aren't sorted in a task each.
    """
    counts = rows.groupBy(kind, value).agg(F.count("*").alias("_c"), F.count_if(failed).alias("_f"))
    # ranges of equal width between the outer hundredths, and one beyond each; one row of bounds a kind
    bounds = rows.groupBy(kind).agg(F.percentile_approx(value, [0.005, 0.995], 1000).alias("_e"), F.count("*").alias("n"))
    place = F.coalesce(F.width_bucket(F.col(value).cast("double"), F.col("_e")[0].cast("double"), F.col("_e")[1].cast("double"), F.lit(64)), F.lit(0).cast("long"))
    low = F.when(F.col(value) < F.col("_e")[0], 0).when(F.col(value) >= F.col("_e")[1], 65).otherwise(place)
    dealt = counts.join(bounds, kind).withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(low))
    sums = dealt.groupBy(kind, "_range").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(kind).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(kind, "_range").orderBy(F.asc_nulls_first(value))
    placed = dealt.drop("_e").join(sums.withColumn("_before", before), [kind, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col(value)))
    return placed.groupBy(kind).agg(F.first("n").alias("n"), F.sum("_f").alias("n_failed"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95"))


def mark_counts(messages: DataFrame, limit: int = 15) -> DataFrame:
    """The most frequent punctuation marks; equal ones by the mark."""
    marks = messages.select(F.explode(F.filter(F.split("text", ""), lambda c: F.instr(F.lit(L.MARKS), c) > 0)).alias("mark")).where("mark != ''")
    return marks.groupBy("mark").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mark").limit(limit)


def mark_shares(messages: DataFrame, *keys: str) -> DataFrame:
    """Shares of messages with an ellipsis, a question, an exclamation, and without any mark; 3 places."""
    text = F.col("text")
    share = lambda c: F.round(F.avg(c.cast("int")), 3)
    some = F.translate(text, L.MARKS, "") != text
    return messages.groupBy(*keys).agg(share(text.rlike(r"…|\.\.\.")).alias("ellipsis"), share(text.rlike("[？?]")).alias("question"), share(text.rlike("[！!]")).alias("exclaim"), share(~some).alias("no_mark"))


def media_stats(messages: DataFrame, *keys: str) -> DataFrame:
    """Emoji a message, and shares with a placeholder, an image, a voice message; 3 places."""
    text = F.col("text")
    share = lambda c: F.round(F.avg(c.cast("int")), 3)
    token = r"\[(?:" + "|".join(L.STAT_TOKENS) + r")\]"
    return messages.groupBy(*keys).agg(F.round(F.avg(F.regexp_count(text, F.lit(L.EMOJI))), 3).alias("emoji"), share(text.rlike(token)).alias("placeholder"), share(F.contains(text, F.lit("[图片]"))).alias("image"), share(F.contains(text, F.lit("[语音]"))).alias("voice"))


def reply_profile(pairs: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """How replies look for each value of a key: count, confidence, mean length and five shares."""
    text, clean = F.col(reply), C.shown_text(F.col(reply))
    share = lambda c: F.round(F.avg(c.cast("int")), 3)
    n = F.count("*")
    return pairs.groupBy(key).agg(
        n.alias("n"), F.when(n >= 20, "high").when(n >= 8, "medium").otherwise("low").alias("confidence"), F.round(F.avg(F.length(clean)), 2).alias("mean_chars"), share(F.length(clean) < 8).alias("short"),
        share(text.rlike(L.QUESTION)).alias("question"), share(text.rlike(L.EMOJI)).alias("emoji"), share(F.contains(text, F.lit("[图片]"))).alias("image"), share(text.rlike("(?iu)" + L.INTIMACY)).alias("intimacy"),
    )


def burst_profile(pairs: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """How the playful, chaotic replies of each key look: count, confidence, mean length and shares; keys without any have no row."""
    some = pairs.where(C.is_burst(F.col(reply)))
    return reply_profile(some, key, reply).select(key, "n", "confidence", "mean_chars", "question", "emoji", "image")


def selected_scenes(queries: DataFrame, scenes: DataFrame, key: str, query: str = "query", most: int = 2) -> DataFrame:
    """Which scene profiles of its owner a query is answered with, at most ``most``: its own scene and casual, else those with most evidence.

    ``queries`` has query_id, key and the query's text; ``scenes`` key, scene and n.
    """
    asked = queries.select("query_id", key, C.scene(F.col(query)).alias("_own")).join(scenes, key)
    order = F.when(F.col("scene") == F.col("_own"), 0).when(F.col("scene") == "casual", 1).otherwise(2)
    w = Window.partitionBy("query_id")
    rows = asked.withColumn("_o", order).withColumn("_best", F.min("_o").over(w)).where((F.col("_o") < 2) | (F.col("_best") == 2))
    place = F.row_number().over(w.orderBy("_o", F.desc("n"), "scene"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("query_id", key, "scene", "place")


def circadian(messages: DataFrame, hour: Column, weekday: Column, key: str, least: int = 30) -> DataFrame:
    """Histograms of the hours of all days, weekdays and weekends, each relative to its peak, and the share at night.

    One row of a key; arrays of 24 levels with 3 places. Below ``least`` messages there
    are no histograms. Night is from 22 to 6, the weekend Saturday and Sunday.
    """
    counts = messages.groupBy(key, hour.alias("_h"), (weekday >= 5).alias("_we")).agg(F.count("*").alias("_c"))
    per = counts.groupBy(key, "_h").agg(F.sum("_c").alias("_all"), F.sum(F.when(~F.col("_we"), F.col("_c"))).alias("_wd"), F.sum(F.when(F.col("_we"), F.col("_c"))).alias("_end"))
    cells = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_h", F.struct("_all", "_wd", "_end")))).alias("_m"), F.sum("_all").alias("n"), F.sum(F.when((F.col("_h") >= 22) | (F.col("_h") < 6), F.col("_all"))).alias("_night"))

    def levels(name: str) -> Column:
        raw = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("_m", h)[name], F.lit(0)))
        return F.when(F.col("n") >= least, F.transform(raw, lambda x: F.when(F.array_max(raw) > 0, F.round(x / F.array_max(raw), 3)).otherwise(0.0)))

    return cells.select(key, "n", levels("_all").alias("hours"), levels("_wd").alias("weekdays"), levels("_end").alias("weekends"), F.round(F.coalesce("_night", F.lit(0)) / F.col("n"), 3).alias("night_share"))


def opening_report(openings: DataFrame, at: Column, kind: Column, key: str = "source") -> DataFrame:
    """Counts of the friend's openings by hour, weekday, month and class, as arrays of structs, and their rate.

    ``openings`` has key, initiator, gap_minutes and what ``at`` (a timestamp) and
    ``kind`` need. The span counts both end days; the rate is of 30 days.
    """
    rows = openings.where("initiator = 'friend'").select(key, "gap_minutes", F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), F.date_format(at, "yyyy-MM").alias("month"), kind.alias("kind"), F.to_date(at).alias("day"))
    one = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("day").alias("active_days"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span_days"), F.median("gap_minutes").alias("median_gap"))
    parts = rows.select(key, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("hour", "weekday", "month", "kind")])).alias("x")).select(key, "x.*")
    counted = parts.groupBy(key, "dimension", "value").agg(F.count("*").alias("n"))
    arrays = counted.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("value", "n")))).alias(f"{d}s") for d in ("hour", "weekday", "month", "kind")])
    return one.join(arrays, key).withColumn("per_30_days", F.round(F.col("n") * 30 / F.col("span_days"), 2))


def summary_modes(openings: DataFrame, hour: Column, bucket: Column, kind: Column, key: str = "source") -> DataFrame:
    """The three most common hours, and the most common gap bucket and class; equal counts by value."""
    rows = openings.select(key, hour.cast("string").alias("hour"), bucket.alias("bucket"), kind.alias("kind"))
    parts = rows.select(key, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("hour", "bucket", "kind")])).alias("x")).select(key, "x.*").where("value is not null")
    counted = parts.groupBy(key, "dimension", "value").agg(F.count("*").alias("n"))
    order = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct((-F.col("n")).alias("n"), F.lpad("value", 20, " ").alias("pad"), "value")))), lambda x: x["value"])
    return counted.groupBy(key).agg(F.array_join(F.slice(order("hour"), 1, 3), ",").alias("hours"), F.get(order("bucket"), F.lit(0)).alias("bucket"), F.get(order("kind"), F.lit(0)).alias("kind"))
