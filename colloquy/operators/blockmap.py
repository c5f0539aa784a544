"""Analysis of text blocks with a cache, and its reduction by month.

What a model says of a block is a function of the block's text. Only blocks that the
cache doesn't hold under the same version and language are mapped; what is refused or
can't be parsed becomes a row with its error, and any other failure ends the job. Results
of a month are reduced eight at a time in rounds until one is left, so no group grows with
the data; groups that the reducer refuses are merged by rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strict_object
from .merges import merge_claims, merge_events

VERSION = 5
FAN_IN = 8
LARGE = 50_000  # messages from which months are reduced before anything else
_EVENT = "struct<date:string,title:string,summary:string,importance:int,kind:string,evidence:array<string>>"
_CLAIM = "struct<subject:string,claim:string,confidence:double,evidence:array<string>,contexts:array<string>>"
CLAIMS = ("personality", "relationship", "habits")
RESULT = f"struct<events:array<{_EVENT}>,{','.join(f'{c}:array<{_CLAIM}>' for c in CLAIMS)},experimental:array<{_CLAIM}>>"


class Refused(Exception):
    """A model's answer that is a refusal or can't be read."""


def missing_blocks(blocks: DataFrame, cache: DataFrame, version: int = VERSION, language: str = "en") -> DataFrame:
    """Blocks without a cached result of this version and language."""
    held = cache.where((F.col("version") == version) & (F.col("language") == language) & F.col("result").isNotNull())
    return blocks.join(held.select("block_id"), "block_id", "left_anti")


def _answers(key: list[str], ask: Callable[..., str], arguments: list[str]):
    """(key, result, error) of each row; ``Refused`` and ValueError are errors of the row."""

    def run(parts):
        for part in parts:
            columns = [part.column(a).to_pylist() for a in arguments]
            results, errors = [], []
            for values in zip(*columns):
                try:
                    results.append(ask(*values))
                    errors.append(None)
                except (Refused, ValueError) as e:
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[*key, "result", "error"])

    return run


def map_blocks(blocks: DataFrame, ask: Callable[[str], str], version: int = VERSION, language: str = "en") -> DataFrame:
    """block_id, version, language, result (JSON text) and error of each block; ``ask`` is told the text."""
    kind = dict(blocks.dtypes)["block_id"]
    told = blocks.select("block_id", "text").mapInArrow(_answers(["block_id"], ask, ["text"]), f"block_id {kind}, result string, error string")
    # a result that isn't one JSON object is an error as well
    bad = F.col("result").isNotNull() & strict_object(F.col("result")).isNull()
    return told.select("block_id", F.lit(version).alias("version"), F.lit(language).alias("language"), F.when(~bad, F.col("result")).alias("result"), F.when(bad, "not a result").otherwise(F.col("error")).alias("error"))


def merged_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new results in place of those of the same block; errors aren't kept."""
    fine = new.where("result is not null").select(*cache.columns)
    return cache.join(fine.select("block_id"), "block_id", "left_anti").unionByName(fine)


def split_cache(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary, experimental) parts of results, to be kept apart: either can be renewed without the other."""
    r = F.from_json("result", RESULT)
    ordinary = results.where("result is not null").withColumn("result", F.to_json(r.withField("experimental", F.lit(None).cast(f"array<{_CLAIM}>"))))
    some = results.where("result is not null").select(*[c for c in results.columns if c != "result"], F.to_json(F.struct(r["experimental"].alias("experimental"))).alias("result"))
    return ordinary, some


def merged_locally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One result of each group by rule: equal events and claims as one, the best thirty (forty habits).

    ``rows`` has the keys, start_ms, end_ms and result (struct).
    """
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    base = rows.withColumn("_g", name)
    one = base.groupBy("_g").agg(*[F.first(k).alias(k) for k in keys], F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    events = merge_events(base.select("_g", F.explode("result.events").alias("e")).select("_g", "e.*"), "_g")
    best = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("importance"), F.desc("date"), "title"))
    item = lambda *c: F.array_sort(F.collect_list(F.struct("_n", F.struct(*c).alias("x"))))
    only = lambda c: F.transform(c, lambda x: x["x"])
    listed = events.withColumn("_n", best).where("_n <= 30").groupBy("_g").agg(only(item("date", "title", "summary", "importance", "kind", "evidence")).alias("events"))
    out = one.join(listed, "_g", "left")
    for c in (*CLAIMS, "experimental"):
        items = base.select("_g", F.explode(f"result.{c}").alias("e")).select("_g", "e.*")
        merged = merge_claims(items, ["_g", "subject"], {"evidence": 6, "contexts": 4})
        place = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("confidence"), "subject", "claim"))
        kept = merged.withColumn("_n", place).where(F.col("_n") <= (40 if c == "habits" else 30))
        out = out.join(kept.groupBy("_g").agg(only(item("subject", "claim", "confidence", "evidence", "contexts")).alias(c)), "_g", "left")
    full = F.struct(F.coalesce("events", F.array().cast(f"array<{_EVENT}>")).alias("events"), *[F.coalesce(c, F.array().cast(f"array<{_CLAIM}>")).alias(c) for c in (*CLAIMS, "experimental")])
    return out.select(*keys, "start_ms", "end_ms", full.cast(RESULT).alias("result"))


def reduced_months(results: DataFrame, ask: Callable[[str, str], str], n_messages: int, zone: str = "UTC", owner: str = "owner", large: int = LARGE) -> DataFrame:
    """One result per owner and local month if there are many messages; else the results as they are.

    ``results`` has owner, start_ms, end_ms and result (struct); ``ask`` is told a label and the
    JSON array of at most eight results. Returns owner, month, start_ms, end_ms, result.
    """
    month = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis("start_ms").cast("timestamp_ntz")), "yyyy-MM")
    rows = results.select(owner, month.alias("month"), "start_ms", "end_ms", "result")
    if n_messages <= large:
        return rows
    most = rows.groupBy(owner, "month").count().agg(F.max("count")).first()[0] or 1
    rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy(owner, "month").orderBy("start_ms", "end_ms", F.to_json("result"))) - 1)
    keys = [owner, "month", "_p"]
    for k in range(math.ceil(math.log(max(most, 1), FAN_IN) - 1e-9)):
        grouped = rows.withColumn("_p", F.floor(F.col("_p") / FAN_IN))
        size = F.count("*").over(Window.partitionBy(*keys))
        grouped = grouped.withColumn("_n", size)
        many = grouped.where("_n > 1")
        label = F.concat("month", F.lit(f"-r{k + 1}-"), (F.col("_p") + 1).cast("string"))
        # eight results at most
        asked = many.groupBy(*keys).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "result"))), lambda x: x["result"])).alias("items")).withColumn("label", label)
        schema = ", ".join([*(f"{c} {t}" for c, t in asked.select(*keys, "start_ms", "end_ms").dtypes), "result string, error string"])
        told = asked.mapInArrow(_answers([*keys, "start_ms", "end_ms"], ask, ["label", "items"]), schema).withColumn("result", F.when(strict_object(F.col("result")).isNotNull(), F.from_json("result", RESULT)))
        # each group is asked once, whatever reads the answers, and a lost executor doesn't ask again
        told = told.checkpoint() if told.sparkSession.sparkContext.getCheckpointDir() else told
        failed = many.join(told.where("result is null").select(*keys), keys, "left_semi")
        by_rule = merged_locally(failed.select(*keys, "start_ms", "end_ms", "result"), keys)
        rows = grouped.where("_n = 1").select(*keys, "start_ms", "end_ms", "result").unionByName(told.where("result is not null").drop("error")).unionByName(by_rule)
    return rows.select(owner, "month", "start_ms", "end_ms", "result")


def block_report(results: DataFrame) -> DataFrame:
    """How many blocks were mapped and failed, and why, by error."""
    why = F.coalesce(F.regexp_extract("error", "^[^:]*", 0), F.lit(""))
    return results.groupBy(why.alias("error")).agg(F.count("*").alias("n"))
