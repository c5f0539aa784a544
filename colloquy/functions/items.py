"""Items from a model's text: arrays that are checked entry by entry.

A text is read as strict JSON, its array of items as variants; what isn't an object of the
wanted fields is left out, and the others stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import squeeze, strip
from .scalars import json_object, strict_json

_NUMBER = "^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def answer_items(answer: Column, field: str) -> Column:
    """The array at a field of an answer's object, as variants; null where there is none."""
    return F.try_variant_get(strict_json(json_object(answer)), f"$.{field}", "array<variant>")


def kind_of(item: Column, path: str) -> Column:
    """The name of a field's JSON type, null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def text_of(item: Column, path: str) -> Column:
    """A field that is text, else null."""
    return F.when(kind_of(item, path) == "STRING", F.try_variant_get(item, path, "string"))


def number_of(item: Column, path: str) -> Column:
    """A field that is a number, else null."""
    return F.when(kind_of(item, path).rlike(_NUMBER), F.try_variant_get(item, path, "double"))


def whole_of(item: Column, path: str) -> Column:
    """A field that is a whole number or a text of one, else null; truth values aren't numbers."""
    kind, text = kind_of(item, path), F.try_variant_get(item, path, "string")
    return F.when(kind.rlike(_NUMBER), text.try_cast("double").try_cast("long")).when((kind == "STRING") & strip(text).rlike("^[+-]?[0-9]+$"), strip(text).try_cast("long"))


def checked(items: Column, schema: Mapping[str, tuple[str, bool]]) -> Column:
    """The entries that have all required fields of the right kind, as structs.

    ``schema`` names each field's kind (text, number, whole, texts) and whether it is
    required; a required text isn't blank. An optional field of another kind spoils its
    entry as well; a missing one is null.
    """

    def value(x: Column, name: str, kind: str) -> Column:
        path = f"$.{name}"
        if kind == "texts":
            each = F.try_variant_get(x, path, "array<variant>")
            return F.when(F.forall(each, lambda y: F.schema_of_variant(y) == "STRING"), F.transform(each, lambda y: F.try_variant_get(y, "$", "string")))
        return {"text": text_of, "number": number_of, "whole": whole_of}[kind](x, path)

    def fine(x: Column) -> Column:
        ok = F.startswith(F.to_json(x), F.lit("{"))
        for name, (kind, required) in schema.items():
            v = value(x, name, kind)
            good = v.isNotNull() & (strip(v) != "") if kind == "text" and required else v.isNotNull()
            ok = ok & F.coalesce(good if required else good | kind_of(x, f"$.{name}").isNull() | (kind_of(x, f"$.{name}") == "VOID"), F.lit(False))
        return ok

    entries = F.filter(F.coalesce(items, F.array().cast("array<variant>")), fine)
    return F.transform(entries, lambda x: F.struct(*[value(x, n, k).alias(n) for n, (k, _) in schema.items()]))


def rerank_scores(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """key, id and score (0 to 1) of a reranker's answers; of an id's scores the last counts."""
    rows = answers.select(key, F.posexplode(answer_items(F.col(answer), "ranked")).alias("_p", "x"))
    rows = rows.select(key, "_p", text_of(F.col("x"), "$.id").alias("id"), number_of(F.col("x"), "$.score").alias("_s")).where("id != '' and _s is not null")
    return rows.groupBy(key, "id").agg(F.max_by(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_s")), "_p").alias("score"))


def proposed_segments(answers: DataFrame, turns: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """key, place, start_turn and end_turn of the segments that an answer proposes.

    Bounds are turns, or sequence numbers that lie in a turn (``turns`` has key, turn_no,
    start_seq, end_seq). A segment of which a bound can't be told is left out.
    """
    x = F.col("x")
    rows = answers.select(key, F.posexplode(answer_items(F.col(answer), "segments")).alias("place", "x"))
    rows = rows.select(key, "place", *[whole_of(x, f"$.{f}").alias(f"_{f}") for f in ("start_turn", "end_turn", "start_seq", "end_seq")])
    by_turn = F.col("_start_turn").isNotNull() & F.col("_end_turn").isNotNull()
    asked = rows.where(~by_turn & F.col("_start_seq").isNotNull() & F.col("_end_seq").isNotNull()).select(key, "place", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("_start_seq").alias("seq")), F.struct(F.lit("e").alias("side"), F.col("_end_seq").alias("seq")))).alias("b")).select(key, "place", "b.*")
    # a turn's numbers as keys of an equal join: turns are short runs
    numbers = turns.select(key, "turn_no", F.explode(F.sequence("start_seq", "end_seq")).alias("seq")).groupBy(key, "seq").agg(F.min("turn_no").alias("turn_no"))
    found = asked.join(numbers, [key, "seq"]).groupBy(key, "place").agg(F.max(F.when(F.col("side") == "s", F.col("turn_no"))).alias("_s"), F.max(F.when(F.col("side") == "e", F.col("turn_no"))).alias("_e"))
    both = rows.join(found, [key, "place"], "left")
    return both.select(key, "place", F.when(by_turn, F.col("_start_turn")).otherwise(F.col("_s")).alias("start_turn"), F.when(by_turn, F.col("_end_turn")).otherwise(F.col("_e")).alias("end_turn")).where("start_turn is not null and end_turn is not null")


ATTRIBUTION = {"opening_id": ("text", True), "category": ("text", True), "confidence": ("number", True), "evidence": ("texts", False)}


def attributions(answers: DataFrame, openings: DataFrame, key: str, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(valid attributions of known openings, the first of each; expected and got of each answer, and whether it is complete)."""
    rows = answers.select(key, F.posexplode(checked(answer_items(F.col(answer), "analyses"), ATTRIBUTION)).alias("_p", "x")).select(key, "_p", "x.*")
    known = rows.join(openings.select(key, "opening_id").distinct(), [key, "opening_id"], "left_semi")
    first = known.groupBy(key, "opening_id").agg(F.min_by(F.struct("category", "confidence", "evidence"), "_p").alias("_f")).select(key, "opening_id", "_f.*")
    expected = openings.groupBy(key).agg(F.count_distinct("opening_id").alias("expected"))
    counts = expected.join(first.groupBy(key).agg(F.count("*").alias("got")), key, "left").select(key, "expected", F.coalesce("got", F.lit(0)).alias("got"))
    return first, counts.withColumn("complete", F.col("got") == F.col("expected"))


def attribution_status(openings: DataFrame, owner: str = "owner", reason: str = "category") -> DataFrame:
    """How far openings are explained: completed, partial or failed, the number, and counts by reason."""
    by = openings.groupBy(owner, reason).agg(F.count("*").alias("n"))
    one = by.groupBy(owner).agg(F.sum("n").alias("openings"), F.coalesce(F.sum(F.when(F.col(reason).isNotNull(), F.col("n"))), F.lit(0)).alias("analyzed"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(reason).isNotNull(), F.struct(reason, "n"))))).alias("reason_counts"))
    status = F.when(F.col("analyzed") == F.col("openings"), "completed").when(F.col("analyzed") > 0, "partial").otherwise("failed")
    return one.withColumn("status", status)


HABIT = {"category": ("text", True), "claim": ("text", True), "confidence": ("number", True), "target_fields": ("texts", False)}


def repaired_habits(answers: DataFrame, sources: DataFrame, key: str, answer: str = "answer", most: int = 16) -> DataFrame:
    """Habits of a reducer's answer with the evidence of the sources that they cite.

    ``sources`` has key, source_id (from 0), evidence (array of texts) and target_fields. Ids
    that aren't sources are dropped, twelve at most count; a habit without one, or without
    its own fields, goes. Evidence is distinct, six at most; missing target fields come from the
    sources, five at most. The first ``most`` habits stay.
    """
    items = answer_items(F.col(answer), "habits")
    rows = answers.select(key, F.posexplode(items).alias("_p", "x"))
    one = F.get(checked(F.array("x"), HABIT), F.lit(0))
    rows = rows.select(key, "_p", one.alias("h"), F.try_variant_get("x", "$.source_ids", "array<variant>").alias("ids")).where("h is not null")
    cited = rows.select(key, "_p", F.posexplode("ids").alias("_i", "v")).select(key, "_p", "_i", whole_of(F.col("v"), "$").alias("source_id"))
    cited = cited.join(sources.select(key, "source_id", "evidence", F.col("target_fields").alias("_fields")), [key, "source_id"]).groupBy(key, "_p", "source_id").agg(F.min("_i").alias("_i"), F.first("evidence").alias("evidence"), F.first("_fields").alias("_fields"))
    # an answer's citations are few: they are gathered in their order
    held = cited.groupBy(key, "_p").agg(F.slice(F.array_sort(F.collect_list(F.struct("_i", "source_id", "evidence", "_fields"))), 1, 12).alias("s"))
    flat = lambda f: F.array_distinct(F.flatten(F.transform("s", lambda y: F.coalesce(y[f], F.array().cast("array<string>")))))
    out = rows.join(held, [key, "_p"]).select(
        key, "_p", F.col("h.category").alias("category"), squeeze(F.col("h.claim")).alias("claim"), F.col("h.confidence").alias("confidence"), F.transform("s", lambda y: y["source_id"]).alias("source_ids"), F.slice(flat("evidence"), 1, 6).alias("evidence"),
        F.when(F.size("h.target_fields") > 0, F.col("h.target_fields")).otherwise(F.slice(flat("_fields"), 1, 5)).alias("target_fields"),
    )
    firsts = out.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.col("_p"))), 1, most).alias("_keep"))
    return out.join(firsts, key).where(F.array_contains("_keep", F.col("_p"))).withColumnRenamed("_p", "place").drop("_keep")
