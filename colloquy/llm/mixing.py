"""Mixing sources to target weights through a tree of budgets.

Documents are the leaves' content; a leaf is a path of level values (domain,
language, source). A token budget goes down the tree level by level: children
share their parent's budget by weight, none gets more than its subtree can give
(``max_epochs`` times its tokens), and what one cannot take goes to its siblings
by weight. As a child's capacity is that of its whole subtree, a shortage is
made up among siblings first, and reaches an ancestor's siblings only when the
subtree is exhausted.

Each leaf then takes a prefix of its tokens from seeded epochs: epoch after
epoch in the order of ``md5(seed:epoch:id)``, the last document counting with
the tokens still wanted. The prefix is found without ordering a leaf: token sums
of 4096 key ranges, then the order within the one range where the budget ends.

All of it is DataFrame operations. Edge cases: null levels are the value
``unknown``, a null id is the empty string in the order; null and empty texts
have no tokens and are taken with their epoch; rows of one id are taken
together; other columns pass where ``keep`` names them; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Tables, quoted

SEED, MAX_EPOCHS = 17, 2
_RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Tokens of a text: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(level == name, F.lit(float(w))).otherwise(out)
    return out


def _shared(nodes: DataFrame, parent: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight`` up to ``capacity``.

    A child may have several rows; ``head`` marks the one that stands for it.
    """
    group = Window.partitionBy(*parent)
    ordered = group.orderBy(F.try_divide("capacity", "weight"), *order)
    once = lambda c: F.when(F.col("head"), F.col(c)).otherwise(0)
    filled = F.coalesce(F.sum(once("capacity")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(once("weight")).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    rate = (F.col("budget") - filled) / rest
    rated = nodes.withColumn("_rate", F.when(F.col("head") & (rate < F.try_divide("capacity", "weight")), rate))
    fair = F.col("weight") * F.max("_rate").over(group)
    return rated.withColumn("budget", F.coalesce(F.least(F.col("capacity").cast("double"), fair), F.col("capacity").cast("double"))).drop("_rate")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], fraction: float, max_epochs: int) -> DataFrame:
    """``leaves(level_0.., tokens)`` with ``quota``, whole ``epochs`` and the ``rest`` of a further one.

    The roots share the total in one small table of theirs. Below them, each level
    is a window over the leaves, which stay dealt by their root.
    """
    full = leaves.where("tokens > 0")
    roots = full.groupBy(levels[0]).agg((F.sum("tokens") * max_epochs).alias("capacity"), F.sum("tokens").alias("_tokens"))
    everything = Window.partitionBy(F.lit(0))
    roots = roots.withColumn("budget", F.floor(F.sum("_tokens").over(everything) * F.lit(fraction)).cast("double"))
    roots = roots.withColumns({"weight": _weight(F.col(levels[0]), weights[0]), "head": F.lit(True)})
    out = leaves.join(_shared(roots, [F.lit(0)], levels[:1]).select(levels[0], "budget"), levels[0], "left")
    for depth in range(1, len(levels)):
        own = Window.partitionBy(*levels[: depth + 1])
        out = out.withColumns({
            "capacity": F.sum("tokens").over(own) * max_epochs,
            "weight": _weight(F.col(levels[depth]), weights[depth]),
            "head": F.row_number().over(own.orderBy(*levels)) == 1,
        })
        # subtrees without tokens take nothing and must not count by their weight
        out = out.withColumn("weight", F.when(F.col("capacity") > 0, F.col("weight")).otherwise(F.lit(0.0)))
        out = _shared(out.withColumn("head", F.col("head") & (F.col("capacity") > 0)), levels[:depth], levels)
    quota = F.floor(F.coalesce("budget", F.lit(0.0)) + 0.001).cast("long")
    out = out.withColumn("quota", quota)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.try_divide("quota", "tokens"))).otherwise(0).cast("int")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")).select(*levels, "tokens", "quota", "epochs", "rest")


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], fraction: float, seed: int = SEED, max_epochs: int = MAX_EPOCHS, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",), counts: bool = True) -> DataFrame:
    """``docs`` as often as they are taken: ``keep`` columns, other levels, epoch, n_tokens, taken_tokens.

    Without ``counts`` the ``keep`` columns only, whatever their names.

    ``levels`` maps names to expressions over ``docs``, from the root down;
    ``weights`` holds, for each level, the weights of values (1 otherwise);
    ``fraction`` of all tokens is the budget.
    """
    paths = [f"level_{i}" for i in range(len(levels))]
    level = [F.coalesce(x.cast("string"), F.lit("unknown")).alias(p) for p, x in zip(paths, levels.values())]
    n_tokens = word_count(F.col(text_col)) if tokens is None else tokens
    tables = Tables(docs.sparkSession, "op10")
    base = tables.write(docs.select(F.col(id_col).alias("_id"), *level, n_tokens.alias("_tokens")), "base")
    leaves = base.groupBy(*paths).agg(F.sum("_tokens").alias("tokens"))
    plan = tables.write(leaf_budgets(leaves, paths, [weights.get(x, {}) for x in levels], fraction, max_epochs), "plan")

    # where the last epoch of a leaf ends: first the key range, then the document in it
    last = base.join(plan.where("rest > 0").select(*paths, "epochs", "rest"), paths).withColumn("_key", _key(seed, F.col("epochs")))
    ranged = last.withColumn("_range", F.substring("_key", 1, _RANGE_DIGITS))
    before = Window.partitionBy(*paths).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*paths, "rest", "_range").agg(F.sum("_tokens").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    ends = sums.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_sum") >= F.col("rest"))).select(*paths, "_range", "_before")
    inside = Window.partitionBy(*paths).orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ranged.join(ends, [*paths, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_tokens").over(inside))
    cut = cut.where(F.col("_upto") >= F.col("rest")).groupBy(*paths).agg(F.min_by(F.struct("_key", (F.col("_tokens") + F.col("rest") - F.col("_upto")).alias("_part")), "_key").alias("_cut"))
    plan = tables.write(plan.join(cut, paths, "left").select(*paths, "epochs", F.col("_cut._key").alias("_last"), F.col("_cut._part").alias("_part")), "cuts")
    tables.drop("base", "plan")

    # a struct, so that no kept name clashes with one of the plan
    rows = docs.select(F.struct(*quoted(keep)).alias("_keep"), F.col(id_col).alias("_id"), *level, n_tokens.alias("n_tokens"))
    taken = rows.join(plan, paths).withColumn("_end", _key(seed, F.col("epochs")) <= F.col("_last"))
    taken = taken.withColumn("epoch", F.explode(F.filter(F.sequence(F.lit(0), F.col("epochs")), lambda e: (e < F.col("epochs")) | F.coalesce(F.col("_end"), F.lit(False)))))
    part = F.when((F.col("epoch") == F.col("epochs")) & (_key(seed, F.col("epochs")) == F.col("_last")), F.greatest("_part", F.lit(0))).otherwise(F.col("n_tokens"))
    if not counts:
        return taken.select("_keep.*")
    return taken.select("_keep.*", *[F.col(p).alias(x) for p, x in zip(paths, levels) if x not in keep], "epoch", "n_tokens", part.alias("taken_tokens"))
