from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm.mixing import leaf_budgets, mix
from colloquy.llm.mixing_sql import OP10
from colloquy.llm.registry import MIX_LEVELS, MIX_WEIGHTS

from .corpus import SCHEMA, frame, null_last, rows

LEVELS = ["level_0", "level_1"]


def budgets(spark, leaves, weights, fraction, epochs=1):
    rows = leaf_budgets(spark.createDataFrame(leaves, "level_0 string, level_1 string, tokens long"), LEVELS, weights, fraction, epochs).collect()
    return {(r.level_0, r.level_1): r.quota for r in rows}


def test_shortage_goes_to_siblings_before_others(spark):
    leaves = [("a", "x", 100), ("a", "y", 1000), ("b", "z", 1000)]
    # a and b get 400 each; x can give 100 only, so y makes it up and b stays at 400
    got = budgets(spark, leaves, [{}, {}], 800 / 2100)
    assert got == {("a", "x"): 100, ("a", "y"): 300, ("b", "z"): 400}
    # with 1600, a's subtree is exhausted at 1100 less than its half only for b
    assert sum(budgets(spark, leaves, [{"a": 3}, {}], 1900 / 2100).values()) == pytest.approx(1900, abs=2)


def test_weights_and_epochs(spark):
    got = budgets(spark, [("a", "x", 100), ("b", "x", 900)], [{"a": 1, "b": 1}, {}], 0.4, epochs=2)
    assert got == {("a", "x"): 200, ("b", "x"): 200}


def test_against_sql(spark, tmp_path):
    documents = frame(spark).select("doc_id", "text", "lang", "source").toArrow()  # pandas would make ids floats
    con = duckdb.connect()
    con.register("documents", documents)
    columns = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken_tokens"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({OP10})").fetchall()
    got = mix(frame(spark), {k: f() for k, f in MIX_LEVELS.items()}, MIX_WEIGHTS, 0.5).select(columns).collect()
    assert sorted(map(tuple, got), key=null_last) == sorted(want, key=null_last)


def test_deep_trees_against_a_plain_version(spark):
    import random

    def fill(nodes, budget):
        """Water filling by weight: {name: given} of (name, capacity, weight)."""
        given, open_ = {}, [n for n in nodes if n[1] > 0]
        while open_:
            rate = budget / sum(n[2] for n in open_)
            short = [n for n in open_ if n[1] <= rate * n[2]]
            if not short:
                return given | {n[0]: rate * n[2] for n in open_}
            given |= {n[0]: n[1] for n in short}
            budget -= sum(n[1] for n in short)
            open_ = [n for n in open_ if n not in short]
        return given

    rng = random.Random(2)
    names, weights = [f"level_{k}" for k in range(3)], [{"a": 3.0}, {"x": 2.0, "y": 0.5}, {"s1": 4.0}]
    for fraction in (0.1, 0.5, 0.9, 1.0):
        leaves = [(a, b, c, rng.choice([0, 3, 50, 1000, 20_000])) for a in "abc" for b in "xyz" for c in ("s1", "s2", "s3") if rng.random() < 0.8]

        def down(prefix, budget, out):
            own = [x for x in leaves if x[: len(prefix)] == prefix]
            if len(prefix) == 3:
                return out | {prefix: budget}
            kids = sorted({x[len(prefix)] for x in own})
            given = fill([(k, 2 * sum(x[3] for x in own if x[len(prefix)] == k), weights[len(prefix)].get(k, 1.0)) for k in kids], budget)
            for k, got in given.items():
                out = down((*prefix, k), got, out)
            return out

        want = down((), int(sum(x[3] for x in leaves) * fraction), {})
        got = leaf_budgets(spark.createDataFrame(leaves, "level_0 string, level_1 string, level_2 string, tokens long"), names, weights, fraction, 2).collect()
        assert len(got) == len(leaves)
        for r in got:
            assert abs(r.quota - want.get((r.level_0, r.level_1, r.level_2), 0)) <= 1, r


def test_prefix_of_one_leaf(spark):
    data = [(i, "w " * (1 + i % 5)) for i in range(50)]
    frame_ = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.taken_tokens for r in mix(frame_, {"all": F.lit("x")}, {}, 0.5, max_epochs=1).collect()}
    left, want = sum(1 + i % 5 for i in range(50)) // 2, {}
    for i in sorted(range(50), key=lambda i: hashlib.md5(f"17:0:{i}".encode()).hexdigest()):
        if left > 0:
            want[i] = min(left, len(re.findall(r"\S+", data[i][1])))
            left -= want[i]
    assert got == want


def test_other_columns_and_empty_table(spark):
    keep = [c.split()[0] for c in SCHEMA.split(", ")]
    out = mix(frame(spark), {"lang": F.col("lang")}, {}, 1.0, max_epochs=1, keep=keep)
    assert out.columns[: len(keep)] == keep and out.count() == sum(1 for r in rows())
    named = frame(spark).select("*", F.lit(1).alias("epoch"), F.lit("n").alias("n_tokens"), F.lit(2).alias("taken_tokens"), F.lit(3).alias("domain"), F.lit(4).alias("a.b"), F.lit(5).alias("level_0"))
    out = mix(named, {k: f() for k, f in MIX_LEVELS.items()}, MIX_WEIGHTS, 1.0, max_epochs=1, keep=named.columns, counts=False)
    assert out.columns == named.columns and sorted(map(str, out.collect())) == sorted(map(str, named.collect()))
    assert mix(spark.createDataFrame([], SCHEMA), {"lang": F.col("lang")}, {}, 0.5).collect() == []
