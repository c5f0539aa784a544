"""Every query against its DuckDB twin on the smallest supplied tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from colloquy.plans import catalogue

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    left = sorted((str(tuple(plain(r[c]) for c in columns)) for r in got.collect()))
    right = sorted(str(tuple(plain(dict(zip(want.columns, r))[c]) for c in columns)) for r in want.fetchall())
    assert left == right


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) <= {"q25_html_text"}
