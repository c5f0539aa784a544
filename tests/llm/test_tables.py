from __future__ import annotations

import pytest

from colloquy.llm import _tables


class Conf:
    def get(self, *_):
        return None

    def set(self, key, value):
        self.value = value


class Session:
    def __init__(self, master):
        self.conf = Conf()
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda self: Conf()})()


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            _tables.shared_dir(Session(master))
    assert _tables.shared_dir(Session("local[4]")).startswith("file:///")


def test_tables_are_dropped(spark):
    tables = _tables.Tables(spark, "job")
    tables.write(spark.range(5), "a")
    b = tables.write(spark.range(6), "b")
    tables.drop("a", "missing")
    assert b.count() == 6
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(f"{tables.root}/a").count()


def test_keys_have_two_halves(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "a")], "doc_id long, text string").select(*_tables.row_keys()).collect()
    assert rows[0] == rows[1] and len({r.rid for r in rows}) == len({r.rid2 for r in rows}) == 3 and all(r.rid != r.rid2 for r in rows)
