"""What must hold in a process of its own: queries with Arrow steps, and the entry point without its optional parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

QUERY = """
import sys
from pyspark.sql import SparkSession
from colloquy.plans import catalogue
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert catalogue.QUERIES[sys.argv[1]](spark, sys.argv[2]).count() > 0
"""


def python(code: str, *args: str, path: Path = ROOT) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code, *args], cwd=path, env=os.environ | {"PYTHONPATH": str(path)}, capture_output=True, text=True, timeout=300, check=False)


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", ["q26_vector_topk", "q40_pack_blocks", "q46_adaptive_segments", "q64_turn_batches", "q78_conversion_report", "q89_summary_batches"])
def test_arrow_queries_alone(name):
    done = python(QUERY, name, str(DATA))
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("gone", [("colloquy/llm", "tests/llm"), ("colloquy/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_point_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = python("import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)", path=copy)
    assert done.returncode == 0, done.stderr[-2000:]
