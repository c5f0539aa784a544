"""Corpus preparation as a chain of stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
left. All but the last return the columns of ``docs``:

- *quality* drops documents scored below the threshold;
- *near_dedup* leaves one document of each near-duplicate group;
- *secrets* replaces secret spans in the texts;
- *mixing* cuts over-represented leaves of the domain, language and source tree
  to their share of ``MIX_FRACTION`` of the tokens, whole documents, one epoch;
- *packing* gives the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._tables import written
from colloquy.llm.minhash import drop_near_duplicates
from colloquy.llm.mixing import mix
from colloquy.llm.packing import pack
from colloquy.llm.quality import score_quality
from colloquy.llm.registry import MIX_LEVELS, MIX_WEIGHTS
from colloquy.llm.secrets import redact

MIX_FRACTION = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, keep=tuple(docs.columns)).where("predicted = 1").select("kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced, and their length in characters renewed."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken into the mix."""
    return mix(docs, {k: f() for k, f in MIX_LEVELS.items()}, MIX_WEIGHTS, MIX_FRACTION, max_epochs=1, keep=docs.columns, counts=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
