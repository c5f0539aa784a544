"""Queries of the corpus operators, by name: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .fingerprints import fingerprint_neighbours
from .infilling import fill_in_middle, restore
from .infilling_sql import OP11
from .jaccard_join import similar_texts
from .langid import identify
from .lm_score import score_texts
from .minhash import near_duplicates
from .mixing import mix
from .mixing_sql import OP10
from .packing import pack
from .quality import score_quality
from .runs import collapse_runs, strongest
from .secrets import digest, secret_spans
from .sets_sql import OP5, OP12
from .suffix_dedup import repeated_spans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that lie in 200-byte strings which repeat."""
    return repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document, as it is and with its second half exchanged."""
    return fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of each document."""
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("rid", "rid2", "node", "root")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return identify(_table(spark, sf_dir, "documents"), with_spans=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of each document."""
    return digest(secret_spans(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of each document."""
    return score_texts(_table(spark, sf_dir, "documents"))


#: Levels and weights of the mix: sixteen domains of sources, languages, sources.
MIX_LEVELS = {"domain": lambda: F.substring(F.md5(F.coalesce(F.col("source"), F.lit("unknown"))), 1, 1), "lang": lambda: F.col("lang"), "source": lambda: F.col("source")}
MIX_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 0.5}}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken into a mix of half the tokens, by epoch."""
    return mix(_table(spark, sf_dir, "documents"), {k: f() for k, f in MIX_LEVELS.items()}, MIX_WEIGHTS, fraction=0.5)


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cut for filling in its middle, and put together again."""
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of each document by links of similar sets of word runs."""
    return similar_texts(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of each document, with planted ones in every tenth id by hash."""
    rows = collapse_runs(_table(spark, sf_dir, "documents"), tail_seed=F.crc32(F.col("doc_id").cast("string")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("top", strongest(F.col("runs"))).withColumn("listed", F.array_join(lines, ""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_fingerprints": op2_fingerprints,
        "op3_nearest": op3_nearest,
        "op4_quality": op4_quality,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_language": op6_language,
        "op7_secret_scan": op7_secret_scan,
        "op8_packing": op8_packing,
        "op9_lm_score": op9_lm_score,
        "op10_mixing": op10_mixing,
        "op11_infilling": op11_infilling,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": OP10, "op11_infilling": OP11, "op5_minhash_dedup": OP5, "op12_jaccard_join": OP12}
