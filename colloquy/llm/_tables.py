"""Working tables of long jobs: row keys, written stages, bounded prefilters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the row-key prefilter: its broadcast never exceeds so many longs.
FLAG_BUCKETS = 1 << 18

#: The two halves of a row's 128-bit key.
KEY = ("rid", "rid2")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own; on a
    cluster that is an error, as executors don't share a machine's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='colloquy-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Tables:
    """The working tables of one job, in a folder of its own.

    A written table cuts the lineage: a lost executor costs the stages after it
    only. Tables that nothing reads any more can be dropped before the job ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all been written."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """One table written to the shared folder and read again."""
    return Tables(df.sparkSession, name).write(df, "table")


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def row_key(id_col: str = "doc_id", text_col: str = "text", salt: int | None = None) -> Column:
    """64-bit key of a row by id and text; with a salt another one.

    Rows that repeat both share it, and every per-document result is the same
    for them; a null id or text is a value like any other.
    """
    return F.xxhash64(*([] if salt is None else [F.lit(salt)]), F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit("")))


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``KEY``: both halves of a row's key, where equal keys stand for equal rows."""
    return [row_key(id_col, text_col).alias(KEY[0]), row_key(id_col, text_col, 1).alias(KEY[1])]


def split_by_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in ``keys``, rows that are not), without a shuffle.

    The keys are folded into ``FLAG_BUCKETS`` hash buckets, so the broadcast has
    a fixed bound; a false hit only sends a row on to the exact join.
    """
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(FLAG_BUCKETS))
    flags = F.broadcast(keys.select(bucket.alias("_flag")).distinct())
    tagged = df.withColumn("_flag", bucket)
    return tagged.join(flags, "_flag", "left_semi").drop("_flag"), tagged.join(flags, "_flag", "left_anti").drop("_flag")
