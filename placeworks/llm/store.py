"""Tables, shared scratch space and size checks used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of our own only where that is unset.

    Unset on a cluster, it is a folder under the warehouse, which executors share;
    only a local session (tests) gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        global _LOCAL
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="spark-scratch-")
        return f"file://{_LOCAL}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


_LOCAL: str | None = None


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so a lost
    executor costs no recomputation, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, by: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, the same ones in every run: those of the smallest hash of column ``by``."""
    return df.orderBy(F.xxhash64(F.col(by).cast("string")), F.col(by)).limit(limit)


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null ids fall in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1))
