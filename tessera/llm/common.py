"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.storage import release, scratch

__all__ = ["free_names", "release", "scratch", "shuffle_partitions", "stored", "table", "text_or_empty"]


#: Rows that pass to Python at once while a table is stored: whole texts and signatures are long rows. Whoever runs a frame,
#: Spark ends an Arrow batch at 64 MB as well (spark.sql.execution.arrow.maxBytesPerBatch), or after a single longer row.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        return storage.stored(df, name, compression="zstd")
    finally:
        spark.conf.set(_BATCH, before)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each of ``names``, lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
