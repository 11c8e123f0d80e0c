"""Where intermediate tables live."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; one of our own only where none is set and all executors are on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _at(spark: SparkSession, path: str):
    """(file system, path) of the store that holds a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage. The table goes with the driver, if ``release`` does not delete it before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    store, where = _at(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``stored`` gave, once everything built on them is stored itself."""
    for df in frames:
        invalidate(df.sparkSession, df._stored_at)


def sweep(spark: SparkSession, seconds: float, now: float | None = None) -> list[str]:
    """Delete the tables of ``stored`` that are older than ``seconds``, which drivers that were killed have left; their names."""
    now = time.time() if now is None else now
    store, where = _at(spark, scratch(spark))
    old = [f for f in (store.listStatus(where) if store.exists(where) else []) if re.search("-[0-9a-f]{32}$", f.getPath().getName()) and f.getModificationTime() < (now - seconds) * 1000]
    for f in old:
        store.delete(f.getPath(), True)
    return sorted(f.getPath().getName() for f in old)


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, without hidden ones; none where there is no folder."""
    store, where = _at(spark, path)
    return [n for f in (store.listStatus(where) if store.exists(where) else []) if f.isDirectory() and (n := f.getPath().getName())[0] not in "_."]


def fresh(spark: SparkSession, path: str, seconds: float, make: Callable[[], DataFrame], now: float | None = None) -> DataFrame:
    """A table that is made anew when the one at ``path`` is older than ``seconds``. Each making has a folder named by its time, so readers of an older one are not disturbed; ``invalidate`` forgets them all."""
    now = time.time() if now is None else now
    store, where = _at(spark, path)
    made = [int(f.getPath().getName()[1:]) for f in store.listStatus(where) if f.getPath().getName().startswith("v")] if store.exists(where) else []
    done = [v for v in made if exists(spark, f"{path}/v{v}/_SUCCESS") and v >= (now - seconds) * 1000]
    version = max(done) if done else int(now * 1000)
    if not done:
        make().write.mode("overwrite").parquet(f"{path}/v{version}")
    return spark.read.parquet(f"{path}/v{version}")


def invalidate(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)
