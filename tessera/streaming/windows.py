"""Streaming twins of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.operators.incremental import window_places
from tessera.operators.relational import top_per_key
from tessera.storage import exists, folders, invalidate


def tumbling_counts(events: DataFrame, ts: str, width: str, keys: list[str], late: str) -> DataFrame:
    """start and keys with the number of events; what is later than ``late`` is dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def dedupe(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def rate_limit(events: DataFrame, key: str, ms: str, order: str, limit: int, window_ms: int, late: str | None = None) -> DataFrame:
    """Each event of a stream with its place in its key's window and whether it is allowed; windows open at the first event after the last one closed.

    The events of a key in a batch are put in order together: two numbers each, however many Arrow frames they come in. The state of a key is two numbers;
    with ``late`` events older than that are dropped and a key's state goes once its window has closed before the watermark, else it stays."""
    kind = events.schema[key].dataType.simpleString()

    def run(who: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        parts = [(f[ms].to_numpy("int64"), f[order].to_numpy("int64")) for f in frames]
        at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((ids, at))
        at, ids = at[by], ids[by]
        counts, _, opened, n = window_places(at, window_ms, opened, n)
        for k in range(0, len(ids), 65_536):
            c = counts[k : k + 65_536]
            yield pd.DataFrame({key: who[0], order: ids[k : k + 65_536], "count": c, "allowed": c <= limit})
        state.update((opened, n))
        if late:
            state.setTimeoutTimestamp(max(opened + window_ms, state.getCurrentWatermarkMs() + 1))

    rows = events.select(key, ms, order)
    if late:
        rows = rows.withColumn("_at", F.timestamp_millis(ms)).withWatermark("_at", late)
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} long, count int, allowed boolean", "opened long, n int", "append", timeout)


#: Parts of a table that ``upsert_batches`` keeps; a batch rewrites those that it touches.
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete manifests of a table, oldest first."""
    return sorted(v for v in map(int, folders(spark, f"{path}/manifest")) if exists(spark, f"{path}/manifest/{v}/_SUCCESS"))


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[dict[int, int], str]:
    """(bucket -> version that wrote it, the batch that made this version); at most BUCKETS rows."""
    rows = spark.read.schema("bucket int, version long, made_by string").parquet(f"{path}/manifest/{version}").collect()
    return {r[0]: r[1] for r in rows}, rows[0][2] if rows else ""


def upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``upsert_batches`` keeps, as its newest complete batch left it; a reader sees all of a batch or nothing of it."""
    versions = _versions(spark, path)
    parts = [f"{path}/data/{v}/bucket={bucket}" for bucket, v in _manifest(spark, path, versions[-1])[0].items()] if versions else []
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert_batches(stream: DataFrame, keys: list[str], order: str, path: str, state: str):
    """Keep the row of greatest ``order`` of each key (of equal ones the newest batch's) as a table at ``path``, which ``upserted`` reads.

    Rows are dealt to buckets by a hash of their keys. A batch writes the buckets that it touches to the folder of a new version, and then a
    manifest that says which version wrote each bucket; only with it is the batch visible. A batch that is run again after a crash writes again, or
    finds that it made the newest manifest and does nothing. Buckets that neither the newest manifest nor the one before it names, and older
    manifests, are deleted. One stream writes to a table at a time."""

    def merge(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        versions, made_by = _versions(spark, path), f"{state}#{i}"
        before, last = _manifest(spark, path, versions[-1]) if versions else ({}, "")
        if last == made_by:
            return
        new = versions[-1] + 1 if versions else 0
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).withColumn("_new", F.lit(1))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
        for bucket in touched:
            if bucket in before:
                held = spark.read.schema(batch.schema).parquet(f"{path}/data/{before[bucket]}/bucket={bucket}")
                fresh = fresh.unionByName(held.withColumns({"bucket": F.lit(bucket), "_new": F.lit(0)}))
        rest = [F.col(c).desc_nulls_last() for c in batch.columns if c not in keys]
        kept = top_per_key(fresh, keys, [F.col(order).desc_nulls_last(), F.col("_new").desc(), *rest]).drop("_new")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{new}")
        now = before | dict.fromkeys(touched, new)
        spark.createDataFrame([(b, v, made_by) for b, v in now.items()], "bucket int, version long, made_by string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{new}")
        needed = set(now.items()) | set(before.items())
        for old in map(int, folders(spark, f"{path}/data")):
            for bucket in folders(spark, f"{path}/data/{old}"):
                if (int(bucket.split("=")[1]), old) not in needed:
                    invalidate(spark, f"{path}/data/{old}/{bucket}")
            if not any(v == old for _, v in needed):
                invalidate(spark, f"{path}/data/{old}")
        for old in versions[:-1]:
            invalidate(spark, f"{path}/manifest/{old}")

    return stream.writeStream.option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(merge).start()
