"""Cursors, ledgers, failure memory and rate limits over batches; streaming twins are in tessera.streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def since_cursor(rows: DataFrame, ledger: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """Rows from the ledger's newest time less ``days`` on; without a ledger nothing, as a start must then be given."""
    start = ledger.agg((F.max(ts) - F.expr(f"INTERVAL {days} DAYS")).alias("_from"))
    return rows.join(F.broadcast(start), rows[ts] >= F.col("_from")).drop("_from")


def reset_if_modified(ledger: DataFrame, sweep: DataFrame, key: str, modified: str, processed: str) -> DataFrame:
    """The ledger after a sweep (key, modified): new keys are unprocessed, and a changed time clears the mark."""
    o, n = ledger.alias("o"), sweep.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    unseen = F.col(f"n.{key}").isNull()
    stays = unseen | F.col(f"o.{modified}").eqNullSafe(F.col(f"n.{modified}"))
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), F.when(unseen, F.col(f"o.{modified}")).otherwise(F.col(f"n.{modified}")).alias(modified), F.when(stays, F.col(f"o.{processed}")).alias(processed))


def route(work: DataFrame, done: DataFrame, failures: DataFrame, key: str, url: str) -> DataFrame:
    """done, skip (failed at this URL), retry (failed at another one) or new for each piece of work."""
    d = done.select(key, F.lit(True).alias("_done")).distinct()
    f = failures.select(key, F.col(url).alias("_failed_url"), F.lit(True).alias("_failed"))
    out = work.join(d, key, "left").join(f, key, "left")
    way = F.when(F.col("_done"), "done").when(F.col("_failed") & F.col(url).eqNullSafe(F.col("_failed_url")), "skip").when(F.col("_failed"), "retry").otherwise("new")
    return out.select(*work.columns, way.alias("route"))


def outcome(status: Column) -> Column:
    """Definitive outcomes are marked done, transient ones are tried again."""
    return F.when(status.isin(404, 410), "gone").when(status.between(200, 299), "ok").when(status.between(400, 499) & (status != 429), "unreachable").otherwise("transient")


def all_written(outcomes: DataFrame, unit: str, ok: str) -> DataFrame:
    """Units of which every write succeeded."""
    return outcomes.groupBy(unit).agg(F.min(F.col(ok).cast("int")).alias("_ok")).where("_ok = 1").select(unit)


def window_places(at: np.ndarray, width: int, opened: int | None = None, n: int = 0) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """(place of each event in its window, when that opened, the last window's opening and count) of one key's sorted times; a window opens at the first event after the last one closed. A step for each window, not for each event."""
    places, opens, k = np.empty(len(at), np.int32), np.empty(len(at), np.int64), 0
    while k < len(at):
        if opened is None or at[k] - opened >= width:
            opened, n = int(at[k]), 0
        end = k + int(np.searchsorted(at[k:], opened + width))
        places[k:end] = np.arange(n + 1, n + 1 + end - k)
        opens[k:end] = opened
        n, k = n + end - k, end
    return places, opens, opened, n


def rate_limit(events: DataFrame, key: str, ts_ms: str, order: str, limit: int, window_ms: int) -> DataFrame:
    """Each event with its place in its key's window, whether it is allowed and, if not, the seconds to wait. Rejected events count. Each opening follows from the one before it, so a key's events pass one task in order; its state is two numbers, however many they are."""
    kind = events.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, opened, n = None, None, 0
        for frame in frames:
            if frame.empty:
                continue
            names, at = frame[key].to_numpy(), frame[ts_ms].to_numpy("int64")
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            counts, opens = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[a] != who:
                    who, opened, n = names[a], None, 0
                counts[a:b], opens[a:b], opened, n = window_places(at[a:b], window_ms, opened, n)
            yield pd.DataFrame({key: frame[key], order: frame[order], "count": counts, "opened": opens, "ms": at})

    sorted_ = events.where(F.col(key).isNotNull() & F.col(ts_ms).isNotNull()).select(key, F.col(ts_ms).cast("long").alias(ts_ms), F.col(order).cast("long").alias(order)).repartition(key).sortWithinPartitions(key, ts_ms, order)
    rows = sorted_.mapInPandas(run, f"{key} {kind}, {order} long, count int, opened long, ms long")
    allowed = F.col("count") <= limit
    wait = F.ceil((F.col("opened") + window_ms - F.col("ms")) / 1000)
    return rows.select(key, order, "count", allowed.alias("allowed"), F.when(~allowed, wait).cast("long").alias("retry_after_s"))


#: Stretch of the order that one task counts for a key in ``failure_runs``.
STRETCH = 1 << 20


def failure_runs(events: DataFrame, key: str, order: str, failed: Column, least: int = 8, stretch: int = STRETCH) -> DataFrame:
    """Runs of ``least`` failures in a row or more, by key; ``order`` is a number. Successes are counted within stretches of the order, and each stretch starts with the sum of those before it, so a key's rows need not meet in one task."""
    marked = events.withColumns({"_bad": failed, "_part": F.floor(F.col(order) / stretch)})
    ok = (~F.col("_bad")).cast("int")
    before = marked.groupBy(key, "_part").agg(F.sum(ok).alias("_sum"))
    before = before.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(key).alias("_key"), F.col("_part").alias("_of"), "_before")
    run = F.sum(ok).over(W.partitionBy(key, "_part").orderBy(order)) + F.col("_before")
    met = marked.join(before, marked[key].eqNullSafe(before["_key"]) & marked["_part"].eqNullSafe(before["_of"]))
    return met.withColumn("_run", run).where("_bad").groupBy(key, "_run").agg(F.count("*").alias("length"), F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("length") >= least).drop("_run")


def stale(targets: DataFrame, sources: DataFrame, key: str, updated: str) -> DataFrame:
    """Targets older than their newest source, or that have none yet."""
    newest = sources.groupBy(key).agg(F.max(updated).alias("newest"))
    return newest.join(targets.select(key, F.col(updated).alias("_own")), key, "left").where(F.col("_own").isNull() | (F.col("newest") > F.col("_own"))).select(key, "newest")
