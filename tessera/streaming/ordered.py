"""Rate limits of streams whose events come out of order, within and across batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tessera.operators.incremental import window_places

#: The state store that lists, timers and single values of a key need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


class _Limiter(StatefulProcessor):
    """Events wait until the watermark has passed them; then they are counted in order of (ms, order)."""

    def __init__(self, names: tuple[str, str, str], limit: int, window_ms: int):
        self.names, self.limit, self.window_ms = names, limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, id bigint")
        self.window = handle.getValueState("window", "opened bigint, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        _, ms, order = self.names
        for frame in rows:
            got = list(zip(frame[ms].astype("int64").tolist(), frame[order].astype("int64").tolist(), strict=True))
            if got:
                self.waiting.appendList(got)
                self._wake(min(got)[0], timerValues)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = np.array([(int(a), int(b)) for a, b in self.waiting.get()], np.int64).reshape(-1, 2)
        due, rest = held[held[:, 0] < passed], held[held[:, 0] >= passed]
        if not len(due):
            if not len(held) and self.window.exists() and passed >= int(self.window.get()[0]) + self.window_ms:
                self.window.clear()
            yield from ()
            return
        due = due[np.lexsort((due[:, 1], due[:, 0]))]
        opened, n = (int(x) for x in self.window.get()) if self.window.exists() else (None, 0)
        places, _, opened, n = window_places(due[:, 0], self.window_ms, opened, n)
        self.window.update((opened, n))
        if len(rest):
            self.waiting.put([(int(a), int(b)) for a, b in rest])
            self._wake(int(rest[:, 0].min()), timerValues)
        else:
            self.waiting.clear()
            self._wake(opened + self.window_ms, timerValues)
        for k in range(0, len(due), 65_536):
            c = places[k : k + 65_536]
            yield pd.DataFrame({self.names[0]: key[0], self.names[2]: due[k : k + 65_536, 1], "count": c, "allowed": c <= self.limit})

    def _wake(self, ms: int, now: TimerValues) -> None:
        self.handle.registerTimer(max(ms, now.getCurrentWatermarkInMs()) + 1)

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, key: str, ms: str, order: str, limit: int, window_ms: int, late: str) -> DataFrame:
    """Each event of a stream with its place in its key's window and whether it is allowed, as the batch operator counts them, in whatever order they come.

    An event waits until the watermark, the newest time less ``late``, has passed it, so none can come before it any more; one that
    comes later than that is dropped. A key's state is its events within ``late`` and two numbers. Needs RocksDB as the session's
    state store (STORE)."""
    spark = events.sparkSession
    if spark.conf.get(SETTING) != STORE:
        raise ValueError(f"set {SETTING} to {STORE}")
    kind = events.schema[key].dataType.simpleString()
    timed = events.where(F.col(ms).isNotNull() & F.col(key).isNotNull()).select(key, F.col(ms).cast("long").alias(ms), F.col(order).cast("long").alias(order), F.timestamp_millis(ms).alias("_at")).withWatermark("_at", late)
    limiter = _Limiter((key, ms, order), limit, window_ms)
    return timed.groupBy(key).transformWithStateInPandas(limiter, f"{key} {kind}, {order} long, count int, allowed boolean", "Append", "EventTime")
