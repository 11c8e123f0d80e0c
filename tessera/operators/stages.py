"""Stages run in order; what fails is told, and ends the run unless the stage may fail."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[], DataFrame | None], bool]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(frames by stage, audit): stages are (name, function, optional). The audit has place, stage, state (done, failed, not run), the error and seconds."""
    frames: dict[str, DataFrame] = {}
    told, ended = [], False
    for place, (name, f, optional) in enumerate(stages):
        began, error = time.time(), None
        if not ended:
            try:
                out = f()
                if out is not None:
                    frames[name] = out
            except Exception as e:  # noqa: BLE001  a stage may fail in any way
                error, ended = f"{type(e).__name__}: {e}", not optional
            state = "done" if error is None else "failed"
        else:
            state = "not run"
        told.append((place, name, state, error, time.time() - began))
    return frames, spark.createDataFrame(told, "place int, stage string, state string, error string, seconds double")
