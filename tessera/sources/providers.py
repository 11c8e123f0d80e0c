"""Sources by name: each takes requests and gives candidates of one schema, so that a search can ask several."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a provider gives for requests (q, text).
SCHEMA = "q long, id string, name string"
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def provider(name: str):
    """Register a function from requests (q, text) to candidates of SCHEMA."""

    def keep(f):
        PROVIDERS[name] = f
        return f

    return keep


def ask(requests: DataFrame, names: list[str], providers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """provider, q, id and name of what the named providers find; an unknown name is an error."""
    known = PROVIDERS if providers is None else providers
    lost = [n for n in names if n not in known]
    if lost:
        raise KeyError(f"no provider {', '.join(lost)}")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return reduce(DataFrame.unionByName, [known[n](requests).select(F.lit(n).alias("provider"), *columns) for n in names])


def exposed(spark: SparkSession, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """table and column of what the session's catalog shows beyond the allowed tables and columns: must be empty."""
    shown = [(t.name, c.name) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame([(t, c) for t, c in shown if c not in allowed.get(t, ())], "table string, column string")
