"""Closures over edges by rounds of joins; a written table cuts the lineage after each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (least id reachable) of all ids of undirected edges. Labels take the least of their neighbours' and then jump to their label's label, so rounds grow with the logarithm of path lengths."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = last = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        low = label.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "other").alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = stored(low.join(jump, "component", "left").select("id", "before", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        done = after.where("component <> before").isEmpty()
        release(last)
        label, last = after.select("id", "component"), after
        if done:
            release(both)
            return label


#: Stored levels of a closure that are gathered into one table before they slow down the plans that read them.
LEVELS = 16


def closure(seeds: DataFrame, edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """id and depth of all that directed edges (a, b) reach from ``seeds`` (id), however long the paths; a round for each step. What ``stops`` lists is reached but not followed."""
    levels = [stored(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)), "closure")]
    depth = 0
    while True:
        front = levels[-1]
        go = front.select("id") if stops is None else front.select("id").join(stops.select("id"), "id", "left_anti")
        found = edges.join(go.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).where("id is not null").distinct()
        for known in levels:
            found = found.join(known.select("id"), "id", "left_anti")
        depth += 1
        front = stored(found.withColumn("depth", F.lit(depth)), "closure")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(front)
        if len(levels) > LEVELS:
            before, levels = levels[:-1], [stored(reduce(DataFrame.unionByName, levels[:-1]), "closure"), front]
            release(*before)


def until_stable(state: DataFrame, step, rounds: int | None = None) -> tuple[DataFrame, int, bool]:
    """Apply ``step`` (frame to frame that only adds rows) until it adds none, or ``rounds`` times; the frame, the rounds used and whether it is stable."""
    n, i, last = state.count(), 0, None
    while rounds is None or i < rounds:
        state, i = stored(step(state), "state"), i + 1
        if last is not None:
            release(last)
        last = state
        m = state.count()
        if m == n:
            return state, i, True
        n = m
    return state, i, False
