"""Searches in nested JSON as rounds over VARIANT values: one level of all documents at a time, on the JVM, without a bound on nodes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import release, stored


def has(node: Column, key: str) -> Column:
    """Whether an object holds a key, be its value null."""
    return F.variant_get(node, f"$['{key}']", "variant").isNotNull()


def first_nodes(docs: DataFrame, id_: str, text: str, accepts: Callable[[Column], Column]) -> DataFrame:
    """``id_``, depth and node (VARIANT) of the first node that ``accepts`` takes, breadth first, of each row whose ``text`` is JSON and has one. ``id_`` must be unique.

    Nodes of one depth stand in the order of their ways from the root: elements as they stand, keys in the order that VARIANT keeps
    them in (by name). A document leaves the search with its first node; each round opens the nodes of one more level."""
    front = stored(docs.select(F.col(id_).alias("id"), F.array().cast("array<int>").alias("way"), F.try_parse_json(F.col(text)).alias("node")).where("node is not null"), "nodes")
    found, depth = [], 0
    while True:
        hits = front.where(accepts(F.col("node")))
        first = hits.groupBy("id").agg(F.min("way").alias("way"))
        hit = stored(front.join(first, ["id", "way"]).select("id", F.lit(depth).alias("depth"), "node"), "hits")
        found.append(hit)
        rest = front.join(hit.select("id"), "id", "left_anti").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("node").outer()).select(F.col("pos"), F.col("value")))
        after = stored(rest.select("id", F.concat("way", F.array("pos")).alias("way"), F.col("value").alias("node")), "nodes")
        release(front)
        if after.isEmpty():
            release(after)
            return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_)
        front, depth = after, depth + 1


def first_values(docs: DataFrame, id_: str, text: str, key: str) -> DataFrame:
    """``id_``, depth and value (JSON text) of the first occurrence of a key at any depth."""
    found = first_nodes(docs, id_, text, lambda node: has(node, key))
    return found.select(id_, "depth", F.to_json(F.variant_get("node", f"$['{key}']", "variant")).alias("value"))
