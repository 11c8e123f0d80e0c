"""Operator 2: sharding along a Hilbert curve.

Several metadata dimensions are quantised at their quantiles, the cells are
numbered along a Hilbert curve, rows are sorted by that number over the whole
cluster and cut into runs of equal row counts, so each shard covers a compact
region of every dimension and min/max statistics prune files.

Law: ``rows`` (shard sizes differ by one row at most). Only metadata moves:
texts are read once for their size and checksum.

Defined cases: null texts count as empty (size 1, checksum 0); nulls of a
dimension take its lowest cell; a dimension that the table lacks is left out;
ties on the curve are ordered by checksum, size, doc_id and row, so repeated
rows take slots of their own, and equal texts (the groups) of equal metadata lie
side by side, parted by a cut at most; an empty table gives an empty result. Extra
columns are ignored by ``hilbert_shards`` and carried by ``write_shards``, for which
``docs`` must read the same rows in the same order each time, as a stored table does.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, shuffle_partitions, stored, text_or_empty

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points whose coordinates have ``bits`` bits each (transpose form, bit by bit)."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [a ^ t for a in x]
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = (index << 1) | ((a >> b) & 1)
    return index


def _measure(meta: DataFrame, name: str, prefix: int) -> Column:
    """A number that orders like the column: strings and binaries by six bytes after the prefix that all values share, dates by days, times by microseconds, truth values and numbers as they are. Other types have no order to measure."""
    kind, c = meta.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c if isinstance(kind, T.BinaryType) else F.encode(c, "UTF-8")
        return F.conv(F.rpad(F.hex(F.substring(raw, prefix + 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.BooleanType, T.NumericType)):
        return c.cast("double")
    raise TypeError(f"a {kind.simpleString()} can be no dimension")


def curve(meta: DataFrame, dims: list[str], bits: int) -> Column:
    """The Hilbert number of each row as a column of ``meta``; quantiles come from all rows."""
    if not dims:
        return F.lit(0).cast("long")
    worded = [i for i, d in enumerate(dims) if isinstance(meta.schema[d].dataType, (T.StringType, T.BinaryType))]
    raw = lambda c, d: F.hex(F.encode(c, "UTF-8") if isinstance(meta.schema[d].dataType, T.StringType) else c)
    ends = meta.agg(*[raw(f(dims[i]), dims[i]).alias(f"{n}{i}") for i in worded for n, f in (("a", F.min), ("b", F.max))]).first() if worded else {}
    shared = {i: len(os.path.commonprefix([bytes.fromhex(ends[f"{n}{i}"] or "") for n in "ab"])) for i in worded}
    values = [_measure(meta, d, shared.get(i, 0)) for i, d in enumerate(dims)]
    at = [k / 2**bits for k in range(1, 2**bits)]
    cuts = meta.agg(*[F.percentile_approx(v, at, 1000).alias(str(i)) for i, v in enumerate(values)]).first()

    def cell(value: Column, at: list[float] | None) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, sorted(set(at)))), lambda c: c <= value)) if at else F.lit(0)

    @F.pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].fillna(0).clip(lower=0).to_numpy() for c in cells], bits))

    return place(F.struct(*[cell(v, cuts[i]).cast("int").alias(f"c{i}") for i, v in enumerate(values)]))


def _ranked(docs: DataFrame, shards: int, dimensions: tuple[str, ...], bits: int) -> DataFrame:
    """doc_id, size, text_crc32, row, hilbert, shard and slot of every row."""
    spark = docs.sparkSession
    dims = [d for d in dimensions if d in docs.columns]
    text = text_or_empty()
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    meta = stored(docs.select(doc_id.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(d).alias(f"dim{i}") for i, d in enumerate(dims)], F.monotonically_increasing_id().alias("row")), "op2-meta")
    keys = ["hilbert", "text_crc32", "size", "doc_id", "row"]
    placed = meta.select(curve(meta, [f"dim{i}" for i in range(len(dims))], bits).alias("hilbert"), "doc_id", "size", "text_crc32", "row")
    runs = stored(placed.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at")), "op2-runs")
    counts = sorted((r["part"], r["count"]) for r in runs.groupBy("part").count().collect())  # a row for each shuffle partition
    total = sum(n for _, n in counts)
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    base = spark.createDataFrame(offsets, "part int, base long")
    shard = F.expr(f"(base + at) * {shards} div {max(total, 1)}").cast("int")
    ranked = runs.join(F.broadcast(base), "part").withColumn("shard", shard).withColumn("rank", F.col("base") + F.col("at"))
    return ranked.withColumn("slot", F.expr(f"rank - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))


def hilbert_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and hilbert of every row."""
    return _ranked(docs, shards, dimensions, bits).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Write ``docs`` as one folder of files for each shard, named by a column that the table lacks, rows in curve order; return each shard's number, row count and range of every dimension."""
    row, shard, slot = free_names(docs, "row", "shard", "slot")
    layout = _ranked(docs, shards, dimensions, bits).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = docs.select(*docs.columns, F.monotonically_increasing_id().alias(row)).join(layout, row).drop(row)
    n = shuffle_partitions(docs.sparkSession)
    joined.repartitionByRange(max(n, shards), shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
    back = docs.sparkSession.read.parquet(path)
    dims = [d for d in dimensions if d in docs.columns]
    return back.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
