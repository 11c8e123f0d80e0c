"""Small relational steps that the plans share. Every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import stored


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def having(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def missing(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children's structs; parents without any get an empty one."""
    fields = [c for c in rows.columns if c != key]
    ordered = [*order, *[c for c in fields if c not in order]]
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias(name))
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def threshold_ladder(counts: DataFrame, count: str, levels: tuple[int, ...]) -> DataFrame:
    """For each level, how many rows have at most so many."""
    sums = counts.agg(*[F.count_if(F.col(count) <= x).alias(f"n{x}") for x in levels])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"n{x}").alias("rows")) for x in levels])).alias("r")).select("r.*")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place from 1 on in a total order, without one task for all: ranges are sorted apart, and each starts after the counts of those before. What the driver sees is one count for each range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_at"))
    runs = stored(runs, "runs")
    before, total = [], 0
    for part, count in sorted((r["_part"], r["count"]) for r in runs.groupBy("_part").count().collect()):
        before.append((part, total))
        total += count
    starts = spark.createDataFrame(before, "_part int, _before long")
    return runs.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 on, with one row more than ``size`` where a next page exists."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size + 1)


def by_given_order(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows with these keys, numbered in the order in which the keys are given."""
    wanted = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{key} {df.schema[key].dataType.simpleString()}, position int")
    return df.join(wanted, key).orderBy("position")


def priority_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames, the earliest frame's row for each key; frames have unique keys."""
    tagged = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f)
    return top_per_key(both, keys, [F.col("_priority")]).drop("_priority")


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows by the order of a hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(max(n, 0))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` to be sent to all tasks if it has ``rows`` rows at most, which are counted; else as it is."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(rows + 1)) <= rows else df


def first_seen(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place of their first row."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).select(value, "first.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has (none when the keys are unique)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key is set but has no row in ``other``."""
    return df.where(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of those they break; null counts as kept, as in SQL."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def visible(df: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Allowed columns of the rows whose parent may be seen."""
    return df.join(parents.select(key), key, "left_semi").select(*columns)


def sample_function(spark: SparkSession, name: str, view: str, id_: str, columns: list[str], seed: str) -> None:
    """A temporary SQL function ``name(n)`` that returns the ``columns`` of the n rows of a view that ``seeded_sample`` gives, for FROM and LATERAL. Each partition passes on n rows at most."""
    kinds = {f.name: f.dataType.simpleString() for f in spark.table(view).schema}
    returns, chosen = ", ".join(f"{c} {kinds[c]}" for c in columns), ", ".join(columns)
    order = f"md5(concat(cast({id_} as string), '{seed}')), {id_}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(n INT) RETURNS TABLE ({returns}) RETURN SELECT {chosen} FROM (SELECT {chosen}, row_number() OVER (ORDER BY {order}) AS place FROM {view}) WHERE place <= {name}.n")


def many_to_many(rows: DataFrame, few: DataFrame, key: str, value: str, longest: int = 4096) -> DataFrame:
    """``rows`` with each ``value`` of ``few`` that has their key, for keys that many rows of both have: values of a key are lists of about ``longest``, and rows are
    dealt to tasks regardless of their key, so neither a row nor a task holds all of a key's pairs."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = few.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    cut = few.join(counted, key).withColumn("_cut", F.pmod(F.xxhash64(value, F.lit(7)), F.ceil(F.col("_n") / longest)))
    lists = cut.groupBy(key, "_cut").agg(F.collect_list(F.struct(value)).alias("_list")).drop("_cut")
    dealt = rows.where(F.col(key).isNotNull()).withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), F.lit(tasks)).cast("int")).repartition(tasks, "_deal", key)
    # a given number and no broadcast, as few bytes make many pairs
    spread = lists.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "_deal", key).hint("shuffle_hash")
    return dealt.join(spread, ["_deal", key]).select(*rows.columns, F.explode("_list").alias("_one")).select(*rows.columns, F.col(f"_one.{value}").alias(value))
