"""Readers and writers of tables, and scans that other systems page through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with line ends in cells; rows of another width and rows without any value are dropped, cells trimmed. The file has a header."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    # rows can only be checked for their width while all columns are parsed
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="DROPMALFORMED", columnPruning=False).csv(path)
    trimmed = rows.select(*[F.coalesce(F.trim(F.regexp_replace(c, "\r\n", "\n")), F.lit("")).alias(c) for c in columns])
    return trimmed.where(reduce(lambda a, b: a | b, [F.col(c) != "" for c in columns]))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Quotes only where needed, doubled inside; ``single`` is for reports that people open."""
    (df.coalesce(1) if single else df).write.options(header=True, escape='"', emptyValue="").csv(path)


def read_json(spark: SparkSession, path: str, schema: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Lines of JSON under a given schema; missing arrays become empty ones."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in arrays})


def read_database(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> DataFrame:
    """A database table as a scan of ``parts`` ranges of a number, date or time column, read side by side. The ranges' ends are asked of the table; rows without a key come with the first. Filters and columns chosen later go to the database, as a cursor's query would."""
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}", **options).load().first()
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if ends[0] is None:
        return rows.load()
    return rows.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts)).load()


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed: a semi join in place of requests with lists of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def after(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next rows in key order: one page of a keyset scan."""
    return (df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(size)


def cached_or_new(requested: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cached rows, requests that the cache lacks)."""
    wanted = requested.select(*keys).distinct()
    return cache.join(wanted, keys, "left_semi"), wanted.join(cache.select(*keys), keys, "left_anti")


def payload(column: str, fields: dict[str, str]) -> list[Column]:
    """Typed fields of a JSON text: name -> 'path type', as in ``{"k": "$.k long"}``."""
    return [F.get_json_object(column, p.split()[0]).cast(p.split()[1]).alias(name) for name, p in fields.items()]


def split_valid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows); null counts as not valid."""
    sure = F.coalesce(ok, F.lit(False))
    return df.where(sure), df.where(~sure)


def bulk_load(csv: DataFrame, key: str, lists: dict[str, str]) -> dict[str, DataFrame]:
    """Entities and, for each column of ``;`` lists, a dimension of distinct values and a junction; ids follow the order of values."""
    out = {"entities": csv.drop(*lists)}
    for column, name in lists.items():
        each = csv.select(key, F.explode(F.split(column, ";")).alias("v")).select(key, F.trim("v").alias(name)).where(F.col(name) != "").distinct()
        out[name] = each.select(name).distinct().withColumn(f"{name}_id", F.xxhash64(name))
        out[f"{key}_{name}"] = each.join(out[name], name).select(key, f"{name}_id")
    return out
