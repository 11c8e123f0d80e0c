"""Every plan with SQL gives what DuckDB gives; the others keep their invariants."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [[round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i] for i in order] for r in found]
    return sorted(map(tuple, plain), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_rate_limit_model(spark, sf):
    limit, width = 5, 6 * 3600 * 1000
    found = {r["event_id"]: (r["count"], r["allowed"]) for r in catalog.QUERIES["fixed_window_rate_limit"](spark, sf).collect()}
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    state = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", ms.alias("ms")).collect(), key=lambda r: (r["user_id"], r["ms"], r["event_id"])):
        opened, n = state.get(r["user_id"], (None, 0))
        if opened is None or r["ms"] - opened >= width:
            opened, n = r["ms"], 0
        state[r["user_id"]] = (opened, n + 1)
        assert found[r["event_id"]] == (n + 1, n + 1 <= limit)


def test_components_are_closed(spark, sf):
    found = catalog.QUERIES["fixpoint_components"](spark, sf)
    assert found.where("component > doc_id").isEmpty()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5("text").alias("h"))
    assert docs.join(found, "doc_id").groupBy("h").agg(F.count_distinct("component").alias("n")).where("n > 1").isEmpty()


def test_plain_text_has_no_tags(spark, sf):
    found = catalog.QUERIES["html_to_text"](spark, sf)
    assert found.count() == 50
    assert found.where(F.col("plain").rlike(r"</?(p|div|li|script)\b") | F.col("plain").contains("&amp;amp;")).isEmpty()


@pytest.mark.parametrize("name", ["genre_filter_semi", "sim_copurchase_pairs", "url_norm_self_join", "cascade_match", "diff_three_way"])
def test_no_cartesian_product(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["scan_project_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in plan and "c_name" in plan.split("ReadSchema")[1]
