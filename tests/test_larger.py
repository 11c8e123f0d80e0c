"""What showed on larger tables only, on small ones made for it; DuckDB runs the SQL on the same rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import alike, products, similarity
from tessera.operators.relational import many_to_many, top_per_key
from tessera.plans import catalog


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL on given tables, sorted."""
    c = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.table(rows), f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = c.sql(catalog.ORACLE_SQL[name])
    return sorted(map(tuple, got.select(*want.columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_rate_limit_rounds_to_the_millisecond(spark, tmp_path):
    # six events of a window; the last comes 600 microseconds after a whole second, so that truncation gives a second more to wait
    at = [0, 1, 2, 3, 4, 60_000_600, 21_599_999_600, -1_500, -600, -400, 21_599_998_499]
    user = [1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2]
    events = pa.table({"event_id": pa.array(range(len(at)), pa.int64()), "user_id": pa.array(user, pa.int64()), "ts": pa.array(at, pa.timestamp("us"))})
    got, want = both(spark, tmp_path, "fixed_window_rate_limit", events=events)
    assert got == want and len(got) == len(at)


def test_text_keeps_open_entities(spark, tmp_path):
    html = ["<p>token = &quot", "a &quot;b&quot; &copy; &middot; &amp;quot; &amp", "&quot x &ampquot; &ampx; &copy &amp;copy;", "\u00a0<p>x\u2003", "&quo &am &a & &", None]
    got, want = both(spark, tmp_path, "html_to_text", pages={"page_id": list(range(len(html))), "html": html})
    assert got == want and len(got) == len(html)


def brute_pairs(sets, least, per_mille):
    n = {i: len(s) for i, s in sets.items()}
    real = {i: {x for x in s if x is not None} for i, s in sets.items()}
    shared = {(a, b): len(real[a] & real[b]) for a in sets for b in sets if a < b}
    return sorted((a, b, k, k / (n[a] + n[b] - k)) for (a, b), k in shared.items() if k >= least and 1000 * k >= per_mille * (n[a] + n[b] - k))


@pytest.mark.parametrize("least, per_mille, items, block", [(2, 0, 12, 64), (1, 400, 12, 64), (2, 400, 60, 500), (1, 1000, 6, 64), (2, 0, products.MOST * 3, 64), (1, 300, products.MOST * 3, 64)])
def test_products_of_blocks(spark, least, per_mille, items, block):
    r = random.Random(items)
    few = range(12) if items > products.MOST else range(items)
    sets = {i: {r.choice(few) for _ in range(r.randint(1, 9))} | ({None} if i % 7 == 0 else set()) for i in range(300)}
    sets[299] = set(range(items)) if items > products.MOST else {0}
    rows = spark.createDataFrame([(i, None if x is None else f"item {x}") for i, s in sets.items() for x in s], "id long, item string")
    found = products.few_item_pairs(products.item_sets(rows), least, per_mille, block).collect()
    assert sorted((x["a"], x["b"], x["shared"], x["jaccard"]) for x in found) == brute_pairs(sets, least, per_mille)


def test_pairs_are_not_joined_by_item(spark, sf):
    for name in ("internal_duplicates", "sim_jaccard_pairs"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "HashAggregate" not in plan


def test_internal_duplicates_with_nulls(spark, tmp_path):
    at = pa.array([0, 0, 400 * 86_400_000_000, 0, None, 0], pa.timestamp("us"))
    customer = {"c_custkey": [1, 2, 3, None], "c_mktsegment": ["A", "A", None, "A"], "c_nationkey": pa.array([5, 5, 5, 5], pa.int32())}
    orders = {"o_custkey": [1, 2, 2, 3, 3, None], "o_orderpriority": ["x", "x", "x", "x", "y", "x"], "o_orderdate": at}
    got, want = both(spark, tmp_path, "internal_duplicates", customer=customer, orders=orders)
    assert got == want == [(1, 2)]


def test_cosines_of_blocks(spark):
    r = random.Random(3)
    vectors = {i: [r.uniform(-1, 1) for _ in range(6)] for i in range(90)} | {90: [0.0] * 6, 91: [1.0, None, 1.0, 1.0, 1.0, 1.0], 92: [1.0] * 5, 93: [2.0] * 5, 94: None, 95: []}
    rows = spark.createDataFrame([(i, i % 2 if i < 90 else 0, v) for i, v in vectors.items()] + [(200, None, [1.0])], "id long, label int, v array<float>")
    asked = rows.where("id % 10 = 0 or id >= 90")
    keep = F.expr("a <> b")
    old = asked.select("label", F.col("id").alias("a"), F.col("v").alias("u")).join(rows.select("label", F.col("id").alias("b"), "v"), "label").where(keep).select("a", "b", similarity.cosine(F.col("u"), F.col("v")).alias("cosine"))
    shown = lambda df: sorted((x["a"], x["b"], None if x["cosine"] is None else round(x["cosine"], 9) + 0.0) for x in df.collect())
    assert shown(products.cosines_within(asked, rows, "label", "id", "v", keep, 16)) == shown(old)
    plan = catalog.QUERIES["embedding_cosine_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_answers_of_one_name_are_dealt_to_tasks(spark, tmp_path):
    n = 2000
    part = {"p_partkey": list(range(n + 3)), "p_name": ["red bolt"] * n + ["blue gear", None, "lone"], "p_brand": [f"b{i % 3}" for i in range(n + 3)], "p_size": pa.array([int(i % 40 == 0 or i > n) for i in range(n + 3)], pa.int32())}
    got, want = both(spark, tmp_path, "provider_answers", part=part)
    assert got == want and len(got) == n * n // 40 + n // 40 * 3 + 4
    each = [r["n"] for r in catalog.QUERIES["provider_answers"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()]
    assert max(each) < 0.75 * sum(each)
    rows, few = spark.createDataFrame([(k, i) for k in "abc" for i in range(50)] + [(None, 1)], "k string, i int"), spark.createDataFrame([(k, j) for k in "bcd" for j in range(90)] + [(None, 1)], "k string, j long")
    assert sorted(many_to_many(rows, few, "k", "j", 7).collect()) == sorted(rows.join(few, "k").collect())


def test_chosen_together(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(r.randint(0, 400), min(int(r.paretovariate(0.6)), 90)) for _ in range(6000)] + [(None, 1), (1, None)], "c long, s long").distinct()
    pairs = similarity.cooccurrence(edges, "c", "s")
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())
    for block in (700, 1 << 24):
        assert shown(products.chosen_together(edges, "c", "s", block=block)) == shown(pairs)
    want = similarity.recommendations(pairs.withColumn("cosine", text.round4(F.col("cosine"))), "cosine", 3)
    best = top_per_key(products.chosen_together(edges, "c", "s", 3, 700), ["source"], [F.col("cosine").desc(), F.col("recommended")], 3, "rank")
    assert shown(best) == shown(want)
    # tiles of a few pairs: places that fill one, and one that is counted in pieces
    sides = []
    for of in (range(0, 7), range(7, 12)):
        rows = sorted((s, c) for s in of for c in range(50) if s in (0, 7) or r.random() < 0.2)
        ids, counts = np.unique([s for s, _ in rows], return_counts=True)
        sides.append(products._Side([(0, ids.astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes(), np.array([c for _, c in rows], np.uint16).tobytes())]))
    for x, y, same in ((*sides, False), (sides[0], sides[0], True)):
        whole = {(int(i), int(j)): int(n) for t in products._counted(x, y, same) for i, j, n in zip(*t, strict=True)}
        with monkeypatch.context() as m:
            m.setattr(products, "PAIRS", 20)
            tiles = list(products._counted(x, y, same))
        assert len(tiles) > 1 and {(int(i), int(j)): int(n) for t in tiles for i, j, n in zip(*t, strict=True)} == whole


def test_pairs_of_targets_are_not_shuffled(spark, sf):
    for name in ("sim_copurchase_pairs", "sim_copurchase_topn"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan


def test_pairs_of_sets_are_counted_in_blocks(spark, sf):
    r = random.Random(9)
    sets = {i: sorted(r.sample(range(40), r.randint(0, 12))) for i in range(200)}
    rows = spark.createDataFrame([(i, [x * (1 << 40) - 5 for x in s], len(s) + i % 3) for i, s in sets.items()], "id long, items array<long>, n int")
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(3000)] + [(0, i) for i in range(200)]
    asked = spark.createDataFrame(pairs, "x long, y long").distinct()
    n = {i: len(s) + i % 3 for i, s in sets.items()}
    want = sorted((x, y, k, n[x] + n[y]) for x, y in set(pairs) if 1300 * (k := len(set(sets[x]) & set(sets[y]))) >= 300 * (n[x] + n[y]))
    for block in (150, 1 << 24):
        assert sorted(map(tuple, alike.shared_of(asked, rows, 300, block).collect())) == want and len(want) > 20
    plan = catalog.QUERIES["token_jaccard_blocked"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "array_intersect" not in plan
