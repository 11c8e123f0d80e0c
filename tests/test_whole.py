"""Queries and operators that do the whole job, on inputs where a cut would lose rows."""

import glob
import os
import random
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from tessera.operators import similarity
from tessera.plans import catalog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL) over the given frames."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = c.sql(catalog.ORACLE_SQL[name])
    return rows(df.select(*want.columns)), sorted(want.fetchall(), key=repr)


def test_half_alike_is_complete(spark):
    rng = random.Random(7)
    sets = {}
    for i in range(160):
        known = [*sets.values()]
        base = set(rng.choice(known)) if known and rng.random() < 0.7 else set()
        sets[i] = frozenset(rng.sample(sorted(base), int(len(base) * rng.choice((0.5, 0.7, 1))))) | frozenset(rng.choices(range(60), k=rng.choice((0, 0, 1, 3, 9))))
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sets, 2) if sets[a] & sets[b] and 3 * len(sets[a] & sets[b]) >= len(sets[a]) + len(sets[b])}
    found = similarity.half_alike(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in found} == want and len(found) == len(want) > 70
    assert all(abs(r["jaccard"] - r["shared"] / len(sets[r["a"]] | sets[r["b"]])) < 1e-12 for r in found)


def test_copies_beyond_the_cap_are_paired(spark, tmp_path):
    texts = [(i, "many copies of these very same words", "fr") for i in range(12)] + [(12, "many copies of these very same letters", "en"), (13, None, "en"), (14, "", "en")]
    found, want = both(spark, tmp_path, "token_jaccard_blocked", documents=spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert found == want and len(found) == 12 * 11 / 2 + 12


def test_no_rows_are_left_by_their_ids(spark, tmp_path):
    at = [(i, 1 + i // 4, ("click", "view")[i % 2], f"2024-01-01 00:00:{i % 60:02}") for i in range(590, 640)]
    events = spark.createDataFrame(at, "event_id long, user_id long, event_type string, ts string").selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp_ntz) as ts")
    for name in ("link_decisions", "naive_timestamps"):
        found, want = both(spark, tmp_path / name, name, events=events)
        assert found == want and len(found) == 50
    docs = spark.createDataFrame([(i, f"œuvre {'gamma ' * (i % 2)}delta epsilon {i}", "fr") for i in range(500, 510)], "doc_id long, text string, lang string")
    found, want = both(spark, tmp_path / "docs", "bio_coverage", documents=docs)
    assert found == want and len(found) == 9
    lines = spark.createDataFrame([(k, s, 7) for k in (1, 11, 20) for s in (1, 8 + k)], "l_orderkey long, l_suppkey long, l_partkey long")
    found, want = both(spark, tmp_path / "lines", "array_overlap_fanout", lineitem=lines, orders=lines.selectExpr("l_orderkey as o_orderkey").distinct(), part=spark.createDataFrame([(7, "b")], "p_partkey long, p_brand string"))
    assert found == want == [(1, "b"), (19, "b"), (28, "b"), (9, "b")]


def test_queries_meet_smaller_ids(spark, tmp_path):
    e = spark.createDataFrame([(i, i // 150, [1.0, float(i)]) for i in (3, 50, 100, 105, 350)], "vec_id long, label long, embedding array<float>")
    found, want = both(spark, tmp_path, "embedding_cosine_pairs", embeddings=e)
    assert found == want and sorted(r[:2] for r in found) == [(50, 3), (50, 100), (50, 105), (100, 3), (100, 105)]


def test_keys_are_of_whole_texts(spark, tmp_path):
    start = "the very same opening " * 20
    texts = [(1, start + "One"), (2, start + "Two!"), (3, "Another text"), (4, "?!"), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found, want = both(spark, tmp_path / "keys", "search_key_fold", documents=docs)
    assert found == want and len({k for _, k in found if k}) == 3
    asked = spark.createDataFrame([(1, start + "two"), (2, start + "Three"), (3, "Another text"), (4, "!?")], "item_id long, text string")
    found, want = both(spark, tmp_path / "match", "cascade_match", documents=docs, benchmark=asked)
    assert found == want == [(1, "folded", 2, 1), (2, "unmatched", None, 0), (3, "digest", 3, 1), (4, "unmatched", None, 0)]


def test_no_rows_are_left_by_their_values(spark, tmp_path):
    orders = spark.createDataFrame([(k, c, "1-URGENT", "O", f"199{y}-01-01", 100.0) for k, (c, y) in enumerate([(1, 5), (2, 5), (1, 6), (2, 6), (3, 7)])], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate string, o_totalprice double").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    customer = spark.createDataFrame([(1, "A", 1), (2, "A", 2), (3, "A", 3)], "c_custkey long, c_mktsegment string, c_nationkey int")
    supplier = spark.createDataFrame([(98, 1), (99, 2)], "s_suppkey long, s_nationkey int")
    lines = spark.createDataFrame([(0, 98, 1), (0, 99, 3), (4, 98, 4)], "l_orderkey long, l_suppkey long, l_linenumber int")
    found, want = both(spark, tmp_path / "dup", "internal_duplicates", orders=orders, customer=customer)
    assert found == want == [(1, 2)]
    found, want = both(spark, tmp_path / "edges", "related_to_edges", orders=orders, lineitem=lines, supplier=supplier)
    assert found == want == [(0, 98, 1), (0, 99, 1), (4, 98, 1)]
    found, want = both(spark, tmp_path / "wide", "sim_signals_wide", orders=orders, customer=customer, lineitem=lines, supplier=supplier)
    assert found == want and {r[:2] for r in found if r[2] > 0} == {(1, 2), (1, 3), (2, 3)}
