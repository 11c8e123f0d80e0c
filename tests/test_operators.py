"""Operators on hand-made frames: ties, nulls, repeated rows."""

from pyspark.sql import functions as F

from tessera.operators import graph, incremental, matching, reconcile, relational, similarity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "approved"), (2, "b", "open")], "k int, v string, s string")
    new = spark.createDataFrame([(1, None, "open"), (3, "c", "open")], "k int, v string, s string")
    assert rows(reconcile.replace_all(old, new, ["k"])) == [(1, None, "open"), (2, "b", "open"), (3, "c", "open")]
    assert rows(reconcile.keep_unless_given(old, new, ["k"])) == [(1, "a", "open"), (2, "b", "open"), (3, "c", "open")]
    assert rows(reconcile.keep_decisions(old, new, ["k"], "s", ("approved",))) == [(1, None, "approved"), (2, "b", "open"), (3, "c", "open")]
    assert rows(reconcile.keep_existing(old, new.union(new), ["k"], [F.col("v")])) == [(1, "a", "approved"), (2, "b", "open"), (3, "c", "open")]


def test_original_is_remembered_once(spark):
    df = spark.createDataFrame([("u", None), ("v", "o"), ("w", None)], "url string, original string")
    out = reconcile.remember_original(df, "url", "original", F.when(F.col("url") != "w", F.concat("url", F.lit("2"))).otherwise(F.col("url")))
    assert rows(out) == [("u2", "u"), ("v2", "o"), ("w", None)]


def test_repoint_drops_loops_and_twins(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (9, 4)], "a int, b int")
    mapping = spark.createDataFrame([(3, 2)], "old int, new int")
    assert rows(reconcile.repoint_edges(edges, "a", "b", mapping)) == [(1, 2), (9, 4)]


def test_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k int, v string")
    assert rows(reconcile.diff(old, new, ["k"])) == [(1, "same"), (2, "changed"), (3, "removed"), (4, "added")]


def test_new_ids_follow_the_greatest(spark):
    known = spark.createDataFrame([("a", 7)], "name string, id long")
    assert rows(reconcile.new_ids(spark.createDataFrame([("c",), ("b",), ("a",), ("b",)], "name string"), known, "id", "name")) == [("b", 8), ("c", 9)]


def test_cascade_and_decisions(spark):
    pool = spark.createDataFrame([("i1", 5, "ann"), ("i2", 6, "bob"), ("i3", None, "bob"), ("i4", 7, "cy"), ("i5", 7, "di")], "id string, ref int, name string")
    ask = spark.createDataFrame([("a", 5, "zed"), ("b", None, "bob"), ("c", 7, "cy"), ("d", 1, "no"), ("e", 1, "cy")], "key string, ref int, name string")
    found = {r["key"]: (r["method"], r["matched_id"]) for r in matching.cascade(ask, pool, "key", [("ref", "ref"), ("name", "name")]).collect()}
    assert found == {"a": ("ref", "i1"), "b": ("name_ambiguous", None), "c": ("ref_ambiguous", None), "d": ("unmatched", None), "e": ("name", "i4")}
    sets = spark.createDataFrame([(["x"],), (["x", "x"],), (["x", "y"],), ([],)], "ids array<string>")
    assert [r[0] for r in sets.select(matching.decide(F.col("ids"))).collect()] == ["bind", "bind", "ambiguous", "seed"]


def test_tie_breaks(spark):
    c = spark.createDataFrame([(1, "Ann", "x", 1, 0.99), (1, "Ann", "ann", 2, 0.99), (2, "Bo", "bob", 3, 0.96), (2, "Bo", "bobby", 4, 0.96), (3, "Cy", "cyn", 5, 0.94), (4, "D", "dx", 6, 0.97), (4, "D", "dy", 7, 0.97)], "q int, ours string, name string, id int, score double")
    found = {r["q"]: (r["chosen"], r["status"]) for r in matching.break_ties(c, "q", "score", "name", "ours", "id").collect()}
    assert found == {1: (2, "exact"), 2: (3, "shortest"), 3: (5, "below"), 4: (6, "tie")}


def test_jaro_winkler(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), (None, "a"), ("abc", "abc")], "a string, b string")
    found = [r[0] for r in df.select(matching.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert [None if x is None else round(x, 4) for x in found] == [0.9611, 0.8133, 0.0, None, 1.0]


def test_signals_null_is_not_zero(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(similarity.weighted_available({"a": 0.5, "b": 0.5})).collect()] == [None, 1.0, 0.5]
    assert [r[0] for r in df.select(similarity.weighted_sum({"a": 2, "b": 2})).collect()] == [0.0, 0.5, 0.5]


def test_hot_items_are_reported(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(5)] + [(0, "x"), (1, "x")], "id int, item string")
    assert rows(similarity.shared_items(df, "id", "item", 3)) == [(0, 1, 1)]
    assert rows(similarity.left_out(df, "id", "item", 3)) == [("hot", 5)]


def test_components_and_closure(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)], "a int, b int")
    assert rows(graph.components(edges)) == [(2, 2), (3, 2), (4, 2), (5, 2), (7, 7), (8, 8), (9, 8)]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "a int, b int")
    seeds, stops = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(4,)], "id int")
    assert rows(graph.closure(seeds, e, stops)) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_ledger_and_routes(spark):
    ledger = spark.createDataFrame([(1, "m", 10), (2, None, 20), (3, "m", 30)], "k int, m string, p int")
    sweep = spark.createDataFrame([(1, "m"), (2, "x"), (4, "y")], "k int, m string")
    assert rows(incremental.reset_if_modified(ledger, sweep, "k", "m", "p")) == [(1, "m", 10), (2, "x", None), (3, "m", 30), (4, "y", None)]
    work = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, None)], "k int, url string")
    failed = spark.createDataFrame([(2, "u"), (3, "old"), (4, None)], "k int, url string")
    assert rows(incremental.route(work, spark.createDataFrame([(1,)], "k int"), failed, "k", "url")) == [(1, "u", "done"), (2, "u", "skip"), (3, "u", "retry"), (4, None, "skip")]


def test_rate_limit_windows(spark):
    ms = [0, 10, 20, 99, 100, 250]
    events = spark.createDataFrame([("a", t, i) for i, t in enumerate(ms)] + [("b", 5, 9)], "k string, ms long, id long")
    found = {r["id"]: (r["count"], r["allowed"], r["retry_after_s"]) for r in incremental.rate_limit(events, "k", "ms", "id", 2, 100).collect()}
    assert found == {0: (1, True, None), 1: (2, True, None), 2: (3, False, 1), 3: (4, False, 1), 4: (1, True, None), 5: (1, True, None), 9: (1, True, None)}


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (3, -1)], "a int, b int")
    assert rows(relational.violations(df, {"positive": F.col("b") > 0}).select("a", "broken")) == [(3, ["positive"])]
    assert rows(relational.orphans(df, spark.createDataFrame([(2,)], "id int"), "b", "id")) == [(3, -1)] or rows(relational.orphans(df, spark.createDataFrame([(2,)], "id int"), "b", "id").select("a", "b")) == [(3, -1)]
    assert relational.duplicates(df, ["a"]).collect()[0]["n"] == 2


def test_closure_of_a_long_chain(spark):
    e = spark.range(60).selectExpr("id as a", "id + 1 as b")
    found = graph.closure(spark.createDataFrame([(0,), (None,)], "id long"), e)
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(61)]


def test_until_stable_tells_when_it_is_not(spark):
    step = lambda df: df.unionByName(df.selectExpr("id + 1 as id").where("id < 5")).distinct()
    state, n, stable = graph.until_stable(spark.range(1), step)
    assert (state.count(), n, stable) == (5, 5, True)
    assert graph.until_stable(spark.range(1), step, 2)[1:] == (2, False)


def test_new_rows_of_one_key_come_in_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "z"), (2, "y"), (3, None)], "k int, v string")
    assert rows(reconcile.replace_all(old, new, ["k"])) == [(1, "a"), (2, "z"), (3, None)]
    assert rows(reconcile.replace_all(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "x"), (3, None)]


def test_failure_runs_cross_stretches(spark):
    import random

    rng = random.Random(3)
    events = [(rng.choice("ab"), i, rng.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(events, "k string, i long, bad boolean")
    want, open_ = [], {}
    for k, i, bad in [*events, ("a", 400, False), ("b", 401, False)]:
        if bad:
            open_.setdefault(k, []).append(i)
        elif len(open_.get(k, ())) >= 3:
            want.append((k, len(open_[k]), open_[k][0], open_.pop(k)[-1]))
        else:
            open_.pop(k, None)
    for stretch in (7, 1 << 20):
        assert sorted(map(tuple, incremental.failure_runs(df, "k", "i", F.col("bad"), 3, stretch).collect())) == sorted(want)


def test_sharing_counts_each_other_once(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", None), (4, "b", "x"), (5, None, None), (6, None, "y"), (7, "c", "y"), (8, "d", "z")], "id long, p string, q string")
    given = {r["id"]: (r["p"], r["q"]) for r in df.collect()}
    want = {i: sum(j != i and ((p is not None and p == u) or (q is not None and q == v)) for j, (u, v) in given.items()) for i, (p, q) in given.items() if p is not None or q is not None}
    assert dict(rows(matching.sharing(df, "id", "p", "q"))) == want
