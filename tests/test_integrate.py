"""Duplicates, combined signals, given pairs, collation, databases, bindings and purges on hand-made frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import binding, duplicates, provenance, relational, similarity
from tessera.sources import tabular


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_duplicate_finder(spark):
    people = spark.createDataFrame([(1, "Anna Bell"), (2, "Ana Bell"), (3, "Zoe"), (4, "Quark"), (5, "Zed Nine"), (6, "Other"), (7, None), (8, "Anna Bell")], "id long, name string")
    links = spark.createDataFrame([(3, "web", "z.org/a", "zoelive"), (4, "web", "z.org/a", None), (5, "tube", "t/5", "zednine"), (6, "cloud", "c/6", "zednine"), (1, "tube", "t/1", "annabell"), (2, "cloud", "c/2", "anabell"), (3, "cloud", "c/3", "zoelive")], "id long, platform string, url string, handle string")
    emails = spark.createDataFrame([(5, "x@y.org"), (4, "x@y.org"), *((i, "all@y.org") for i in range(1, 7)), (4, "x@y.org")], "id long, email string")
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (1, "a")], "id long, tag string")
    places = spark.createDataFrame([(1, "se"), (2, "se"), (5, "no"), (6, "no")], "id long, place string")
    found = {(r["a"], r["b"]): r for r in duplicates.find(people, links, emails, tags, places).collect()}
    assert set(found) == {(1, 2), (1, 8), (2, 8), (3, 4), (4, 5), (5, 6)}
    assert (found[3, 4]["score"], found[3, 4]["band"], found[3, 4]["found_by"], found[3, 4]["signals"]) == (1.0, "high", "url", "url_exact:web")
    assert (found[4, 5]["score"], found[4, 5]["found_by"]) == (0.8, "email") and found[4, 5]["signals"] == "same_email:x@y.org"
    assert abs(found[5, 6]["score"] - 0.93) < 1e-9 and found[5, 6]["signals"] == "handle_cross:zednine, same_country"
    assert found[1, 2]["score"] == 0.99 and "genre_overlap" in found[1, 2]["signals"] and "handle_fuzzy:annabell/anabell" in found[1, 2]["signals"]
    assert found[1, 8]["signals"] == "name_exact" and found[1, 8]["score"] == 0.99
    assert (3, 4) not in {(r["a"], r["b"]) for r in duplicates.find(people, links, emails, tags, places, equal_links=False).collect()}
    more = duplicates.candidates(people, links, emails, extra=spark.createDataFrame([(7, 3)], "a long, b long"))
    assert (3, 7, ("extra",)) in {(r["a"], r["b"], tuple(r["found_by"])) for r in more.collect()}
    none = [df.limit(0) for df in (people, links, emails, tags, places)]
    assert duplicates.find(*none).count() == 0


def test_signals_from_any_direction(spark):
    one = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 3, 1.0), (4, 5, None)], "a int, b int, value double")
    two = spark.createDataFrame([(2, 1, 0.2), (8, 9, 1.0)], "a int, b int, value double")
    long_ = similarity.signal_rows({"x": one, "y": two})
    assert rows(similarity.combined(long_, {"x": 3.0, "y": 1.0})) == [(1, 2, 0.7, 0.2, 3, 0.7 * 0.75 + 0.2 * 0.25), (8, 9, None, 1.0, 2, 0.25)]
    assert [r["total"] for r in similarity.combined(long_, {"x": 3.0, "y": 1.0}, True).orderBy("a").collect()] == [pytest.approx(0.575), 1.0]


@pytest.mark.parametrize("block", [3, 2048])
def test_cosine_of_given_pairs(spark, block):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=5).tolist() for i in range(20)} | {20: [0.0] * 5, 21: [1.0, 2.0], 22: None, 23: [1.0, None, 0.0, 0.0, 0.0], 24: [2.0, 4.0]}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    pairs = [(a, b) for a in range(25) for b in range(26) if (a * 7 + b) % 3 == 0] + [(21, 24), (0, 1), (0, 1), (None, 2)]
    found = {(r["a"], r["b"]): r["cosine"] for r in similarity.pair_cosines(spark.createDataFrame(pairs, "a long, b long"), df, "id", "v", block).collect()}
    assert set(found) == {(a, b) for a, b in pairs if a is not None and vectors.get(a) and vectors.get(b)}
    for (a, b), c in found.items():
        x, y = vectors[a], vectors[b]
        if len(x) != len(y) or None in x or None in y:
            assert c is None
        else:
            size = np.linalg.norm(x) * np.linalg.norm(y)
            assert c == pytest.approx(0.0 if size == 0 else np.dot(x, y) / size, abs=1e-12)


def test_collated_order_like_icu(spark):
    """The order of names, case, accents and numbers apart, is that of the collator of ICU."""
    rng = random.Random(6)
    parts = ["a", "A", "á", "Å", "b", "ß", "ss", "z", "ö", "Ø", " ", "-", "!", "7", "07", "10", "100", "é", "E", "中", "я"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(160)})
    df = spark.createDataFrame(list(enumerate(names)), "id int, s string").withColumn("k", X.collated(F.col("s")))
    jvm = spark._jvm
    icu = jvm.com.ibm.icu.text.Collator.getInstance(jvm.com.ibm.icu.util.ULocale("root")).cloneAsThawed()
    icu.setStrength(0)
    icu.setNumericCollation(True)
    keys = [bytes(icu.getCollationKey(n).toByteArray()) for n in names]
    found = [r["id"] for r in df.orderBy("k", "id").collect()]
    assert found == sorted(range(len(names)), key=lambda i: (keys[i], i))
    groups = {tuple(sorted(r["ids"])) for r in df.groupBy("k").agg(F.collect_list("id").alias("ids")).collect()}
    same = {}
    for i, k in enumerate(keys):
        same.setdefault(k, []).append(i)
    assert groups == {tuple(v) for v in same.values()}
    twins = df.alias("x").join(df.alias("y"), F.col("x.k") == F.col("y.k")).where("x.id < y.id").count()
    assert twins == sum(len(v) * (len(v) - 1) // 2 for v in same.values()) > 0
    assert [r["s"] for r in spark.createDataFrame([("x10",), ("x9",), ("X09",)], "s string").orderBy(X.collated(F.col("s")), "s").collect()] == ["X09", "x9", "x10"]


def test_database_scan(spark):
    """A scan in ranges of a key, with filters and columns left to the database."""
    url = "jdbc:derby:memory:scan;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(1000).selectExpr("cast(if(id % 100 = 99, null, id) as int) as K", "cast(id % 7 as int) as V", "concat('n', id) as NAME")
    df.write.jdbc(url, "APP.THINGS", "overwrite", {**driver, "createTableColumnTypes": "NAME varchar(20)"})
    scan = tabular.read_database(spark, url, "APP.THINGS", "K", 4, **driver)
    assert scan.rdd.getNumPartitions() == 4 and scan.count() == 1000 and scan.where("k is null").count() == 10
    part = scan.where("v = 3 and k > 500").select("name")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(" in plan and "*EqualTo(V,3)" in plan and "*GreaterThan(K,500)" in plan and "Filter" not in plan.split("Scan")[0]
    assert plan.split("ReadSchema: ")[1].lower().startswith("struct<name:string>")
    assert rows(part) == sorted((f"n{i}",) for i in range(501, 1000) if i % 7 == 3 and i % 100 != 99)
    spark.range(0).selectExpr("cast(id as int) as K").write.jdbc(url, "APP.NOTHING", "overwrite", driver)
    assert tabular.read_database(spark, url, "APP.NOTHING", "K", 4, **driver).count() == 0


def test_sample_function(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    df.createOrReplaceTempView("to_sample")
    relational.sample_function(spark, "samples", "to_sample", "c_custkey", ["c_custkey", "c_name"], "s")
    want = rows(relational.seeded_sample(df.select("c_custkey", "c_name"), "c_custkey", 20, "s"))
    assert rows(spark.sql("SELECT * FROM samples(20)")) == want
    assert spark.sql("SELECT * FROM samples(0)").count() == 0
    assert spark.sql("SELECT n, c_custkey FROM VALUES (1), (2) t(n), LATERAL samples(3)").count() == 6


def test_binding(spark):
    terms = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five"), (6, "six")], "term_id long, slug string")
    mine = spark.createDataFrame([(1, "web", "a"), (1, "tube", "a2"), (2, "web", "a"), (3, "web", "a"), (3, "web", "b"), (4, "web", "zz"), (6, "web", "c"), (5, "site", "s/five")], "term_id long, platform string, url string")
    known = spark.createDataFrame([(10, "web", "a"), (10, "tube", "a2"), (11, "web", "b"), (12, "web", "c"), (12, "site", "s/other"), (13, "site", "s/five")], "artist_id long, platform string, url string")
    sets = spark.createDataFrame([([1, 4, 99, 1], ["x", "y", None]), ([2], ["x"]), (None, ["z"]), ([4], None)], "term_ids array<long>, tags array<string>")
    out = binding.integrate(terms, mine, known, sets, "site", F.concat(F.lit("s/"), "slug"))
    assert rows(out["bound"]) == [(1, 10, "social_match"), (2, 10, "social_match"), (4, 14, "seeded_new"), (5, 15, "seeded_new"), (6, 12, "social_match")]
    assert rows(out["ambiguous"]) == [(3, [10, 11])]
    assert rows(out["links"]) == [(10, "s/one", 1), (14, "s/four", 4), (15, "s/five", 5)]
    assert rows(out["conflicts"]) == [(2, 10, "s/two", "s/one"), (6, 12, "s/six", "s/other")]
    assert rows(out["tags"]) == [(10, "x"), (10, "y"), (14, "x"), (14, "y")]


def test_purge(spark):
    links = spark.createDataFrame([("l1", 1, "tree", "submission"), ("l2", 1, "cloud", "harvest:tree"), ("l3", 1, "tube", "harvest:cloud"), ("l4", 1, "tree2", "harvest:tube"), ("l5", 1, "tree", "harvest:tube"), ("l6", 1, "safe", "manual"), ("l7", 1, "kept", "harvest:safe"), ("l8", 2, "cloud", "harvest:tree")], "id string, owner long, platform string, source string")
    gone = provenance.doomed(links, spark.createDataFrame([(1, "tree")], "owner long, source string"))
    assert rows(gone) == [(1, "cloud", 1), (1, "tree", 0), (1, "tree2", 3), (1, "tube", 2)]
    images = spark.createDataFrame([(1, 1, "tube"), (2, 1, "safe"), (3, 2, "cloud"), (4, 1, "tree")], "id long, owner long, platform string")
    artists = spark.createDataFrame([(1, 1, 4, 2, "t"), (2, 2, 3, None, "t"), (3, 3, 1, 1, None), (4, 1, 2, None, None)], "id long, owner long, main long, second long, seen string")
    V = provenance.Verb  # noqa: N806
    registry = [V("artists", "reset", columns=("seen",)), V("artists", "null_ref", columns=("main", "second"), target="images"), V("images", "delete", "platform")]
    after, plan = provenance.purge({"images": images, "artists": artists}, registry, gone)
    assert rows(after["images"]) == [(2, 1, "safe"), (3, 2, "cloud")]
    assert rows(after["artists"]) == [(1, 1, None, 2, None), (2, 2, 3, None, "t"), (3, 3, None, None, None), (4, 1, 2, None, None)]
    assert rows(plan) == [("artists", "null_ref", "1"), ("artists", "null_ref", "3"), ("artists", "reset", "1"), ("images", "delete", "1"), ("images", "delete", "4")]
    with pytest.raises(ValueError):
        provenance.in_order([V("artists", "null_ref", columns=("main",), target="images")])
    with pytest.raises(ValueError):
        provenance.in_order([V("artists", "drop")])
