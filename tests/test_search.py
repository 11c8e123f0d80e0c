"""Joins without blocks, redirect chains, nested JSON and streams out of order against plain Python."""

import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import alike, curation, incremental, json_tree, matching, redirects
from tessera.plans import match
from tessera.streaming import ordered


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
@pytest.mark.parametrize("q", [2, 3])
def test_edit_pairs(spark, most, q):
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 11))) for _ in range(150)} | {"a" * 20, "a" * 21, "ab" * 9, "ba" * 9})
    df = spark.createDataFrame([*((w,) for w in words), (words[3],), (None,)], "w string")
    want = {(a, b, edits(a, b)) for a, b in combinations(words, 2) if edits(a, b) <= most}
    found = alike.edit_pairs(df, "w", most, q).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("per_mille", [120, 300, 500, 750, 999, 1000])
def test_set_pairs(spark, per_mille):
    rng = random.Random(per_mille)
    sets = {}
    for i in range(170):
        base = set(rng.choice([*sets.values()])) if sets and rng.random() < 0.6 else set()
        sets[i] = frozenset(rng.sample(sorted(base), int(len(base) * rng.choice((0.6, 0.9, 1))))) | frozenset(rng.choices(range(50), k=rng.choice((0, 1, 4, 12))))
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sets, 2) if sets[a] | sets[b] and 1000 * len(sets[a] & sets[b]) >= per_mille * len(sets[a] | sets[b])}
    found = alike.set_pairs(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>"), per_mille).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in found} == want and len(found) == len(want) > 5
    assert all(abs(r["jaccard"] - r["shared"] / len(sets[r["a"]] | sets[r["b"]])) < 1e-12 for r in found)


@pytest.mark.parametrize("per_mille", [300, 500, 700])
def test_trigram_pairs_like_nested_loop(spark, sf, per_mille):
    names = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct()
    key = X.search_key(F.col("p_name"))
    a, b = names.select(F.col("p_name").alias("a")), names.select(F.col("p_name").alias("b"))
    loop = a.join(b, F.col("a") < F.col("b")).withColumn("s", X.trigram_similarity(X.search_key(F.col("a")), X.search_key(F.col("b")))).where(F.col("s") >= per_mille / 1000 - 1e-12)
    assert {(r["a"], r["b"]) for r in alike.trigram_pairs(names, "p_name", key, per_mille).collect()} == {(r["a"], r["b"]) for r in loop.collect()}


def test_trigram_similarity_of_every_pair(spark, tmp_path):
    """No pair is left out, however little alike, and names without a key are compared too."""
    names = ["hot ring", "hot rings", "blue gear", "old plate", "zz", "--", "中", "hot ring", None]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r["a"], r["b"]): r["similarity"] for r in match.trigram_similarity(spark, str(tmp_path)).collect()}
    key = lambda n: "  " + "".join(c for c in n if "a" <= c <= "z") + " "
    sets = {n: {key(n)[i : i + 3] for i in range(len(key(n)) - 2)} for n in names if n}
    assert found == {(a, b): pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), abs=6e-5) for a, b in combinations(sorted(sets), 2)}
    assert len(found) == 21 and found["blue gear", "zz"] == 0


def test_no_item_makes_all_pairs(spark):
    """An item that all sets hold brings only sets of like sizes together, and none where all are equal."""
    n = 400
    sets = spark.range(n).selectExpr("id", "transform(sequence(0, cast(pow(2, id % 8) as int)), x -> if(x = 0, 0L, xxhash64(id % 8, x))) as items")
    assert alike.set_pairs(sets, 800).count() == 8 * (n // 8) * (n // 8 - 1) // 2


def test_jaro_winkler_behind_its_bound(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghéß z") for _ in range(rng.randint(0, 12)))
    pairs = {(word(), word()) for _ in range(1500)} | {("martha", "marhta"), ("aaaaaaaaa", "aaaaaaa"), ("dixon", "dicksonx")}
    for w in [word() for _ in range(300)]:
        i = rng.randrange(len(w) + 1)
        pairs.add((w, w[:i] + rng.choice("abz") + w[i:]))
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    for whole in (False, True):
        want = {(a, b): s for a, b in pairs if (s := matching._jaro_winkler(a, b, whole)) >= 0.82}
        assert {(r["a"], r["b"]): r["similarity"] for r in matching.jaro_winkler_pairs(df, 0.82, whole).collect()} == want
    bits = df.select("a", "b", alike.jaro_winkler_bound(F.col("a"), F.col("b"), alike.letter_bits(F.col("a")), alike.letter_bits(F.col("b"))).alias("u"))
    reach = bits.where("u >= 0.82").count()
    assert len(want) <= reach < 0.5 * len(pairs)


def landed_rows():
    rows = [(f"http://bit.ly/{i}", 301, f"/{i + 1}", None) for i in range(60)] + [("http://bit.ly/60", 200, None, None)]
    rows += [("http://bit.ly/l1", 302, "http://bit.ly/l2", None), ("http://bit.ly/l2", 307, "http://bit.ly/l1", None), ("http://bit.ly/self", 302, "http://bit.ly/self", None)]
    rows += [("https://fb.me/x", 301, "https://www.facebook.com/me?a=1", None), ("https://www.facebook.com/me?a=1", 200, None, None), ("https://fb.me/y", 301, "//evilfacebook.com/", None), ("https://evilfacebook.com/", 200, None, None)]
    rows += [("https://fb.me/t", None, None, "timeout"), ("https://fb.me/d", None, None, "dns"), ("https://fb.me/bad", 301, "http:// bad", None), ("https://fb.me/gone", 302, "https://facebook.com/gone", None), ("https://facebook.com/gone", 404, None, None)]
    rows += [("https://vm.tiktok.com/a/b", 301, "https://tiktok.com/@who", None), ("https://tiktok.com/@who", 200, None, None), ("https://vm.tiktok.com/c", 301, "https://tiktok.com/?_r=1", None), ("https://tiktok.com/?_r=1", 200, None, None), ("https://bit.ly/plain", 200, None, None), ("https://bit.ly/304", 304, None, None)]
    rows += [("https://bit.ly/far", 301, "next?x=1", None), ("https://bit.ly/next?x=1", 301, "?y=2", None), ("https://bit.ly/next?y=2", 301, "http://unseen.org/", None), ("https://bit.ly/late", 301, "https://fb.me/t", None), ("https://bit.ly/plain", 200, None, None)]
    return rows


@pytest.mark.parametrize("hops", [5, 64])
def test_redirects(spark, hops):
    landed = spark.createDataFrame(landed_rows(), "url string, status int, location string, error string")
    asked = ["http://bit.ly/0", "http://bit.ly/55", "http://bit.ly/54", "http://bit.ly/l1", "http://bit.ly/self", " fb.me/x", "https://fb.me/y", "https://fb.me/t", "https://fb.me/d", "https://fb.me/bad", "https://fb.me/gone", "https://fb.me/unseen", "https://vm.tiktok.com/a/b", "https://vm.tiktok.com/c", "https://bit.ly/plain", "https://bit.ly/304", "https://bit.ly/far", "https://bit.ly/late", "http://x.org/", "https://maps.bit.ly/1", None, "fb.me/x"]
    found = {r["url"]: r for r in redirects.resolve(spark.createDataFrame([(u,) for u in asked], "url string"), landed, max_hops=hops).collect()}
    assert len(found) == len(set(asked) - {None})
    reason = {u: r["reason"] for u, r in found.items()}
    long_ = "max-hops" if hops == 5 else None
    assert reason == {
        "http://bit.ly/0": long_, "http://bit.ly/55": None, "http://bit.ly/54": long_, "http://bit.ly/l1": "max-hops", "http://bit.ly/self": "max-hops", " fb.me/x": None, "fb.me/x": None, "https://fb.me/y": "validation-failed", "https://fb.me/t": "timeout", "https://fb.me/d": "network-error",
        "https://fb.me/bad": "network-error", "https://fb.me/gone": "dead-destination", "https://fb.me/unseen": "not-landed", "https://vm.tiktok.com/a/b": None, "https://vm.tiktok.com/c": "validation-failed", "https://bit.ly/plain": "no-redirect", "https://bit.ly/304": "no-redirect",
        "https://bit.ly/far": "not-landed", "https://bit.ly/late": "timeout", "http://x.org/": "not-resolvable", "https://maps.bit.ly/1": "not-resolvable",
    }
    assert found[" fb.me/x"]["kept"] == "https://www.facebook.com/me?a=1" and found["https://fb.me/y"]["kept"] == "https://fb.me/y" and found["https://fb.me/y"]["destination"] == "https://evilfacebook.com/"
    assert found["http://bit.ly/0"]["destination"] == ("http://bit.ly/5" if hops == 5 else "http://bit.ly/60") and found["http://bit.ly/55"]["hops"] == 5
    assert (found["https://fb.me/gone"]["final_status"], found["https://bit.ly/far"]["destination"], found["https://bit.ly/far"]["hops"]) == (404, None, 3)
    assert redirects.resolve(spark.createDataFrame([], "url string"), landed).count() == 0


def breadth_first(doc, key):
    """(depth, values that the key has at the first depth that has any), by plain Python."""
    level, depth = [doc], 0
    while level:
        hits = [n[key] for n in level if isinstance(n, dict) and key in n]
        if hits:
            return depth, hits
        level, depth = [v for n in level for v in (n.values() if isinstance(n, dict) else n if isinstance(n, list) else ())], depth + 1
    return None


def test_json_search(spark):
    rng = random.Random(2)

    def grow(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.3:
            return rng.choice([1, "x", None, True, 2.5, "é'"])
        if kind < 0.6:
            return [grow(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice("abcdefgh") if rng.random() < 0.93 else "key": grow(depth + 1) for _ in range(rng.randint(0, 4))}

    many = {"n": list(range(25_000)), "p": {"q": [{"key": {"id": 1}}]}}
    docs = [grow(0) for _ in range(120)] + [many, {"z": {"key": None}}, [[[[{"key": 0}]]]]]
    rows = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(900, "{"), (901, None), (902, ""), (903, "7")]
    df = spark.createDataFrame(rows, "id long, t string")
    found = {r["id"]: (r["depth"], json.loads(r["value"])) for r in json_tree.first_values(df, "id", "t", "key").collect()}
    want = {i: w for i, x in enumerate(docs) if (w := breadth_first(x, "key"))}
    assert set(found) == set(want) and len(want) > 10 and 120 in want
    assert all(d == want[i][0] and v in want[i][1] for i, (d, v) in found.items())
    plan = json_tree.first_nodes(df, "id", "t", lambda n: json_tree.has(n, "key"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_json_search_takes_conditions(spark):
    """An object is known by an array of links and one of some fields."""
    page = {"links": 1, "in": [{"links": []}, {"links": [1], "title": "t", "x": {"links": [2], "name": "deeper"}}]}
    accepts = lambda n: F.try_variant_get(n, "$.links", "array<variant>").isNotNull() & (json_tree.has(n, "name") | json_tree.has(n, "title"))
    found = json_tree.first_nodes(spark.createDataFrame([(1, json.dumps(page))], "id long, t string"), "id", "t", accepts)
    assert [(r["depth"], json.loads(r["j"])["title"]) for r in found.select("depth", F.to_json("node").alias("j")).collect()] == [(2, "t")]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(ordered.SETTING)
    spark.conf.set(ordered.SETTING, ordered.STORE)
    yield
    spark.conf.set(ordered.SETTING, before)


def test_stream_out_of_order_like_batch(spark, tmp_path, rocks):
    rng = random.Random(1)
    schema = "k string, ms long, id long"
    events = [(rng.choice("abc"), rng.randrange(60_000) * 10, i) for i in range(500)] + [("a", 5000, 900), ("a", 5000, 901)]
    events.sort(key=lambda e: e[1] + rng.randrange(200_000))
    for at in range(0, len(events), 101):
        spark.createDataFrame(events[at : at + 101], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(at)))
    spark.createDataFrame([("z", 10**9, -1), (None, 3, -2)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "last"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ordered.rate_limit(stream, "k", "ms", "id", 3, 50_000, "300 seconds").writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = Counter((r["k"], r["id"], r["count"], r["allowed"]) for r in spark.table("ordered").collect())
    want = Counter((r["k"], r["id"], r["count"], r["allowed"]) for r in incremental.rate_limit(spark.createDataFrame(events, schema), "k", "ms", "id", 3, 50_000).collect())
    assert found == want and len(want) == len(events)


def test_stream_needs_its_store(spark, tmp_path):
    stream = spark.readStream.format("rate").load().selectExpr("'a' as k", "value as ms", "value as id")
    with pytest.raises(ValueError, match="stateStore"):
        ordered.rate_limit(stream, "k", "ms", "id", 1, 1, "1 second")


def test_patches_that_set_null(spark):
    rows = [(1, "a", None, ["s", "v"]), (2, "a", 5, ["s"]), (3, "a", None, ["s", "v"]), (4, "q}\n", 7, ["s", "v"]), (5, None, None, [])]
    df = spark.createDataFrame(rows, "id long, s string, v int, sets array<string>")
    found = {r["patch"]: r["ids"] for r in curation.patch_groups(df, "id", sets="sets").collect()}
    assert found == {'{"s":"a","v":null}': [1, 3], '{"s":"a"}': [2], '{"s":"q}\\n","v":7}': [4], "{}": [5]}
    assert {r["patch"] for r in curation.patch_groups(df.drop("sets"), "id").collect()} == {'{"s":"a","v":null}', '{"s":"a","v":5}', '{"s":"q}\\n","v":7}', '{"s":null,"v":null}'}
