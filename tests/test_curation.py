"""Parsers, scores and composite curation on hand-made frames."""

import json

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.functions import times as T
from tessera.functions import urls as U
from tessera.operators import curation as C


def run(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_contacts(spark):
    bio = "Hello\nBooking: a@x.org\nManagement:\nb@x.org\nc@x.org\n\nnot this\nNews: soon\nnor this"
    a, b, c = run(spark, X.contacts, [bio, "no labels", None])
    assert (a["booking"], a["management"], a["contact"]) == ("a@x.org", "b@x.org c@x.org", None)
    assert tuple(b) == (None, None, None) and (c is None or tuple(c) == (None, None, None))


def test_label_lines_and_links(spark):
    assert run(spark, lambda c: X.without_label_lines(c, "linktr"), ["a\nLinks:\nhttps://linktr.ee/x\nb"]) == ["a\n\nb"]
    assert run(spark, X.is_generic, ["Listen to Bob for free", "A band", " "]) == [True, False, True]
    once = run(spark, lambda c: X.add_at(c, "https://m/"), ['<a href="https://m/bob">bob</a>'])
    assert once == ['@<a href="https://m/bob">bob</a>'] and run(spark, lambda c: X.add_at(c, "https://m/"), once) == once


def test_sanitise_and_linkify(spark):
    dirty = '<p onclick="x">a<script>bad()</script><a href="javascript:x">l</a><a href="https://a.com/?a=1&b=2">m</a> 1 < 2</p>'
    assert run(spark, H.sanitise, [dirty, None]) == ['<p>a<a>l</a><a href="https://a.com/?a=1&amp;b=2" target="_blank" rel="noopener noreferrer">m</a> 1 &lt; 2</p>', None]
    assert run(spark, H.linkify, ["see https://a.com/x."]) == ['see <a href="https://a.com/x" target="_blank" rel="noopener">https://a.com/x</a>.']


def test_json(spark):
    assert run(spark, lambda c: T.rest_of_object(c, ("a",)), ['{"a": "1", "b": "2"}']) == ['{"b":"2"}']
    full = json.dumps({"id": 5, "date": "2024-05-01T10:00:00", "title": {"rendered": "t"}, "tags": [1], "authors": [{"term_id": 9, "slug": "s"}]})
    a, b = run(spark, T.post_record, [full, '{"id": 6, "date": "bad"}'])
    assert (a["post_id"], str(a["post_date"]), a["title"], a["tag_ids"], a["term_ids"]) == (5, "2024-05-01 10:00:00", "t", [1], [9])
    assert (b["post_id"], b["post_date"], b["tag_ids"], b["term_ids"]) == (6, None, [], [])


def test_times(spark):
    said = [None if x is None else str(x) for x in run(spark, T.start_argument, ["2024-05-01", "2024-05-01T10:30", "2024-05-01 10:30:05", "x"])]
    assert said == ["2024-05-01 00:00:00", "2024-05-01 10:30:00", "2024-05-01 10:30:05", None]
    assert run(spark, T.blank_to_null, [" ", "a "]) == [None, "a"]


def test_fnv_vectors(spark):
    assert run(spark, S.fnv1a, ["", "a", "foobar"]) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]  # published test vectors


def test_scores(spark):
    df = spark.createDataFrame([(None, 10), (90, 10), (90, 500), (75, 500), (170, 500)], "p int, n int")
    assert [r[0] for r in df.select(S.popularity_score(F.col("p"), F.col("n"))).collect()] == [1.0, 0.5, 0.8, 0.95, 0.3]
    pair = spark.createDataFrame([("Berlin, Germany", "berlin"), (None, "x"), ("", "x")], "a string, b string")
    assert [r[0] for r in pair.select(S.location_score(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_profile_links(spark):
    found = run(spark, lambda c: U.profile_link(c, "site.com"), ["@bob", "site.com/bob/", "https://www.site.com/bob?x=1", "https://else.com/bob", "https://site.com/search?q=b", ""])
    assert [(r["url"], r["handle"], r["warning"]) for r in found] == [("https://site.com/bob", "bob", None)] * 3 + [("https://else.com/bob", None, "foreign"), ("https://site.com/search?q=b", None, "search"), ("", None, "empty")]


def test_link_decisions(spark):
    cols = "id int, owner string, platform string, url string, new_platform string, new_url string"
    r = spark.createDataFrame([(1, "a", "web", "u1", "web", "u1"), (2, "a", "web2", "u2", "web", "u1"), (3, "a", "x", "u3", "web", "u9"), (4, "b", "x", "u4", "web", "u4"), (5, "b", "y", "u5", "web", "u5"), (6, "c", "x", "u", "odd", "u")], cols)
    found = {x["id"]: x["decision"] for x in C.decide_links(r, spark.createDataFrame([("web",), ("x",)], "key string")).collect()}
    assert found == {1: "unchanged", 2: "duplicate", 3: "collision", 4: "updated", 5: "collision", 6: "unknown-platform"}


def test_candidates(spark):
    asked = spark.createDataFrame([(1, "Ann Lee", "Berlin", None), (2, "Bob", None, None)], "q int, name string, place string, bio string")
    found = spark.createDataFrame([(1, 10, "Ann Lee", "Berlin", None, 10), (1, 11, "Ann Li", "Paris", None, 10), (2, 20, "Rob", None, None, None)], "q int, id int, c_name string, c_place string, c_bio string, popularity int")
    ranked, decided = C.resolve_candidates(asked, found, {"name": 0.6, "place": 0.2, "bio": 0.1, "popularity": 0.1})
    assert [(r["id"], r["rank"]) for r in ranked.where("q = 1").orderBy("rank").collect()] == [(10, 1), (11, 2)]
    assert {r["q"]: (r["chosen"], r["status"]) for r in decided.collect()} == {1: (10, "best"), 2: (20, "below")}


def test_slug_states(spark):
    things = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "d"), (5, "e"), (6, None)], "id int, slug string")
    terms = spark.createDataFrame([(11, "a", None), (12, "b", None), (13, "c", None), (14, "d", 4), (15, "e", 9)], "term int, slug string, bound int")
    assert {r["term"]: r["state"] for r in C.bind_by_slug(things, terms).collect()} == {11: "bind", 12: "ambiguous", 13: "unmatched", 14: "already", 15: "conflict"}


def test_link_keys_meet(spark):
    df = spark.createDataFrame([("https://a.com/Bob", "sc", "Bob"), ("http://www.a.com/bob/", "sc", None)], "u string, p string, h string")
    a, b = (r[0] for r in df.select(U.link_keys(F.col("u"), F.col("p"), F.col("h"))).collect())
    assert set(a) & set(b) == {"sc|url|a.com/bob"} and "sc|handle|bob" in a


def test_credits(spark):
    kind = "release int, artists array<struct<id:long,name:string>>, tracks array<struct<id:long,name:string>>, fallback string"
    a = lambda *xs: [{"id": i, "name": n} for i, n in xs]
    rows = [(1, a((1, "A"), (1, "a"), (None, " b "), (0, "B"), (None, None), (2, "A")), None, None), (2, a((194, "Various")), a((5, "X"), (None, "y"), (5, "Z")), None), (3, a((None, "various")), [], "f"), (4, None, a((1, "A")), " f "), (5, [], [], None)]
    found = C.credits(spark.createDataFrame(rows, kind)).orderBy("release", "place").collect()
    assert [tuple(r) for r in found] == [(1, 0, 1, "A"), (1, 1, None, "b"), (1, 2, 2, "A"), (2, 0, 5, "X"), (2, 1, None, "y"), (3, 0, None, "various"), (4, 0, None, "f"), (5, 0, None, "")]


def test_patch_groups_are_bounded(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'a', 'b') as status", "cast(null as int) as n")
    alone = df.withColumn("sets", F.array(F.lit("status")))  # leaves n alone; without it n is set to null
    for given, sets, rest in ((alone, "sets", ""), (df, None, ',"n":null')):
        found = C.patch_groups(given, "id", 100, sets).collect()
        assert {r["patch"] for r in found} == {f'{{"status":"{x}"{rest}}}' for x in "ab"} and max(len(r["ids"]) for r in found) < 200
        assert sorted(i for r in found for i in r["ids"]) == list(range(5000))


def test_decisions_contradicted_or_met(spark):
    answers = spark.createDataFrame([(1, "set", "x"), (1, "set", "y"), (2, "set", "x"), (2, "set", "x"), (3, "set", "x"), (4, "drop", None), (5, "set", "z")], "id int, action string, value string")
    now = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, value string")
    assert {r["id"]: (r["action"], r["value"], r["state"]) for r in C.apply_decisions(answers, now).collect()} == {1: (None, None, "contradicted"), 2: ("set", "x", "satisfied"), 3: ("set", "x", "apply"), 4: ("drop", None, "satisfied"), 5: ("set", "z", "unknown")}


def test_stages_and_cache(spark, tmp_path):
    import pytest

    from tessera.operators.stages import run_stages
    from tessera.sources import providers
    from tessera.storage import fresh, invalidate

    calls = []
    make = lambda: (calls.append(1), spark.range(len(calls)))[1]
    path = str(tmp_path / "c")
    assert [fresh(spark, path, 600, make, now).count() for now in (1000.0, 1500.0, 1601.0, 1700.0)] == [1, 1, 2, 2]
    invalidate(spark, path)
    assert fresh(spark, path, 600, make, 1700.0).count() == 3
    fail = lambda: 1 / 0
    frames, told = run_stages(spark, [("a", lambda: spark.range(2), False), ("b", fail, True), ("c", lambda: None, False), ("d", fail, False), ("e", lambda: spark.range(1), True)])
    assert [r["state"] for r in told.orderBy("place").collect()] == ["done", "failed", "done", "failed", "not run"] and list(frames) == ["a"]
    asked = spark.createDataFrame([(1, "x")], "q long, text string")
    with pytest.raises(KeyError, match="nobody"):
        providers.ask(asked, ["nobody"])
    spark.range(1).withColumn("secret", F.lit(1)).createOrReplaceTempView("seen_by_all")
    try:
        found = {tuple(r) for r in providers.exposed(spark, {"seen_by_all": ("id",)}).collect()}
        assert ("seen_by_all", "secret") in found and ("seen_by_all", "id") not in found
    finally:
        spark.catalog.dropTempView("seen_by_all")
