"""Small functions and reference rules on hand-made values, nulls among them."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import reconcile


def run(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["x"] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_escapes(spark):
    odd = ["a.b*c", "(x)[y]{z}^$|\\?+", "plain", "it's", None]
    assert all(e is None or re.fullmatch(e, o) for e, o in zip(run(spark, X.escape_regex, odd), odd, strict=True))
    assert run(spark, X.sql_text, ["it's", "", None]) == ["'it''s'", "''", "NULL"]
    assert run(spark, X.csv_field, ["a", 'b"c', "d,e", "f\ng", "", None]) == ["a", '"b""c"', '"d,e"', '"f\ng"', "", ""]
    assert run(spark, lambda c: X.preview(c, 5), [" a \n b ", "abcdefg", "", None]) == ['"a b"', '"abcde…"', "(none)", "(none)"]
    assert run(spark, X.status_label, ["approved", "not_eligible", "sc_only", "no_mb_id", None]) == ["Approved", "Not eligible", "SC only", "No MB id", None]


def test_replacements_within_texts(spark):
    gate = ["a https://gate.sc?url=https%3A%2F%2Fx.org%2Fa%2Bb&token=1 b", "http://gate.sc?url=%E0%A4%A", "https://gate.sc?url=a&x=1https://gate.sc?url=b c", "none", "", None]
    assert run(spark, lambda c: X.without_wrappers(c, r"gate\.sc"), gate) == ["a https://x.org/a+b b", "http://gate.sc?url=%E0%A4%A", "a c", "none", "", None]
    assert run(spark, X.number_entities, ["&#65;&#x1F600;&#XE9;", "&#0;&#xD800;&#1114112;&#99999999999999999999999;", "&amp;#65;", "&#;", None]) == ["A😀é", "�" * 4, "&amp;#65;", "&#;", None]


def test_links_in_detail(spark):
    assert run(spark, U.comparable, ["HTTP://www.X.org/a/?si=1&b=2&utm_source=q#f", "https://x.org", "https://x.org/?pp=1", "no link", None]) == ["https://x.org/a?b=2#f", "https://x.org/", "https://x.org/", "no link", None]
    assert run(spark, lambda c: U.same_link(c, F.lit("https://x.org/a")), ["http://www.x.org/a/", "https://x.org/b", "junk", None]) == [True, False, False, None]
    assert run(spark, lambda c: U.core_url(c, "camp.com"), ["https://A.camp.com/album/x", "http://camp.com", "https://xcamp.com/", "junk"]) == ["https://a.camp.com", "https://camp.com", None, None]
    assert run(spark, lambda c: U.own_subdomain(c, "camp.com"), ["https://a.camp.com/", "https://camp.com/", "junk", None]) == [True, False, False, False]
    assert run(spark, lambda c: U.landed_off(c, "camp.com"), ["https://a.camp.com/", "https://camp.com/", "junk", None]) == [False, True, True, True]
    assert run(spark, lambda c: U.resized(c, "large", "t500x500"), ["a-large.jpg", "a-large", "large-x.jpg", "", None]) == ["a-t500x500.jpg", "a-t500x500", "large-x.jpg", None, None]
    assert run(spark, U.is_placeholder, ["https://a/default_avatar_large.png", "https://a/avatars-1.jpg", None]) == [True, False, False]


def test_deletes_keep_references(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        "b": spark.createDataFrame([(10, 1, None), (11, 2, 10), (12, 3, 11), (13, None, 12), (14, 3, None)], "id long, a long, parent long"),
        "c": spark.createDataFrame([(100, 10, 1), (101, 14, 1), (102, None, 2)], "id long, b long, a long"),
    }
    references = [("b", "a", "a", "cascade"), ("b", "parent", "b", "cascade"), ("c", "b", "b", "set null"), ("c", "a", "a", "set null")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    left = reconcile.delete_with_references(tables, references, {"a": ids(1)})
    assert rows(left["a"]) == [(2,), (3,)] and rows(left["b"]) == [(14, 3, None)]
    assert rows(left["c"]) == [(100, None, None), (101, 14, None), (102, None, 2)]
    untouched = reconcile.delete_with_references(tables, references, {})
    assert all(rows(untouched[t]) == rows(tables[t]) for t in tables)
    with pytest.raises(ValueError, match="still points"):
        reconcile.delete_with_references(tables, [("c", "a", "a", "restrict")], {"a": ids(1)})
    assert rows(reconcile.delete_with_references(tables, [("c", "a", "a", "restrict")], {"a": ids(3)})["a"]) == [(1,), (2,)]
    with pytest.raises(ValueError, match="cycle"):
        reconcile.delete_with_references(tables, [("a", "id", "b", "cascade"), ("b", "a", "a", "cascade")], {"a": ids(1)})
