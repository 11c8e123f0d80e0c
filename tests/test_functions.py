"""Column builders against small tables of cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import text as X
from tessera.functions import urls as U


def run(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_fold_like_unicode_tables(spark):
    values = [c for c in X.ACCENTED + X.ACCENTED.upper() if c.lower() != "i̇"]
    want = ["o" if c.lower() == "ø" else unicodedata.normalize("NFD", c.lower())[0] for c in values]
    assert run(spark, X.fold, values) == want


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.search_key, "Ænima & Søn", "aenimason"), (X.search_key, "猫", None), (X.search_key, "...", None), (X.search_key, None, None), (X.search_key, "", None),
        (X.words_key, "  Don't—Stop ", "don t stop"), (X.handle_key, "@ab", None), (X.handle_key, "@a.b.c", "abc"), (X.tag_key, "Drum-and-Bass", "drum and bass"),
        (X.collapse_spaced, "t e c h", "tech"), (X.collapse_spaced, "a b", "a b"), (X.slug, "Été à Nice!", "ete-a-nice"), (X.escape_like, "5%_\\", "5\\%\\_\\\\"),
        (X.first_uuid, "x 123E4567-e89b-12d3-a456-426614174000 y", "123e4567-e89b-12d3-a456-426614174000"), (X.strip_markup, "[a=Bob] [url=x]here[/url] [b]b[/b]", "Bob here b"),
        (U.normal_url, "HTTPS://www.A.com/x/?q=1#f", "a.com/x"), (U.host, "http://u@My_Host.com:80/x", "my_host.com"), (U.host, "no url", None), (U.host, None, None),
        (U.strip_tracking, "http://www.a.com/p/?utm_source=x&k=2", "https://a.com/p?k=2"), (U.canonical_url, "http://A.com/p/?b=1#z", "https://a.com/p?b=1"),
        (U.domain, "https://x.y.a.com/", "a.com"), (U.subdomain, "https://x.y.a.com/", "x.y"), (U.upgrade_https, "http://a", "https://a"), (U.last_segment, "http://a.com/b/c/", "c"),
        (U.numeric_id, "http://a.com/r/123-name", 123), (U.handle, "https://a.com/@bob/x", "bob"), (U.without_size, "http://a/b-300x200.jpg", "http://a/b.jpg"), (U.host_path, "Not A Url", "not a url"),
        (H.title, "<title>\n x </title>", "x"), (H.title, "<p>", None), (H.to_text, "<p>a<br>b</p><script>x</script>c", "a\nb\nc"),
    ],
)
def test_cases(spark, f, value, want):
    assert run(spark, f, [value]) == [want]


def test_set_similarity_edges(spark):
    df = spark.createDataFrame([([], ["a"]), (["a"], ["a"]), (["a", "b"], ["b", "c"]), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1 / 3, 0.0]
    assert [r[0] for r in df.select(X.overlap(F.col("a"), F.col("b"))).collect()] == [None, 1.0, 0.5, 0.0]


def test_redirects_and_issues(spark):
    wrapped = "https://l.x.com/?u=https%3A%2F%2Fr.x.com%2F%3Furl%3Dhttps%253A%252F%252Fa.com%252Fp"
    assert run(spark, lambda c: U.unwrap(c, ("l.x.com", "r.x.com")), [wrapped, "https://a.com"]) == ["https://a.com/p", "https://a.com"]
    assert run(spark, U.issues, ["http://a.com/ b", "https://a.com"]) == [["white space", "http"], []]


def test_page_image_states(spark):
    pages = ['<meta property="og:image" content="http://i/a.jpg">', '<meta content="http://i/b.jpg" name="twitter:image">', '<meta property="og:image" content="">', "<p>", '<meta property="og:image" content="http://i/default.png">']
    assert [(r["url"], r["status"]) for r in run(spark, H.page_image, pages)] == [("http://i/a.jpg", "found"), ("http://i/b.jpg", "found"), (None, "empty tag"), (None, "no tag"), (None, "placeholder")]
    assert run(spark, H.unescape, ["&amp;&#233;&#x41;", None]) == ["&éA", None]
    import html

    mixed = ["&amp;lt;", "&lt;b&gt; &quot;x&quot; &#39;&#039;&apos;", "&eacute;&nbsp;&#38;lt;", "&amp &ampx", "a & b", "&", "&#150;&#0;", "&amp;#65;", ""]
    assert run(spark, H.unescaped, [*mixed, None]) == [*map(html.unescape, mixed), None]


def test_page_hooks(spark):
    image = lambda c: H.background_image(c, "pic")
    pages = ['<div style="background-image: url(a.jpg)" class="pic big">', "<div class=\"x pic\" style=\"background-image:url('b&amp;c')\">", '<div class="picture" style="background-image:url(a)">', '<div class="pic" style="color: red">', None]
    assert run(spark, image, pages) == ["a.jpg", "b&c", None, None, None]
    links = lambda c: H.links_within(c, "div", "class", "s")
    assert run(spark, links, ['<div class="s"><a href="">x</a><a href="b">y</a></div><div class="t"><a href="c"></a></div><div class="s"><a href="b"></a><a href="a"></a></div>', "<p>"]) == [["b", "a"], []]
    near = lambda c: H.image_after(c, "mark", 40)
    assert run(spark, near, ['<b id="mark"><a href="x.jpg">', '<b id="mark">' + " " * 40 + '<a href="x.jpg">', '<a href="x.jpg">', 'mark <a href="x.txt">']) == ["x.jpg", None, None, None]
    assert run(spark, lambda c: H.body_number(c, "author"), ['<body class="a author-12 b">', '<body class="author-2hot">', "<p>"]) == [12, None, None]
    assert run(spark, H.basic_entities, ["&amp;lt; &quot;&#39;"]) == ["&lt; \"'"]


def test_link_rules(spark):
    rules = {"v": U.LinkRule(whole=("/results",), params=(("/watch", ("v", "t")),), profiles=(("^@.", 1), ("(?i)^(channel|c)$", 2))), "n": U.LinkRule(number=True)}
    cases = [
        ("v", "https://YouV.com/watch?t=1&v=a&si=x#y", "https://YouV.com/watch?v=a&t=1"), ("v", "youv.com/watch?si=x", "youv.com/watch"), ("v", "youv.com/@a/videos?x=1", "youv.com/@a"), ("v", "HTTPS://YouV.com/channel/b/about", "https://youv.com/channel/b"),
        ("v", "https://youv.com/results?q=a b", "https://youv.com/results?q=a b"), ("v", "https://youv.com/@a?x=1", "https://youv.com/@a"), ("v", " not a link ", "not a link"), ("n", "https://b.com/artist/x/12/tracks?p=1", "https://b.com/artist/x/12"),
        ("n", "https://b.com/artist/12?p=1", "https://b.com/artist/12"), ("n", "https://b.com/artist/x", "https://b.com/artist/x"), ("o", "https://b.com/x?y#z", "https://b.com/x"), ("v", None, None), ("o", "", ""),
    ]
    rows = spark.createDataFrame([(i, p, u) for i, (p, u, _) in enumerate(cases)], "i int, p string, u string").select("i", U.clean_link(F.col("u"), F.col("p"), rules).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in rows] == [want for *_, want in cases]


def test_natural_keys_sort_like_people(spark):
    names = ["track 10", "Track 9", "étude", "Etude 2", "track 009b", "track 10000000000000000000", "", "7"]
    keyed = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in keyed] == ["", "7", "étude", "Etude 2", "Track 9", "track 009b", "track 10", "track 10000000000000000000"]
