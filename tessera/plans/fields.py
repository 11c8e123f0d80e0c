"""Keys, links, page fields, records and cells: the column functions over whole tables, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.functions import times as T
from tessera.functions import urls as U
from tessera.operators import graph, incremental, json_tree, matching, reconcile
from tessera.plans.match import _FOLD
from tessera.plans.registry import query, table
from tessera.plans.web import _HOST, _PATH, _QUERY
from tessera.sources import ods, tabular
from tessera.storage import scratch
from tessera.streaming.windows import dedupe, upsert_batches, upserted

_VARIANTS = "v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'Ö ' || upper(p_name) || ' 5%_ <&\"''>' WHEN 2 THEN trim(regexp_replace(left(p_name, 5), '(\\S)', '\\1 ', 'g')) ELSE '@' || left(p_name, 2) END AS s FROM part)"


def _variants(spark, d):
    n, kind = F.col("p_name"), F.col("p_partkey") % 4
    s = F.when(kind == 0, F.replace(n, F.lit(" "), F.lit("-"))).when(kind == 1, F.concat(F.lit("Ö "), F.upper(n), F.lit(" 5%_ <&\"'>"))).when(kind == 2, F.trim(F.regexp_replace(F.left(n, F.lit(5)), r"(\S)", "$1 "))).otherwise(F.concat(F.lit("@"), F.left(n, F.lit(2))))
    return table(spark, d, "part").select("p_partkey", s.alias("s"))


_F = _FOLD.format("s")


@query(rf"""WITH {_VARIANTS} SELECT p_partkey, replace({_F}, ' ', '') AS spaceless, nullif(trim(regexp_replace({_F}, '[^a-z0-9]+', ' ', 'g')), '') AS words,
CASE WHEN length(regexp_replace({_F}, '[^a-z0-9]', '', 'g')) >= 3 THEN regexp_replace({_F}, '[^a-z0-9]', '', 'g') END AS handle, trim(replace({_F}, '-', ' ')) AS tag,
CASE WHEN regexp_matches(s, '^\S([\s-]+\S){{2,}}$') THEN regexp_replace(s, '[\s-]+', '', 'g') ELSE s END AS joined, regexp_replace(regexp_replace({_F}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
replace(replace(replace(s, '\', '\\'), '%', '\%'), '_', '\_') AS pattern, replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM v""")
def name_keys(spark, d):
    s = F.col("s")
    keys = {"spaceless": X.spaceless_key, "words": X.words_key, "handle": X.handle_key, "tag": X.tag_key, "joined": X.collapse_spaced, "slug": X.slug, "pattern": X.escape_like, "xml": X.escape_xml}
    return _variants(spark, d).select("p_partkey", *[f(s).alias(name) for name, f in keys.items()])


@query(rf"""SELECT page_id, regexp_replace({_HOST}, '^www\.', '') || {_PATH} AS bare, 'https://' || {_HOST} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS canonical,
regexp_replace(url, '^http:', 'https:') AS secure, regexp_extract({_PATH}, '([^/]*)$', 1) AS last, CAST(nullif(regexp_extract({_PATH}, '/([0-9]+)(?:[^0-9/][^/]*)?$', 1), '') AS BIGINT) AS number,
regexp_extract(url, '^[^:]+://[^/]+/([^/?#]+)', 1) AS handle, nullif(array_to_string(list_slice(string_split(regexp_replace({_HOST}, '^www\.', ''), '.'), 1, -3), '.'), '') AS profile,
regexp_replace(url, '^https?://(?:www\.)?spam-farm\.example\.org([/?#]|$)', 'https://farm.example.org\1', 'i') AS swapped FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    parts = {"bare": U.host_path(u), "canonical": U.canonical_url(u), "secure": U.upgrade_https(u), "last": U.last_segment(u), "number": U.numeric_id(u), "handle": U.handle(u), "profile": U.handle(u, "subdomain"), "swapped": U.swap_host(u, r"spam-farm\.example\.org", "farm.example.org")}
    return table(spark, d, "pages").select("page_id", *[c.alias(name) for name, c in parts.items()])


@query(rf"""WITH p AS (SELECT page_id, url, {_PATH} AS path FROM pages), q AS (SELECT page_id, url, page_id % 3 AS wraps, path, string_split(path, '/') AS s FROM p)
SELECT page_id, s[2] AS lang, s[3] AS slug, split_part(s[3], '.', 1) IN ('1', '2', '3') AS searched, url AS target, page_id % 2 = 0 AS left_site, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'old' ELSE 'shop' END AS kind FROM q""")
def url_routes(spark, d):
    """Path kinds, search pages, wrapped links (up to two wrappers around each other), redirects to other domains and what they make of a link's class."""
    u, i = F.col("url"), F.col("page_id")
    wrap = lambda c, host: F.concat(F.lit(f"https://{host}/go?x=1&u="), F.url_encode(c))
    wrapped = F.when(i % 3 == 0, u).when(i % 3 == 1, wrap(u, "l.a.com")).otherwise(wrap(wrap(u, "l.a.com"), "www.r.b.com"))
    paths = F.split(U.path(u), "/")
    found = F.when(i % 3 == 1, "other").when(i % 3 == 2, "shop")
    # the two-letter language comes off, so the second segment decides
    search = U.is_search_page(F.regexp_replace(u, r"/([123])(\.html)?/?([?#].*)?$", "/search$3"))
    moved = F.when(i % 2 == 0, F.lit("https://elsewhere.org/x")).otherwise(F.concat(F.lit("http://other."), U.domain(u), F.lit("/y")))
    return table(spark, d, "pages").select("page_id", F.get(paths, F.lit(1)).alias("lang"), U.kind_and_slug(F.concat(F.regexp_replace(u, r"://([^/]+)/([a-z]{2})/", "://$1/de/$2/")))["slug"].alias("slug"), search.alias("searched"), U.unwrap(wrapped, ("l.a.com", "r.b.com")).alias("target"), U.left_site(u, moved).alias("left_site"), U.reclassify(F.lit("old"), found).alias("kind"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || ' x' WHEN 1 THEN '' WHEN 2 THEN url || url WHEN 3 THEN 'ftp://a.b/c' ELSE url END AS u FROM pages)
SELECT page_id, array_to_string(list_filter([CASE WHEN u = '' THEN 'empty' END, CASE WHEN regexp_matches(u, '\s') THEN 'white space' END, CASE WHEN page_id % 5 = 2 THEN 'several' END,
CASE WHEN page_id % 5 IN (1, 3) THEN 'no host' END, CASE WHEN u LIKE 'http:%' THEN 'http' END, CASE WHEN u LIKE 'ftp:%' THEN 'protocol' END], lambda x: x IS NOT NULL), ',') AS issues FROM p""")
def link_issues(spark, d):
    i, u = F.col("page_id") % 5, F.col("url")
    given = F.when(i == 0, F.concat(u, F.lit(" x"))).when(i == 1, "").when(i == 2, F.concat(u, u)).when(i == 3, "ftp://a.b/c").otherwise(u)
    return table(spark, d, "pages").select("page_id", F.array_join(U.issues(given), ",").alias("issues"))


@query(r"""WITH s AS (SELECT page_id, page_id % 7 AS platform, lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://(www\.)?', '', 'i'), '[?#].*$', ''), '/+$', '')) AS u, lower(regexp_extract(url, '^[^:]+://[^/]+/[^/]+/([0-9]+)', 1)) AS h FROM pages),
k AS (SELECT page_id, platform || '|url|' || u AS key FROM s UNION ALL SELECT page_id, platform || '|handle|' || h FROM s WHERE h <> '')
SELECT page_id, count(DISTINCT other) AS same FROM (SELECT x.page_id, y.page_id AS other FROM k x JOIN k y ON x.key = y.key AND x.page_id <> y.page_id) GROUP BY page_id""")
def submission_duplicates(spark, d):
    """How many other submissions share a key with each one."""
    p = table(spark, d, "pages")
    profile = F.regexp_extract("url", "^[^:]+://[^/]+/[^/]+/([0-9]+)", 1)
    keys = U.link_keys(F.col("url"), (F.col("page_id") % 7).cast("string"), F.when(profile != "", profile))
    of = p.select("page_id", keys.alias("keys")).select("page_id", F.get("keys", F.lit(0)).alias("k1"), F.get("keys", F.lit(1)).alias("k2"))
    return matching.sharing(of, "page_id", "k1", "k2").where("same > 0")


_BIO = r"""b AS (SELECT c_custkey AS id, c_nationkey AS n, c_name AS name FROM customer)"""


@query(rf"""WITH {_BIO} SELECT id, name || ' here' AS plain, 'agent ' || id || CASE WHEN n % 2 = 0 THEN ' second line' ELSE '' END AS booking, 'm' || n || '@x.org' AS management, CAST(NULL AS VARCHAR) AS contact,
'About ' || name || chr(10) || 'see' || chr(10) || 'end' AS unlabelled, n % 3 = 0 AS generic, 'https://lnk.example/' || id || ';http://b.c/' || n AS urls, '00000000-0000-4000-8000-' || lpad(CAST(id AS VARCHAR), 12, '0') AS uuid,
'https://x.org/s?q=' || n || '%20' || id AS filled, '<p>' || '@<a href="https://lnk.example/' || id || '">x</a></p>' AS marked, n AS counted FROM b""")
def bio_fields(spark, d):
    """Biographies made of a customer's fields: markup off, contact lines, label lines, generic texts, links, ids and templates."""
    i, n, name = F.col("c_custkey").cast("string"), F.col("c_nationkey"), F.col("c_name")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = cat("Booking: agent ", i, F.when(n % 2 == 0, "\n second line ").otherwise(""), "\n\nManagement:\nm", n.cast("string"), "@x.org\nPress: none\nlater")
    labelled = cat("About ", name, "\nLinks:\nsee https://lnk.example/", i, "\nend")
    generic = F.when(n % 3 == 0, cat("Stream ", name, " for free")).otherwise(cat("I stream ", name))
    anchors = cat('<p><a href="https://lnk.example/', i, '">x</a></p>')
    c = X.contacts(said)
    return table(spark, d, "customer").select(
        i.cast("long").alias("id"), X.strip_markup(cat("[a=", name, "] [url=http://z]here[/url][b][/b]")).alias("plain"), c["booking"].alias("booking"), c["management"].alias("management"), c["contact"].alias("contact"),
        F.regexp_replace(X.without_label_lines(labelled, r"lnk\.example"), " +\n", "\n").alias("unlabelled"), X.is_generic(generic).alias("generic"), F.array_join(U.in_text(cat("(https://lnk.example/", i, "), http://b.c/", n.cast("string"), ".")), ";").alias("urls"),
        X.first_uuid(cat("id 00000000-0000-4000-8000-", F.lpad(i, 12, "0"), " x")).alias("uuid"), X.fill_template(F.lit("https://x.org/s?q={query}"), cat(n.cast("string"), " ", i)).alias("filled"),
        X.add_at(X.add_at(anchors, "https://lnk"), "https://lnk").alias("marked"), X.count_word(F.repeat(F.lit("Word words, "), n), "word").cast("int").alias("counted"),
    )


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'empty tag' ELSE 'no tag' END AS status, CASE WHEN page_id % 4 = 0 THEN 'http://i/' || page_id || '.jpg' END AS image,
CAST(page_id AS VARCHAR) AS buried, 'http://i/a.jpg' AS unsized, page_id % 2 = 0 AS linked, len(regexp_extract_all(html, '(?i)<p>', 0)) AS paragraphs FROM pages""")
def page_fields(spark, d):
    """Share images by how the search ended, a value deep within embedded JSON, size suffixes, links set in text and what a sanitiser leaves."""
    i, h = F.col("page_id"), F.col("html")
    url = F.when(i % 4 == 0, F.concat(F.lit("http://i/"), i.cast("string"), F.lit(".jpg"))).when(i % 4 == 1, "http://i/default.png").when(i % 4 == 2, "")
    tag = F.when(url.isNull(), "").when(i % 8 < 4, F.concat(F.lit('<meta property="og:image" content="'), url, F.lit('">'))).otherwise(F.concat(F.lit('<meta content="'), url, F.lit('" name="twitter:image">')))
    script = F.concat(F.lit('<script id="__DATA__" type="x">{"a": [{"b": {"id_": '), i.cast("string"), F.lit("}}]}</script>"))
    page = F.concat(tag, script, h)
    image = H.page_image(page)
    linked = H.linkify(F.when(i % 2 == 0, "see https://a.b/c.").otherwise("see nothing"))
    clean = H.sanitise(h)
    pages = table(spark, d, "pages")
    found = json_tree.first_values(pages.select("page_id", H.embedded_json(page, "__DATA__").alias("text")), "page_id", "text", "id_").select("page_id", F.col("value").alias("buried"))
    return pages.join(found, "page_id", "left").select("page_id", image["status"].alias("status"), image["url"].alias("image"), "buried", U.without_size(F.lit("http://i/a-300x200.jpg")).alias("unsized"), linked.contains('<a href="https://a.b/c" target').alias("linked"), F.regexp_count(clean, F.lit("(?i)<p>")).cast("long").alias("paragraphs"))


@query(r"""WITH e AS (SELECT event_id, ts, user_id, event_type, date_trunc('second', ts) AS s FROM events)
SELECT event_id, s AS at, CASE WHEN user_id % 2 = 0 THEN event_type END AS name, '{"user":"' || user_id || '"}' AS rest, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n_tags, event_id % 100 AS post_id, date_trunc('minute', s) AS started FROM e""")
def json_records(spark, d):
    """Posts as JSON with lists that may be missing, blanks as nulls, what is left of an object, and start arguments."""
    said = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    tags = F.when(F.col("event_id") % 3 == 0, "").otherwise(',"tags":[1,2]')
    post = F.concat(F.lit('{"id":'), (F.col("event_id") % 100).cast("string"), F.lit(',"date":"'), said, F.lit('"'), tags, F.lit("}"))
    record = T.post_record(post)
    whole = F.concat(F.lit('{"id":"1","user":"'), F.col("user_id").cast("string"), F.lit('","x":"2"}'))
    name = T.blank_to_null(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("  "), "event_type")).otherwise("   "))
    return table(spark, d, "events").select("event_id", record["post_date"].alias("at"), name.alias("name"), T.rest_of_object(whole, ("id", "x")).alias("rest"), F.size(record["tag_ids"]).alias("n_tags"), record["post_id"].alias("post_id"), T.start_argument(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("started"))


@query("""WITH i AS (SELECT o_custkey AS id, list(struct_pack(k := o_orderkey, s := o_orderstatus) ORDER BY o_orderkey) AS xs FROM orders GROUP BY 1)
SELECT id, coalesce(list_filter(xs, lambda x: x.s = 'P')[1].k, xs[1].k) AS first, len(list_distinct(list_transform(xs, lambda x: x.k % 3))) AS kinds,
CASE WHEN len(list_distinct(list_transform(xs, lambda x: x.k % 3))) = 1 THEN 'bind' ELSE 'ambiguous' END AS decision FROM i""")
def primary_items(spark, d):
    packed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("xs"))
    ids = F.transform("xs", lambda x: x["k"] % 3)
    return packed.select("id", S.primary_or_first(F.col("xs"), "s", "P")["k"].alias("first"), F.size(F.array_distinct(ids)).cast("long").alias("kinds"), matching.decide(ids).alias("decision"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS name, p_type || chr(10) || '\"x\", y' AS note FROM part WHERE p_partkey % 11 > 0")
def csv_round_trip(spark, d):
    """Parts written as CSV with quotes, commas and line ends in cells, and read back."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, d, "part").where("p_partkey % 11 > 0").select(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("name"), F.concat("p_type", F.lit('\n"x", y')).alias("note"))
    tabular.write_csv(rows, path)
    back = tabular.read_csv(spark, path, rows.columns)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), T.blank_to_null(F.col("name")).alias("name"), "note")


@query("SELECT n_nationkey, n_name || ' <' || n_regionkey || '>' || chr(10) || 'two' AS name FROM nation")
def ods_round_trip(spark, d):
    """Nations written as spreadsheets, a file for each partition, and read back."""
    ods.register(spark)
    path = f"{scratch(spark)}/ods-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(" <"), F.col("n_regionkey").cast("string"), F.lit(">\ntwo")).alias("name"))
    rows.repartition(2).write.format("ods").option("path", path).mode("append").save()
    return ods.read_ods(spark, path, ["n_nationkey", "name"]).select(F.col("n_nationkey").cast(rows.schema["n_nationkey"].dataType).alias("n_nationkey"), "name")


@query("""WITH w AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT k AS p_partkey, CASE WHEN k IN (SELECT p_partkey FROM part WHERE p_size < 25) THEN 'cached' ELSE 'new' END AS way FROM w UNION ALL SELECT * FROM (SELECT p_partkey, 'page' FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 100)
UNION ALL SELECT p_partkey, 'listed' FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1)""")
def cached_scans(spark, d):
    """Requests split by a cache, one page of a keyset scan, and the rows of listed ids."""
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    hit, lack = tabular.cached_or_new(lines.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), part.where("p_size < 25").select("p_partkey"), ["p_partkey"])
    paged = tabular.after(part.select("p_partkey"), "p_partkey", 50, 100)
    listed = tabular.by_ids(part.select("p_partkey"), lines.where("l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")
    of = lambda f, way: f.select("p_partkey", F.lit(way).alias("way"))
    return of(hit, "cached").unionByName(of(lack, "new")).unionByName(of(paged, "page")).unionByName(of(listed, "listed"))


@query("""SELECT 'kept' AS frame, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'quarantined', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'tag', count(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) UNION ALL SELECT 'p_partkey_tag', count(*) FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) FROM part)
UNION ALL SELECT 'written', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min((o_orderstatus <> 'P')::INT) = 1)""")
def load_counts(spark, d):
    """Valid and quarantined rows, a bulk load's dimension and junction, and units of which every write succeeded."""
    good, bad = tabular.split_valid(table(spark, d, "customer"), F.col("c_acctbal") >= 0)
    loaded = tabular.bulk_load(table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("; ")).alias("tags")), "p_partkey", {"tags": "tag"})
    done = incremental.all_written(table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") != "P").alias("ok")), "o_custkey", "ok")
    frames = {"kept": good, "quarantined": bad, "tag": loaded["tag"], "p_partkey_tag": loaded["p_partkey_tag"], "written": done}
    counts = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n") for name, f in frames.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(r"""SELECT page_id, regexp_replace(url, '^http:', 'https:') AS url, CASE WHEN page_id % 4 = 0 THEN 'first' WHEN url LIKE 'http:%' THEN url END AS original FROM pages""")
def original_links(spark, d):
    """A link's change keeps the first value it ever had."""
    held = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, "first").alias("original"))
    return reconcile.remember_original(held, "url", "original", U.upgrade_https(F.col("url")))


@query("""WITH f AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id FROM f WHERE r = 1""")
def stream_upserts(spark, d):
    """The latest event of each user and type, kept as a table that a stream's batches merge into."""
    folder = f"{scratch(spark)}/upserts-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    rows = source.select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    upsert_batches(rows, ["user_id", "event_type"], "at", f"{folder}/table", f"{folder}/state").awaitTermination()
    return upserted(spark, f"{folder}/table", rows.schema).select("user_id", "event_type", "event_id")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, event_id FROM events) GROUP BY 1")
def stream_first_events(spark, d):
    """Events that come twice count once within the watermark."""
    folder = f"{scratch(spark)}/first-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    doubled = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    dedupe(doubled, "event_id", "ts", "40 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT r_regionkey * 5 + 1 AS n FROM region UNION SELECT unnest([n * 2, n * 3]) FROM r WHERE n < 2000) SELECT CAST(n AS BIGINT) AS n FROM r""")
def stable_rounds(spark, d):
    """A step that adds rows, again and again until it adds none."""
    step = lambda df: df.unionByName(df.where("n < 2000").select(F.explode(F.array(F.col("n") * 2, F.col("n") * 3)).alias("n"))).distinct()
    state, _, stable = graph.until_stable(table(spark, d, "region").select((F.col("r_regionkey") * 5 + 1).cast("long").alias("n")), step)
    return state.where(F.lit(stable))
