"""Page cards, link rules, natural order, credits, promotions, migrations, reports and audits on analogues of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import curation as C
from tessera.operators.relational import many_to_many, numbered
from tessera.operators.stages import run_stages
from tessera.plans.match import _R4
from tessera.plans.registry import query, table
from tessera.sources import providers
from tessera.storage import fresh, scratch


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_RULES = {
    "shop": U.LinkRule(whole=("/search",), number=True),
    "video": U.LinkRule(whole=("/results",), params=(("/watch", ("v", "t")),), profiles=(("^@.", 1), ("(?i)^(channel|c|user)$", 2))),
}


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS k, 'https://www.Shop.com' AS h FROM part)
SELECT id, CASE k WHEN 0 THEN 'https://www.shop.com/artist/x/' || id WHEN 1 THEN h || '/search/a?q=' || id || '&y=1' WHEN 2 THEN h || '/artist/x' WHEN 3 THEN 'www.video.com/watch?v=' || id || '&t=3' WHEN 4 THEN 'video.com/@n' || id
WHEN 5 THEN 'https://m.video.com/channel/' || id WHEN 6 THEN 'https://m.video.com/other/' || id || '/videos' ELSE 'https://a.b/c/' || id END AS clean FROM p""")
def link_cleaning(spark, d):
    """Links that people paste, wrapped now and then, with tabs, tracking and shares behind what counts."""
    i, k = F.col("p_partkey"), F.col("p_partkey") % 8
    given = (
        F.when(k == 0, _cat(" https://www.Shop.com/artist/x/", i, "/tracks/7?x=1 ")).when(k == 1, _cat("https://www.Shop.com/search/a?q=", i, "&y=1")).when(k == 2, "https://www.Shop.com/artist/x/?ref=2")
        .when(k == 3, _cat("www.video.com/watch?si=1&t=3&v=", i, "#top")).when(k == 4, _cat("video.com/@n", i, "/videos/all?view=0")).when(k == 5, _cat("https://m.video.com/channel/", i, "/about"))
        .when(k == 6, _cat("https://m.video.com/other/", i, "/videos?x=2")).otherwise(_cat("https://l.wrap.com/?u=", F.url_encode(_cat("https://a.b/c/", i, "/?x=2"))))
    )
    platform = F.when(k < 3, "shop").when(k < 7, "video").otherwise("other")
    return table(spark, d, "part").select(i.alias("id"), U.resolve_link(given, platform, ("l.wrap.com",), _RULES).alias("clean"))


@query(r"""SELECT page_id, 'Name & ' || page_id AS name, CASE WHEN page_id % 2 = 0 THEN page_id END AS number, 'https://i.x/' || page_id || '.jpg?a=1&b=2' AS portrait, 'https://s.x/' || page_id || ',http://t.x/a?b&c' AS links,
CASE WHEN page_id % 3 > 0 THEN 'Some place' END AS place, 'techno,deep house' AS tags, CASE WHEN page_id % 5 > 0 THEN 'https://f.x/p.png' END AS photo, 'A "bio" of ' || page_id AS bio FROM pages""")
def page_cards(spark, d):
    """Fields of a person's page around each page's own HTML: title, number of the body's class, portrait, links of two blocks, place, tags, photo near its mark, biography."""
    i = F.col("page_id")
    own = F.regexp_extract("html", r"(?is)<article>(.*?)</article>", 1)
    image = _cat("background-image: url('https://i.x/", i, ".jpg?a=1&amp;b=2')")
    portrait = F.when(i % 2 == 0, _cat('<div class="card portrait" data-x="1" style="', image, '"></div>')).otherwise(_cat('<div style="', image, '" class="portrait"></div>'))
    socials = _cat('<div class="elsewhere"><a href=""></a></div><div class="row elsewhere big"><a href="https://s.x/', i, '"></a><a href="http://t.x/a?b&amp;c"></a><a href="https://s.x/', i, '"></a></div>')
    page = _cat(
        '<html><body class="home person-', F.when(i % 2 == 0, i.cast("string")).otherwise("7seas"), ' x"><h1 class="called">\n Name <b>&amp;</b> ', i, "</h1>", portrait, socials, F.when(i % 3 > 0, '<span class="from">Some&nbsp; place</span>').otherwise(""),
        '<p id="about">A &quot;bio&quot;\n of ', i, '</p><a class="tag" href="/t">Techno</a><a class="tag">Deep <i>House</i></a><div id="snapshot">', F.when(i % 5 > 0, "").otherwise(F.repeat(F.lit(" "), 600)), '<a href="https://f.x/p.png"></a></div>', own, "</body></html>",
    )
    p = table(spark, d, "pages").select("page_id", page.alias("page"))
    c = F.col("page")
    return p.select(
        "page_id", H.by_attribute(c, "h1", "class", "called").alias("name"), H.body_number(c, "person").alias("number"), H.background_image(c, "portrait").alias("portrait"), F.array_join(H.links_within(c, "div", "class", "elsewhere"), ",").alias("links"),
        H.by_attribute(c, "[a-z]+", "class", "from").alias("place"), F.array_join(H.all_by_class(c, "a", "tag"), ",").alias("tags"), H.image_after(c, 'id="snapshot"').alias("photo"), H.by_attribute(c, "p", "id", "about").alias("bio"),
    )


@query(r"""WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE 'É' || p_type END || ' ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' Ab' END AS s FROM part),
k AS (SELECT id, list_transform(regexp_extract_all(replace(lower(strip_accents(s)), 'ø', 'o'), '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(CAST(length(x) AS VARCHAR), 6, '0') || x ELSE x END) AS k FROM n)
SELECT id, row_number() OVER (ORDER BY k, id) AS place FROM k""")
def natural_order(spark, d):
    """Places of names as people sort them."""
    i = F.col("p_partkey")
    name = F.when(i % 3 == 0, F.col("p_type")).when(i % 3 == 1, F.lower("p_type")).otherwise(_cat("É", F.col("p_type")))
    keyed = table(spark, d, "part").select(i.alias("id"), X.natural_key(_cat(name, " ", F.col("p_size"), F.when(i % 2 == 0, "").otherwise(" Ab"))).alias("k"))
    return numbered(keyed, ["k", "id"], "place").select("id", "place")


@query("""WITH l AS (SELECT l_orderkey AS release, l_suppkey AS id, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2),
p AS (SELECT release, id, CAST(row_number() OVER (PARTITION BY release ORDER BY line, id) - 1 AS INT) AS place FROM l)
SELECT release, place, CASE WHEN release % 3 > 0 THEN id END AS id, CASE WHEN release % 3 > 0 THEN 'S' || id ELSE 'nobody' END AS name FROM p WHERE release % 3 > 0 OR place = 0""")
def release_credits(spark, d):
    """Orders as releases: a third of them credit their lines' suppliers, a third are of various ones and credit those of their tracks, the others fall back."""
    kind = F.col("l_orderkey") % 3
    named = F.struct("l_linenumber", F.col("l_suppkey").cast("long").alias("id"), _cat(F.when(kind == 1, " S").otherwise("S"), F.col("l_suppkey"), " ").alias("name"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(named)).alias("x"))
    items = F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    none = F.array().cast("array<struct<id:long,name:string>>")
    various = F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit(" Various").alias("name")), F.struct(F.lit(7).cast("long").alias("id"), F.lit(" ").alias("name")))
    kind = F.col("release") % 3
    r = lines.select(F.col("l_orderkey").alias("release"), items.alias("items"))
    return C.credits(r.select("release", F.when(kind == 1, F.col("items")).when(kind == 2, various).otherwise(none).alias("artists"), F.when(kind == 2, F.col("items")).otherwise(none).alias("tracks"), F.lit(" nobody").alias("fallback")))


@query("""SELECT '{' || concat_ws(',', '"status":"' || o_orderstatus || '"', CASE WHEN o_orderkey % 5 > 0 THEN '"level":' || CASE WHEN o_orderkey % 5 = 1 THEN 'null' ELSE left(o_orderpriority, 1) END END) || '}' AS patch,
count(*) AS ids, sum(o_orderkey)::BIGINT AS total, true AS small FROM orders GROUP BY 1""")
def patch_batches(spark, d):
    """Orders that take the same patch, in batches; a fifth set their level to null, a fifth leave it alone."""
    k = F.col("o_orderkey") % 5
    level = F.when(k > 1, F.left("o_orderpriority", F.lit(1)).cast("int"))
    p = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), level.alias("level"), F.when(k == 0, F.array(F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("level"))).alias("sets"))
    g = C.patch_groups(p, "o_orderkey", sets="sets")
    each = g.select("patch", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return each.groupBy("patch").agg(F.sum("n").alias("ids"), F.sum("s").alias("total"), (F.max("n") < 1000).alias("small"))


_FOUND = "c AS (SELECT user_id AS entity, event_type AS service, event_id AS id, value AS confidence, CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS status FROM events), l AS (SELECT user_id AS entity, event_type AS service, min(event_id) AS id FROM events WHERE user_id % 2 = 0 GROUP BY ALL)"


@query(f"""WITH {_FOUND}, b AS (SELECT * FROM c WHERE status = 'approved' QUALIFY row_number() OVER (PARTITION BY entity, service ORDER BY confidence DESC, id) = 1)
SELECT CASE WHEN l.id IS NULL THEN 'insert' WHEN l.id = b.id THEN 'already' ELSE 'update' END AS action, CAST(b.id AS VARCHAR) AS id, 'r1' AS run FROM b LEFT JOIN l USING (entity, service)""")
def promoted_links(spark, d):
    """Which approved candidates go into the table of links, as one audit frame."""
    e = table(spark, d, "events")
    found = e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("service"), F.col("event_id").alias("id"), F.col("value").alias("confidence"), F.when(F.col("event_id") % 3 == 0, "approved").otherwise("pending").alias("status"))
    held = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("service")).agg(F.min("event_id").alias("id"))
    out = C.promote(found, held)
    out.pop("stats")
    return C.audit(out, "id", "r1")


@query("""WITH p AS (SELECT event_id AS n, user_id * 3 AS source, CAST(floor(value) AS BIGINT) AS target FROM events), e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN 'duplicate' ELSE 'open' END AS status, c_custkey % 7 = 0 AS deleted FROM customer),
u AS (SELECT c_custkey AS id, c_mktsegment AS url FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 3 = 0),
j AS (SELECT p.*, s.id IS NOT NULL AS s_there, s.status AS s_status, t.id IS NOT NULL AS t_there, t.deleted AS t_deleted, us.url AS s_url, ut.url AS t_url, row_number() OVER (PARTITION BY source, target ORDER BY n) > 1 AS again FROM p LEFT JOIN e s ON s.id = source LEFT JOIN e t ON t.id = target LEFT JOIN u us ON us.id = source LEFT JOIN u ut ON ut.id = target),
b AS (SELECT *, CASE WHEN again THEN 'repeated pair' WHEN source = target THEN 'same entity' WHEN NOT t_there THEN 'no target' WHEN t_deleted THEN 'target deleted' WHEN NOT s_there THEN 'no source' WHEN s_status <> 'duplicate' THEN 'source is no duplicate' WHEN s_url IS NULL THEN 'no link to copy' END AS barred FROM j),
f AS (SELECT target, n, s_url FROM b WHERE barred IS NULL AND t_url IS NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY n) = 1)
SELECT b.n AS row, source, b.target, CASE WHEN barred IS NULL THEN b.s_url END AS url, CASE WHEN barred IS NOT NULL THEN 'skipped' WHEN t_url IS NULL AND b.n = f.n THEN 'copy' WHEN coalesce(t_url, f.s_url) = b.s_url THEN 'skipped' ELSE 'conflict' END AS action,
CASE WHEN barred IS NOT NULL THEN barred WHEN t_url IS NULL AND b.n = f.n THEN NULL WHEN coalesce(t_url, f.s_url) = b.s_url THEN 'already there' ELSE 'another link' END AS note FROM b LEFT JOIN f ON f.target = b.target""")
def link_migration(spark, d):
    """The links of duplicates move to who survives, with an action for each pair."""
    e, c, k = table(spark, d, "events"), table(spark, d, "customer"), F.col("c_custkey")
    pairs = e.select(F.col("event_id").alias("row"), (F.col("user_id") * 3).alias("source"), F.floor("value").cast("long").alias("target"))
    entities = c.select(k.alias("id"), F.when(k % 4 > 0, "duplicate").otherwise("open").alias("status"), (k % 7 == 0).alias("deleted"))
    return C.migrate_links(pairs, entities, c.where("c_custkey % 5 > 0 and c_custkey % 3 = 0").select(k.alias("id"), F.col("c_mktsegment").alias("url")))


@query("""WITH d AS (SELECT user_id * 5 AS id, event_type AS action, event_type AS value FROM events WHERE value > 70), a AS (SELECT id, count(DISTINCT action) AS n, min(action) AS one FROM d GROUP BY 1), c AS (SELECT c_custkey AS id, (['view', 'click'])[1 + c_custkey % 2] AS value FROM customer)
SELECT id, CASE WHEN n = 1 THEN one END AS action, CASE WHEN n = 1 THEN one END AS value, CASE WHEN n > 1 THEN 'contradicted' WHEN c.value IS NULL THEN 'unknown' WHEN c.value = one THEN 'satisfied' ELSE 'apply' END AS state FROM a LEFT JOIN c USING (id)""")
def decision_states(spark, d):
    answers = table(spark, d, "events").where("value > 70").select((F.col("user_id") * 5).alias("id"), F.col("event_type").alias("action"), F.col("event_type").alias("value"))
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.get(F.array(F.lit("view"), F.lit("click")), (F.col("c_custkey") % 2).cast("int")).alias("value"))
    return C.apply_decisions(answers, current)


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name FROM part), l AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size = 7)
SELECT id, name, coalesce(l.n, 0) AS links, coalesce(s.n, 0) AS staged, CASE WHEN name = 'red bolt' THEN 'red screw' END AS merge_into, name = 'blue gear' AS broad,
CASE WHEN name LIKE 'hot %' THEN 'mood' WHEN c.name IS NOT NULL THEN 'entity name' ELSE '' END AS reason FROM t LEFT JOIN l USING (id) LEFT JOIN s USING (id) LEFT JOIN c USING (name)""")
def term_reports(spark, d):
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    reason = X.tag_reason(F.col("name"), {"colour": ("puce",)}, {"mood": "^hot "})
    return C.term_report(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), lines.select(F.col("l_partkey").alias("term")), lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("term")), part.where("p_size = 7").select(F.col("p_name").alias("name")), {"red bolt": "red screw", "blue gear": "gear"}, ("blue gear",), reason, X.words_key(F.col("name")))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 > 0 THEN 'Plays "' || c_name || '" & more' || chr(10) || chr(10) || 'Booking: b' || c_custkey || '@x.org' END AS bio, CASE WHEN c_nationkey % 4 > 0 THEN 'https://tree.example/' || c_custkey END AS link, CASE WHEN c_nationkey % 4 > 0 THEN 'b' || c_custkey || '@x.org' END AS booking FROM customer""")
def biographies(spark, d):
    i, generic = F.col("c_custkey"), F.col("c_nationkey") % 4 == 0
    raw = F.when(generic, _cat("Listen to ", F.col("c_name"), " on mobile")).otherwise(_cat("Plays &quot;", F.col("c_name"), "&quot; &amp; more\n\nLinks:\nhttps://tree.example/", i, "\nBooking: b", i, "@x.org"))
    b = X.biography(raw, r"tree\.example/")
    bio = F.regexp_replace(b["bio"], r"\n+Booking", "\n\nBooking")
    return table(spark, d, "customer").select(i.alias("id"), bio.alias("bio"), b["link"].alias("link"), b["contacts"]["booking"].alias("booking"))


@query("""WITH q AS (SELECT p_partkey AS q, p_name AS text FROM part WHERE p_size = 1) SELECT 'parts' AS provider, q, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM q JOIN part ON p_name = text UNION ALL SELECT 'brands', q, p_brand, min(p_name) FROM q JOIN part ON p_name = text GROUP BY q, p_brand""")
def provider_answers(spark, d):
    """Two providers asked for the same names."""
    part = table(spark, d, "part")
    by_part = lambda r: many_to_many(part.select("p_name", F.col("p_partkey").cast("string").alias("id")), r.select(F.col("text").alias("p_name"), "q"), "p_name", "q").select("q", "id", F.col("p_name").alias("name"))
    brands = part.groupBy("p_name", F.col("p_brand").alias("id")).agg(F.first("p_name").alias("name"))
    by_brand = lambda r: r.join(brands, brands["p_name"] == r["text"]).groupBy("q", "id").agg(F.min("name").alias("name"))
    return providers.ask(part.where("p_size = 1").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("text")), ["parts", "brands"], {"parts": by_part, "brands": by_brand})


@query("SELECT 0 AS place, 'options' AS stage, 'done' AS state, (SELECT count(DISTINCT p_brand) FROM part) AS n UNION ALL SELECT 1, 'broken', 'failed', NULL UNION ALL SELECT 2, 'again', 'done', (SELECT count(DISTINCT p_brand) FROM part) UNION ALL SELECT 3, 'strict', 'failed', NULL UNION ALL SELECT 4, 'late', 'not run', NULL")
def staged_run(spark, d):
    """Stages around a cache of ten minutes: made, taken again though its source has gone, failures that may and may not end the run."""
    path = f"{scratch(spark)}/options-{uuid.uuid4().hex}"
    options = lambda d=d: fresh(spark, path, 600, lambda: table(spark, d, "part").select("p_brand").distinct())
    lost = lambda: table(spark, f"{d}/none", "part")
    frames, told = run_stages(spark, [("options", options, False), ("broken", lost, True), ("again", lambda: options("/none"), False), ("strict", lost, False), ("late", options, False)])
    sizes = spark.createDataFrame([(name, f.count()) for name, f in frames.items()], "stage string, n long")
    return told.join(sizes, "stage", "left").select("place", "stage", "state", "n")


_SETS = "s AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON x.p_size = y.p_size AND x.p_brand = y.p_brand AND x.p_name < y.p_name))"


@query(f"""WITH {_SETS}, r AS (SELECT a, b, len(list_intersect(x, y)) AS n, coalesce(list_aggregate(list_sort(list_intersect(x, y)), 'string_agg', ' '), '') AS sh, list_filter(x, lambda e: NOT list_contains(y, e)) AS l, list_filter(y, lambda e: NOT list_contains(x, e)) AS m, len(x) + len(y) AS t FROM s),
j AS (SELECT *, trim(sh || ' ' || coalesce(list_aggregate(list_sort(l), 'string_agg', ' '), '')) AS p, trim(sh || ' ' || coalesce(list_aggregate(list_sort(m), 'string_agg', ' '), '')) AS q FROM r)
SELECT a, b, {_R4.format("2 * n / t * greatest(1 - levenshtein(sh, p) / length(p), 1 - levenshtein(sh, q) / length(q), 1 - levenshtein(p, q) / greatest(length(p), length(q))) + 1e-9")} AS name_score, {_R4.format("n / least(t - 2, 2)")} AS place_score FROM j""")
def name_place_scores(spark, d):
    """Scores of names and places that meet under a brand and size."""
    p = table(spark, d, "part")
    side = lambda x: p.select("p_size", "p_brand", F.col("p_name").alias(x))
    pairs = side("a").join(side("b"), ["p_size", "p_brand"]).where("a < b").select("a", "b").distinct()
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", X.round4(X.name_or_set_score(a, b) + 1e-9).alias("name_score"), X.round4(S.location_score(a, b)).alias("place_score"))
