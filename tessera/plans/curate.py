"""Composite curation on analogues of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.functions import times as T
from tessera.functions import urls as U
from tessera.operators import curation as C
from tessera.operators.relational import orphans
from tessera.plans.registry import query, table

_R4 = "floor(({}) * 10000 + 0.5) / 10000"
_STAGED = "staged AS (SELECT event_id AS id, user_id AS owner, event_type AS platform, 'u' || CAST(floor(value / 4) AS BIGINT) AS url, ts AS seen FROM events WHERE event_id % 3 > 0)"
_LIVE = "live AS (SELECT user_id AS owner, event_type AS platform, 'u' || CAST(floor(max(value) / 4) AS BIGINT) AS url, min(event_id) % 2 = 0 AS not_found FROM events WHERE event_id % 3 = 0 AND user_id % 4 = 0 GROUP BY ALL)"


def _link(v):
    return F.concat(F.lit("u"), F.floor(v / 4).cast("string"))


@query(f"""WITH {_STAGED}, {_LIVE}, e AS (SELECT *, row_number() OVER (PARTITION BY owner, platform, url ORDER BY seen, id) AS r FROM staged), f AS (SELECT * FROM e WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY owner, platform ORDER BY seen, id) = 1),
m AS (SELECT f.*, l.url AS live_url, l.not_found FROM f LEFT JOIN live l USING (owner, platform))
SELECT 'repeats' AS frame, id FROM e WHERE r > 1 UNION ALL SELECT 'later', id FROM e WHERE r = 1 AND id NOT IN (SELECT id FROM f) UNION ALL SELECT 'insert', id FROM m WHERE not_found IS NULL
UNION ALL SELECT 'not_found', id FROM m WHERE not_found UNION ALL SELECT 'mismatch', id FROM m WHERE NOT not_found AND url <> live_url""")
def link_integration(spark, d):
    e = table(spark, d, "events")
    staged = e.where("event_id % 3 > 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("event_type").alias("platform"), _link(F.col("value")).alias("url"), F.col("ts").alias("at"))
    live = e.where("event_id % 3 = 0 and user_id % 4 = 0").groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("platform")).agg(_link(F.max("value")).alias("url"), (F.min("event_id") % 2 == 0).alias("not_found"))
    parts = [f.select(F.lit(name).alias("frame"), "id") for name, f in C.integrate_links(staged, live).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH r AS (SELECT event_id AS id, user_id AS owner, event_type AS platform, 'u' || event_id AS url, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'new' WHEN event_id % 11 = 0 THEN 'odd' ELSE event_type END AS new_platform,
CASE WHEN event_id % 4 = 0 THEN 'v' || event_id ELSE 'u' || event_id END AS new_url FROM events), h AS (SELECT owner, platform AS new_platform, url AS held_url, id AS held_by FROM r QUALIFY row_number() OVER (PARTITION BY owner, platform ORDER BY id) = 1),
j AS (SELECT r.*, held_url, held_by, r.new_platform <> r.platform OR r.new_url <> r.url AS moves, coalesce(held_by <> id, false) AS taken, row_number() OVER (PARTITION BY owner, r.new_platform ORDER BY CASE WHEN r.new_platform <> r.platform OR r.new_url <> r.url THEN 1 ELSE 0 END, id) AS claim FROM r LEFT JOIN h USING (owner, new_platform))
SELECT id, CASE WHEN NOT moves THEN 'unchanged' WHEN new_platform = 'odd' THEN 'unknown-platform' WHEN taken AND held_url = new_url THEN 'duplicate' WHEN taken OR claim > 1 THEN 'collision' ELSE 'updated' END AS decision FROM j""")
def link_decisions(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    own = F.concat(F.lit("u"), i.cast("string"))
    place = F.when(i % 5 == 0, "error").when(i % 7 == 0, "new").when(i % 11 == 0, "odd").otherwise(F.col("event_type"))
    rows = e.select(i.alias("id"), F.col("user_id").alias("owner"), F.col("event_type").alias("platform"), own.alias("url"), place.alias("new_platform"), F.when(i % 4 == 0, F.concat(F.lit("v"), i.cast("string"))).otherwise(own).alias("new_url"))
    known = spark.createDataFrame([(k,) for k in ("click", "error", "new", "purchase", "signup", "view")], "key string")
    return C.decide_links(rows, known).select("id", "decision")


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_name AS key FROM part), u AS (SELECT l_partkey AS id, count(*) AS links FROM lineitem GROUP BY 1),
w AS (SELECT id AS old, first(id) OVER (PARTITION BY key ORDER BY (name = key)::INT DESC, coalesce(links, 0) DESC, id) AS new FROM t LEFT JOIN u USING (id))
SELECT 'gone' AS frame, count(*) AS n FROM w WHERE old <> new UNION ALL SELECT 'links', count(*) FROM (SELECT DISTINCT l_orderkey, new FROM lineitem JOIN w ON old = l_partkey)""")
def term_merge(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    terms = table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("term"))
    out = C.merge_groups(terms, links, X.words_key(F.col("name")), X.words_key(F.col("name")))
    return out["gone"].agg(F.count("*").alias("n")).select(F.lit("gone").alias("frame"), "n").unionByName(out["links"].agg(F.count("*").alias("n")).select(F.lit("links").alias("frame"), "n"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment || '-' || CAST(floor(c_acctbal / 40) AS BIGINT) AS slug FROM customer), t AS (SELECT s_suppkey AS term, (['BUILDING', 'MACHINERY', 'HOUSEHOLD'])[1 + s_suppkey % 3] || '-' || CAST(floor(s_acctbal / 40) AS BIGINT) AS slug, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS bound FROM supplier),
x AS (SELECT slug, count(DISTINCT id) AS things, min(id) AS id FROM a GROUP BY 1), y AS (SELECT slug, count(*) AS terms FROM t GROUP BY 1),
s AS (SELECT term, id, CASE WHEN things IS NULL THEN 'unmatched' WHEN things > 1 OR terms > 1 THEN 'ambiguous' WHEN bound = id THEN 'already' WHEN bound IS NOT NULL THEN 'conflict' ELSE 'bind' END AS state FROM t LEFT JOIN x USING (slug) LEFT JOIN y USING (slug))
SELECT term, CASE WHEN state = 'bind' THEN id END AS id, state FROM s""")
def slug_bind(spark, d):
    things = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("-", "c_mktsegment", F.floor(F.col("c_acctbal") / 40).cast("string")).alias("slug"))
    kinds = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "HOUSEHOLD")))
    s = F.col("s_suppkey")
    terms = table(spark, d, "supplier").select(s.alias("term"), F.concat_ws("-", F.get(kinds, (s % 3).cast("int")), F.floor(F.col("s_acctbal") / 40).cast("string")).alias("slug"), F.when(s % 4 == 0, s).alias("bound"))
    return C.bind_by_slug(things, terms)


@query("SELECT user_id, count(DISTINCT event_type) AS actions FROM events WHERE value > 60 GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def decision_contradictions(spark, d):
    return C.contradictions(table(spark, d, "events").where("value > 60"), "user_id", "event_type")


@query(r"""WITH p AS (SELECT page_id, page_id % 5 AS owner, regexp_replace(url, '[0-9].*$', '') AS url FROM pages), c AS (SELECT *, regexp_replace(url, '://(www|m)\.', '://') AS bare FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY owner, bare ORDER BY page_id) AS r FROM c WHERE bare <> url)
SELECT page_id, bare AS "to", CASE WHEN r > 1 OR EXISTS (SELECT 1 FROM p WHERE p.owner = t.owner AND p.url = t.bare) THEN 'delete' ELSE 'rename' END AS action FROM t""")
def collision_safe_rename(spark, d):
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 5).alias("owner"), F.regexp_replace("url", "[0-9].*$", "").alias("url"))
    return C.rename_safely(p, "page_id", "owner", "url", F.regexp_replace("url", r"://(www|m)\.", "://"))


@query("""WITH l AS (SELECT user_id AS owner, event_type AS platform, max(event_id) AS url FROM events WHERE event_type <> 'error' GROUP BY ALL), i AS (SELECT user_id AS owner, event_type AS platform, max(event_id) AS source FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
f AS (SELECT user_id AS owner, event_type AS platform, max(event_id) AS failed, max(event_id) % 3 > 0 AS definitive FROM events WHERE user_id % 2 = 0 GROUP BY ALL),
a AS (SELECT owner, platform, url, source, failed, definitive FROM l FULL JOIN i USING (owner, platform) LEFT JOIN f USING (owner, platform))
SELECT owner, platform, CASE WHEN url IS NULL THEN 'orphan' WHEN source = url THEN 'skip' WHEN failed IS NOT DISTINCT FROM url AND definitive AND source IS NOT NULL THEN 'drop' WHEN failed IS NOT DISTINCT FROM url AND definitive THEN 'skip'
WHEN failed IS NOT DISTINCT FROM url AND NOT definitive THEN 'retry' ELSE 'fetch' END AS action FROM a""")
def image_work_list(spark, d):
    e = table(spark, d, "events")
    of = lambda f, name: f.groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("platform")).agg(F.max("event_id").alias(name))
    failures = of(e.where("user_id % 2 = 0"), "url").withColumn("definitive", F.col("url") % 3 > 0)
    return C.image_work(of(e.where("event_type <> 'error'"), "url"), of(e.where("event_id % 2 = 0"), "source"), failures)


@query("""WITH n AS (SELECT o_orderkey % 97 AS owner, l_suppkey AS ext FROM orders JOIN lineitem ON l_orderkey = o_orderkey), i AS (SELECT s_suppkey AS ext, s_suppkey AS id FROM supplier)
SELECT least(owner, id) AS a, greatest(owner, id) AS b, count(*) AS n FROM n JOIN i USING (ext) WHERE owner <> id GROUP BY ALL""")
def related_to_edges(spark, d):
    """Lines of odd number as members, the others as groups."""
    odd = F.col("l_linenumber") % 2 == 1
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(odd, F.col("l_suppkey"))).alias("members"), F.collect_list(F.when(~odd, F.col("l_suppkey"))).alias("groups"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 97).alias("owner"))
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("external"), F.col("s_suppkey").alias("id"))
    return C.related_edges(lines.join(own, "l_orderkey").select("owner", "members", "groups"), ids)


@query("""WITH f AS (SELECT p_brand AS owner, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, replace(p_name, ' ', '') AS key FROM part), k AS (SELECT DISTINCT p_brand AS owner, replace(p_name, ' ', '') AS key FROM part WHERE p_size = 7)
SELECT owner, min(name) AS name FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.owner = f.owner AND k.key = f.key) GROUP BY owner, key""")
def alias_picker(spark, d):
    p = table(spark, d, "part")
    found = p.select(F.col("p_brand").alias("owner"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    known = p.where("p_size = 7").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name")).distinct()
    return C.new_aliases(found, known, X.search_key(F.col("name")))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS k, c_mktsegment AS s FROM customer), a AS (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM supplier GROUP BY 1), b AS (SELECT (['BUILDING', 'MACHINERY'])[1 + s_suppkey % 2] AS s, min(s_suppkey) AS v FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v) AS s_suppkey FROM r LEFT JOIN a USING (k) LEFT JOIN b USING (s)""")
def two_key_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("k"), F.col("c_mktsegment").alias("s"))
    dim = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.get(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), (F.col("s_suppkey") % 2).cast("int")).alias("s"), "s_suppkey")
    return C.two_key_lookup(c, dim, "k", "s", "s_suppkey").select("c_custkey", "s_suppkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH') AND (lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) LIKE '%11%' OR c_mktsegment = 'MACHINERY')
ORDER BY c_name, c_custkey LIMIT 11 OFFSET 10""")
def directory_page(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_name").alias("name"), X.search_key(F.col("c_name")).alias("name_key"))
    aliases = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", F.lit("x11x").alias("alias_key"))
    tags = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("tag"))
    return C.search(c, "c_custkey", aliases, "11", {"c_nationkey": list(range(1, 10))}, (tags, "2-HIGH"), page=2, size=10).select("c_custkey", "c_name")


@query("""WITH h AS (SELECT s_suppkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h FROM (SELECT s_suppkey, s_suppkey || ':2024-05-01' AS k FROM supplier)),
p AS (SELECT l_suppkey AS s_suppkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS ps FROM lineitem GROUP BY 1) SELECT s_suppkey, CAST(h AS BIGINT) AS hash, ps[1 + CAST(h % len(ps) AS BIGINT)] AS picked FROM p JOIN h USING (s_suppkey)""")
def fnv_daily_pick(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sort_array(F.collect_set("l_partkey")).alias("ps"))
    key = F.concat_ws(":", F.col("s_suppkey").cast("string"), F.lit("2024-05-01"))
    return parts.select("s_suppkey", S.fnv1a(key).alias("hash"), S.pick_by_day(F.col("ps"), F.col("s_suppkey"), "2024-05-01").alias("picked"))


_STOP = "('the', 'and', 'for', 'with', 'from', 'that', 'this', 'of', 'a', 'an', 'in', 'on', 'at', 'to', 'by')"


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(replace(replace(replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'ø', 'o'), 'æ', 'ae'), 'œ', 'oe'), 'ł', 'l'), '([a-z0-9]{{4,}})', 1)), lambda x: x NOT IN {_STOP}) AS w FROM documents)
SELECT a.doc_id, {_R4.format("len(list_intersect(a.w, b.w)) / len(a.w)")} AS coverage FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 WHERE len(a.w) > 0""")
def bio_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    out = docs.join(nxt, "doc_id").select("doc_id", X.round4(S.text_coverage(F.col("text"), F.col("other"))).alias("coverage"))
    return out.where("coverage is not null")


@query(f"""SELECT c_custkey, {_R4.format('''CASE WHEN c_acctbal < -500 THEN 1.0 WHEN c_acctbal / 100 >= 80 AND c_custkey % 200 < 100 THEN 0.5 ELSE greatest(1 - greatest(0, c_acctbal / 100 - 70) / 100, 0.3) END''')} AS score FROM customer""")
def popularity_scores(spark, d):
    pop = F.when(F.col("c_acctbal") >= -500, F.col("c_acctbal") / 100)
    return table(spark, d, "customer").select("c_custkey", X.round4(S.popularity_score(pop, F.col("c_custkey") % 200)).alias("score"))


@query(f"SELECT l_suppkey, count(*) AS n, {_R4.format('least(avg(l_quantity / 25), 1.0)')} AS quantity, {_R4.format('least(avg(l_discount / 0.2), 1.0)')} AS discount FROM lineitem GROUP BY 1")
def feature_means(spark, d):
    means = S.mean_features({"quantity": ("l_quantity", 25), "discount": ("l_discount", 0.2)})
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), *[X.round4(c).alias(n) for n, c in means.items()])


@query("SELECT o_custkey, list_aggregate(list_transform(list(struct_pack(p := o_totalprice, k := o_orderkey) ORDER BY o_totalprice DESC, o_orderkey)[1:3], lambda x: CAST(x.k AS VARCHAR)), 'string_agg', ',') AS top FROM orders GROUP BY 1")
def nested_top_three(spark, d):
    packed = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("orders"))
    return packed.select("o_custkey", F.array_join(F.transform(S.largest(F.col("orders"), "o_totalprice", 3), lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))


@query("SELECT event_id, ts AS at, ts - INTERVAL 7 DAYS AS rewound, ts + INTERVAL 48 HOURS AS expires FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def naive_timestamps(spark, d):
    said = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    e = table(spark, d, "events").select("event_id", T.naive(said).alias("at"))
    return e.select("event_id", "at", T.rewind(F.col("at"), 7).alias("rewound"), T.expires(F.col("at")).alias("expires"))


@query("""SELECT event_type, user_id, event_id, coalesce(c_name, '(unknown)') AS name FROM events LEFT JOIN customer ON c_custkey = user_id * 11 WHERE event_type = 'error'""")
def failure_report(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("k", F.col("user_id") * 11)
    return e.join(names, "k", "left").select("event_type", "user_id", "event_id", F.coalesce("name", F.lit("(unknown)")).alias("name")).orderBy("event_type", F.desc("event_id"))


@query("SELECT event_id, user_id FROM events WHERE user_id * 13 NOT IN (SELECT c_custkey FROM customer)")
def orphan_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") * 13).alias("k"))
    return orphans(e, table(spark, d, "customer"), "k", "c_custkey").select("event_id", "user_id")


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h, url FROM pages), q AS (SELECT page_id, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS dom, h, url FROM h)
SELECT page_id, dom <> 'example.com' AS mismatched, CASE WHEN dom <> 'example.com' THEN 'foreign' END AS warning FROM q""")
def profile_links(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", U.mismatched(F.col("url"), F.lit("site"), {"site": ("example.com",)}).alias("mismatched"), U.profile_link(F.col("url"), "example.com")["warning"].alias("warning"))


_RESOLVED = """WITH p AS (SELECT p_name AS name, min(p_partkey) AS id, max(p_size) AS size, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS types FROM part GROUP BY 1),
t AS (SELECT *, split_part(name, ' ', 2) AS noun, list_distinct(string_split(name, ' ')) AS x, list_filter(list_distinct(string_split(lower(types), ' ')), lambda w: length(w) >= 2) AS place, list_filter(list_distinct(string_split(lower(types), ' ')), lambda w: length(w) >= 4) AS bio FROM p),
m AS (SELECT a.id AS q, b.id, a.name AS ours, b.name AS name, a.x, b.x AS y, list_intersect(a.x, b.x) AS i, a.place AS pa, b.place AS pb, a.bio AS ba, b.bio AS bb, length(a.types) AS n, b.size * 2 AS pop FROM t a JOIN t b USING (noun)),
s AS (SELECT *, coalesce(list_aggregate(list_sort(i), 'string_agg', ' '), '') AS sh, 2 * len(i) / (len(x) + len(y)) AS f1 FROM m),
w AS (SELECT *, trim(sh || ' ' || coalesce(list_aggregate(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), 'string_agg', ' '), '')) AS l, trim(sh || ' ' || coalesce(list_aggregate(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), 'string_agg', ' '), '')) AS r FROM s),
v AS (SELECT *, greatest((greatest(length(sh), length(l)) - levenshtein(sh, l)) / greatest(length(sh), length(l)), (greatest(length(sh), length(r)) - levenshtein(sh, r)) / greatest(length(sh), length(r)), (greatest(length(l), length(r)) - levenshtein(l, r)) / greatest(length(l), length(r))) * f1 AS s1,
len(list_intersect(pa, pb)) / least(len(pa), len(pb)) AS s2, len(list_intersect(ba, bb)) / len(ba) AS s3, CASE WHEN pop >= 80 AND n < 100 THEN 0.5 ELSE greatest(1 - greatest(0, pop - 70) / 100, 0.3) END::DOUBLE AS s4 FROM w),
c AS (SELECT q, id, ours, name, floor((0.6 * s1 + 0.15 * s2 + 0.15 * s3 + 0.1 * s4) / 1.0 * 10000 + 0.5) / 10000 AS score FROM v),
u AS (SELECT *, name = ours AS exact, length(name) AS len FROM c QUALIFY score = max(score) OVER (PARTITION BY q)),
k AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, sum(exact::INT) OVER (PARTITION BY q) AS exacts, min(len) OVER (PARTITION BY q) AS shortest FROM u),
z AS (SELECT *, count(*) FILTER (len = shortest) OVER (PARTITION BY q) AS shorts, row_number() OVER (PARTITION BY q ORDER BY exact DESC, len, id) AS r FROM k)
SELECT q, n AS tied, id AS chosen, score, CASE WHEN score < 0.95 THEN 'below' WHEN n = 1 THEN 'best' WHEN exacts = 1 THEN 'exact' WHEN exacts = 0 AND shorts = 1 THEN 'shortest' ELSE 'tie' END AS status FROM z WHERE r = 1"""


@query(_RESOLVED)
def candidate_resolution(spark, d):
    part = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.max("p_size").alias("size"), F.array_join(F.sort_array(F.collect_set("p_type")), " ").alias("types"))
    asked = part.select(F.col("id").alias("q"), F.col("p_name").alias("name"), F.col("types").alias("place"), F.col("types").alias("bio"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    found = part.select("id", F.col("p_name").alias("c_name"), F.col("types").alias("c_place"), F.col("types").alias("c_bio"), (F.col("size") * 2).alias("popularity"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    candidates = asked.select("q", "noun").join(found, "noun").drop("noun")
    _, decided = C.resolve_candidates(asked.drop("noun"), candidates, {"name": 0.6, "place": 0.15, "bio": 0.15, "popularity": 0.1})
    return decided
