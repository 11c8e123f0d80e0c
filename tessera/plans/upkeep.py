"""Upserts, remaps, diffs, tags, cursors, ledgers and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.urls import bare_host, normal_url
from tessera.operators import incremental as I
from tessera.operators import reconcile as C
from tessera.operators.graph import closure
from tessera.operators.relational import priority_union, top_per_key
from tessera.plans.registry import query, table

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_OLD = "old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"


def _slices(spark, d):
    o = table(spark, d, "orders").select(*_COLUMNS)
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N")).withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_merge_all(spark, d):
    return C.replace_all(*_slices(spark, d), ["o_orderkey"])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def upsert_ignore(spark, d):
    return C.keep_existing(*_slices(spark, d), ["o_orderkey"], [F.col("o_custkey")])


@query(f"""WITH {_OLD}, {_NEW} SELECT n.o_orderkey, n.o_custkey, CASE WHEN o.o_orderstatus IN ('F', 'P') THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, n.o_totalprice
FROM new n LEFT JOIN old o USING (o_orderkey) UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def upsert_preserve_status(spark, d):
    return C.keep_decisions(*_slices(spark, d), ["o_orderkey"], "o_orderstatus", ("F", "P"))


@query("""WITH old AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS v, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1),
new AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN value END) AS v, count(*) AS n FROM events WHERE day(ts) > 25 GROUP BY 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.v, o.v) AS v, CAST(coalesce(n.n, 0) + coalesce(o.n, 0) AS BIGINT) AS n FROM new n FULL JOIN old o USING (user_id)""")
def upsert_coalesce_counter(spark, d):
    e = table(spark, d, "events")
    of = lambda f, kind: f.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == kind, F.col("value"))).alias("v"), F.count("*").alias("n"))
    old, new = of(e.where(F.day("ts") <= 15), "view"), of(e.where(F.day("ts") > 25), "signup")
    values = C.keep_unless_given(old.select("user_id", "v"), new.select("user_id", "v"), ["user_id"])
    return values.join(C.add_counts(old.select("user_id", "n"), new.select("user_id", "n"), ["user_id"], "n"), "user_id")


@query("""WITH t AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM t)
UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM t) AND l_returnflag = 'A'""")
def replace_child_rows(spark, d):
    touched = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem")
    fresh = lines.where("l_returnflag = 'A'").join(touched, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey")
    return C.replace_children(lines.select("l_orderkey", "l_partkey"), fresh, "l_orderkey", touched)


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS winner FROM events")
def earliest_wins_dedup(spark, d):
    e = table(spark, d, "events")
    first = top_per_key(e.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", F.lit(True).alias("winner"))
    return e.select("event_id", "user_id", "event_type").join(first, "event_id", "left").fillna(False, ["winner"])


@query("""WITH n AS (SELECT p_partkey, p_name, count(l_partkey) AS links FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
w AS (SELECT p_name, p_partkey AS win FROM n QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY links DESC, p_partkey) = 1)
SELECT DISTINCT l_orderkey, win AS l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN w USING (p_name)""")
def winner_compound_remap(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    links = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("links"))
    named = table(spark, d, "part").select("p_partkey", "p_name").join(links, "p_partkey", "left").fillna(0, ["links"])
    mapping = C.winners(named, "p_name", "p_partkey", [F.col("links").desc(), F.col("p_partkey")])
    return C.remap(lines, "l_partkey", mapping).select("l_orderkey", "l_partkey").distinct()


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + l_partkey) % 50 AS b FROM lineitem), m AS (SELECT s_suppkey AS old, s_suppkey - s_suppkey % 3 AS new FROM supplier WHERE s_suppkey % 3 > 0)
SELECT DISTINCT coalesce(x.new, a) AS a, coalesce(y.new, b) AS b FROM e LEFT JOIN m x ON x.old = a LEFT JOIN m y ON y.old = b WHERE coalesce(x.new, a) <> coalesce(y.new, b)""")
def edge_repoint(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 50).alias("b")).distinct()
    mapping = table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") - F.col("s_suppkey") % 3).alias("new"))
    return C.repoint_edges(edges, "a", "b", mapping)


_NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://(www\.)?', '', 'i'), '[?#].*$', ''), '/+$', ''))"
_GROUP = r"regexp_replace(" + _NORMAL + r", '^[^/]*/', '')"


@query(f"""WITH k AS (SELECT page_id, {_GROUP} AS g, length(html) AS n FROM pages), m AS (SELECT * FROM k WHERE g IN (SELECT g FROM k GROUP BY g HAVING count(*) > 1)),
f AS (SELECT g, page_id AS win FROM m QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, page_id) = 1)
SELECT page_id, CASE WHEN page_id = win THEN 'survivor' ELSE 'duplicate' END AS role, CASE WHEN page_id <> win THEN win END AS survivor_id FROM m JOIN f USING (g)""")
def survivor_cycle_break(spark, d):
    k = table(spark, d, "pages").select("page_id", F.regexp_replace(normal_url(F.col("url")), "^[^/]*/", "").alias("g"), F.length("html").alias("n"))
    return C.survivors(k, "g", "page_id", [F.col("n").desc(), F.col("page_id")])


@query("""WITH new AS (SELECT c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 1000000 ELSE 0 END AS c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_name = n.c_name AND o.c_acctbal = n.c_acctbal THEN 'same' ELSE 'changed' END AS status
FROM customer o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def diff_three_way(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    new = old.select((key + F.when(key % 50 == 0, 1000000).otherwise(0)).alias("c_custkey"), "c_name", F.when(key % 7 == 0, balance + 1).otherwise(balance).alias("c_acctbal"))
    return C.diff(old, new, ["c_custkey"])


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part UNION SELECT 'g e a r' UNION SELECT 'Hot-Rod' UNION SELECT ' RINGS '),
f AS (SELECT tag, regexp_replace(lower(trim(tag)), '(^|[^a-z0-9])rings($|[^a-z0-9])', '\\1ring\\2', 'g') AS t FROM w), c AS (SELECT tag, CASE WHEN t = 'g e a r' THEN 'gear' ELSE t END AS t FROM f), k AS (SELECT tag, t, replace(t, '-', ' ') AS key FROM c)
SELECT tag, CASE key WHEN 'gizmo' THEN 'gadget' WHEN 'hot rod' THEN 'rod' ELSE key END AS canonical FROM k WHERE key NOT IN ('old', 'new')""")
def tag_rules_normalise(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    extra = spark.createDataFrame([("g e a r",), ("Hot-Rod",), (" RINGS ",)], "tag string")
    rules = X.normalise_tag(F.col("tag"), [("rings", "ring")], {"gizmo": "gadget", "hot rod": "rod"}, ("old", "new"))
    return words.union(extra).select("tag", rules.alias("canonical")).where("canonical is not null")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part UNION SELECT '90s' UNION SELECT '1994' UNION SELECT '120 bpm' UNION SELECT 'berlin')
SELECT tag, CASE WHEN regexp_matches(tag, '^(19|20)?[0-9]0s$') THEN 'decade' WHEN regexp_matches(tag, '^(19|20)[0-9]{2}$') THEN 'year' WHEN tag IN ('red', 'blue') THEN 'colour' WHEN tag IN ('berlin', 'paris') THEN 'place' WHEN regexp_matches(tag, '^[0-9]+ bpm$') THEN 'tempo' ELSE '' END AS reason FROM w""")
def non_genre_classifier(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    extra = spark.createDataFrame([("90s",), ("1994",), ("120 bpm",), ("berlin",)], "tag string")
    reason = X.tag_reason(F.col("tag"), {"colour": ("red", "blue"), "place": ("berlin", "paris")}, {"tempo": "^[0-9]+ bpm$"})
    return words.union(extra).select("tag", reason.alias("reason"))


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM events WHERE event_type = 'purchase')")
def cursor_rewind(spark, d):
    e = table(spark, d, "events")
    return I.since_cursor(e, e.where("event_type = 'purchase'"), "ts").select("event_id", "user_id")


@query("""WITH l AS (SELECT event_id AS k, value AS m, event_id * 10 AS p FROM events WHERE event_id % 4 <> 3), s AS (SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS m FROM events WHERE event_id % 4 <> 0)
SELECT coalesce(l.k, s.k) AS k, CASE WHEN s.k IS NULL THEN l.m ELSE s.m END AS m, CASE WHEN s.k IS NULL OR l.m IS NOT DISTINCT FROM s.m THEN l.p END AS p FROM l FULL JOIN s ON l.k = s.k""")
def modified_reset(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("value").alias("m"))
    ledger = e.where("k % 4 <> 3").withColumn("p", F.col("k") * 10)
    sweep = e.where("k % 4 <> 0").select("k", F.when(F.col("k") % 5 == 0, F.col("m") + 1).otherwise(F.col("m")).alias("m"))
    return I.reset_if_modified(ledger, sweep, "k", "m", "p")


@query("""SELECT page_id, url, CASE WHEN page_id IN (SELECT event_id FROM events WHERE event_type = 'purchase') THEN 'done' WHEN page_id % 6 = 0 THEN 'skip' WHEN page_id % 6 = 1 THEN 'retry' ELSE 'new' END AS route FROM pages""")
def worklist_failure_memory(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    done = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("page_id"))
    failed = p.where("page_id % 6 < 2").select("page_id", F.when(F.col("page_id") % 6 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/old"))).alias("url"))
    return I.route(p, done, failed, "page_id", "url")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events), o AS (SELECT user_id, min(ms) AS opened FROM e GROUP BY 1 UNION ALL SELECT o.user_id, min(ms) FROM o JOIN e ON e.user_id = o.user_id AND ms >= opened + 21600000 GROUP BY 1),
w AS (SELECT e.user_id, event_id, ms, opened, CAST(row_number() OVER (PARTITION BY e.user_id, opened ORDER BY ms, event_id) AS INT) AS count FROM e ASOF JOIN o ON e.user_id = o.user_id AND ms >= opened)
SELECT user_id, event_id, count, count <= 5 AS allowed, CASE WHEN count > 5 THEN CAST(ceil((opened + 21600000 - ms) / 1000) AS BIGINT) END AS retry_after_s FROM w""")
def fixed_window_rate_limit(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    ms = F.expr("sign(us) * ((abs(us) + 500) div 1000)").cast("long")  # to the nearest, half away from 1970, as SQL's epoch_ms
    return I.rate_limit(table(spark, d, "events").select("user_id", "event_id", us.alias("us")).select("user_id", "event_id", ms.alias("ms")), "user_id", "ms", "event_id", 5, 6 * 3600 * 1000)


@query("""WITH s AS (SELECT o_orderkey, l_suppkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2, 3)))
SELECT DISTINCT x.l_suppkey AS supplier, y.p_brand AS brand FROM s x JOIN s y USING (o_orderkey)""")
def array_overlap_fanout(spark, d):
    lines = table(spark, d, "lineitem")
    lines = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    sets = lines.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"), F.collect_set("p_brand").alias("brands"))
    wanted = sets.where(F.arrays_overlap("suppliers", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])))
    known = wanted.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return known.select(F.explode("suppliers").alias("supplier"), "brands").select("supplier", F.explode("brands").alias("brand")).distinct()


@query(r"""WITH f AS (SELECT event_id AS page_id, CASE WHEN value < 5 THEN 404 WHEN value < 8 THEN 503 WHEN value < 10 THEN 403 ELSE 200 END AS status FROM events)
SELECT page_id, CASE WHEN status IN (404, 410) THEN 'gone' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 'unreachable' ELSE 'transient' END AS outcome,
CASE WHEN status = 503 THEN 'retry' WHEN status IN (404, 410) AND url LIKE 'https:%' THEN 'drop' WHEN status = 200 THEN 'keep' ELSE 'mark' END AS action FROM pages JOIN f USING (page_id)""")
def state_machine_route(spark, d):
    v = F.col("value")
    status = F.when(v < 5, 404).when(v < 8, 503).when(v < 10, 403).otherwise(200)
    f = table(spark, d, "events").select(F.col("event_id").alias("page_id"), status.alias("status"))
    out = table(spark, d, "pages").select("page_id", "url").join(f, "page_id").withColumn("outcome", I.outcome(F.col("status")))
    action = F.when(F.col("outcome") == "transient", "retry").when((F.col("outcome") == "gone") & F.col("url").startswith("https:"), "drop").when(F.col("outcome") == "ok", "keep").otherwise("mark")
    return out.select("page_id", "outcome", action.alias("action"))


@query(r"""SELECT page_id, host FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
QUALIFY row_number() OVER (PARTITION BY host, CASE WHEN host LIKE 'blog.%' THEN url END ORDER BY page_id) = 1""")
def mixed_key_dedupe(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", bare_host(F.col("url")).alias("host"))
    keyed = p.withColumn("key", F.when(F.col("host").startswith("blog."), F.col("url")).otherwise(F.col("host")))
    return top_per_key(keyed, ["host", "key"], [F.col("page_id")]).select("page_id", "host")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey * 2 + l_linenumber % 3 AS b FROM lineitem), r AS (SELECT 1::BIGINT AS id UNION SELECT b FROM r JOIN e ON a = id WHERE id % 10 <> 0) SELECT id FROM r""")
def provenance_closure(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * 2 + F.col("l_linenumber") % 3).alias("b")).distinct()
    stops = edges.select(F.col("b").alias("id")).distinct().where("id % 10 = 0")
    return closure(spark.createDataFrame([(1,)], "id long"), edges, stops).select("id")


@query("SELECT DISTINCT lower(p_type) AS name, CAST(1000 + dense_rank() OVER (ORDER BY lower(p_type)) AS BIGINT) AS id FROM part WHERE p_type <> 'PROMO'")
def find_or_create_ids(spark, d):
    known = spark.createDataFrame([("promo", 1000)], "name string, id long")
    return C.new_ids(table(spark, d, "part").select(F.lower("p_type").alias("name")), known, "id", "name").select("name", "id")


@query("""SELECT user_id, origin, event_id FROM (SELECT user_id, 'purchase' AS origin, min(event_id) AS event_id, 0 AS p FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, 'view', min(event_id), 1 FROM events WHERE event_type = 'view' GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) = 1""")
def best_source_first(spark, d):
    e = table(spark, d, "events")
    of = lambda k: e.where(F.col("event_type") == k).groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("origin", F.lit(k))
    return priority_union([of("purchase"), of("view")], ["user_id"]).select("user_id", "origin", "event_id")


@query("""WITH n AS (SELECT user_id, max(ts) AS newest FROM events WHERE event_type = 'view' GROUP BY 1), t AS (SELECT user_id, max(ts) AS own FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT user_id, newest FROM n LEFT JOIN t USING (user_id) WHERE own IS NULL OR newest > own""")
def stale_worklist(spark, d):
    e = table(spark, d, "events")
    targets = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return I.stale(targets, e.where("event_type = 'view'"), "user_id", "ts")


@query("""WITH m AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM m WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 2""")
def failure_runs(spark, d):
    return I.failure_runs(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", 2)
