"""Directory reads: filters, joins, aggregates, rankings, unions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import search_key
from tessera.functions.urls import bare_host
from tessera.operators import relational as R
from tessera.plans.registry import query, table


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey IN (1, 3, 5, 7, 9)")
def scan_project_filter(spark, d):
    c = table(spark, d, "customer")
    return c.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0) & F.col("c_nationkey").isin(1, 3, 5, 7, 9)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def genre_filter_semi(spark, d):
    urgent = table(spark, d, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)).select(F.col("o_custkey").alias("c_custkey"))
    return R.having(table(spark, d, "customer"), urgent, "c_custkey").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, count(l_partkey) AS n_lines, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def lookup_embed_structs(spark, d):
    parents = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    nested = R.children(parents, lines, "o_orderkey", ["l_partkey"], "lines")
    parts = F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",")
    return nested.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), parts.alias("parts"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
(SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')""")
def missing_link_anti(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    with_return = R.having(table(spark, d, "orders"), returned, "o_orderkey").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing(table(spark, d, "customer"), with_return, "c_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 AND l_returnflag = 'A' GROUP BY p_partkey")
def left_filter_in_on(spark, d):
    few = table(spark, d, "lineitem").where("l_quantity > 49 and l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").select("p_partkey").join(few, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000) AS marked FROM customer")
def exists_semi_mark(spark, d):
    big = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("marked", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("marked", F.lit(False)).alias("marked"))


@query("""SELECT p_name, count(DISTINCT l_suppkey) AS suppliers FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE l_returnflag = 'R' AND p_size < 10 GROUP BY p_name HAVING count(DISTINCT l_suppkey) >= 3""")
def sparse_group_having(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    named = table(spark, d, "part").where("p_size < 10").select("p_partkey", "p_name")
    return lines.join(named, "p_partkey").groupBy("p_name").agg(F.count_distinct("l_suppkey").alias("suppliers")).where("suppliers >= 3")


@query("""WITH c AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY p_partkey)
SELECT CAST(level AS INT) AS level, CAST(count(*) FILTER (n <= level) AS BIGINT) AS "rows" FROM c, (VALUES (0), (1), (2), (3), (5), (10)) v(level) GROUP BY level""")
def threshold_ladder(spark, d):
    n = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    counts = table(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").fillna(0, ["n"])
    return R.threshold_ladder(counts, "n", (0, 1, 2, 3, 5, 10))


@query("""SELECT c_mktsegment, o_orderstatus, count(*) AS n, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS avg_price,
floor(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) * 100 + 0.5) / 100 AS avg_urgent
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def conditional_avg_stats(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    cents = lambda c: F.floor(c * 100 + 0.5) / 100
    urgent = F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), cents(F.avg("o_totalprice")).alias("avg_price"), cents(urgent).alias("avg_urgent"))


@query("SELECT count(*) AS n, CAST(floor(count(*) / 100) * 100 AS BIGINT) AS rounded FROM customer WHERE c_acctbal >= 0")
def rounded_count_stat(spark, d):
    n = F.count("*")
    return table(spark, d, "customer").where("c_acctbal >= 0").agg(n.alias("n"), (F.floor(n / 100) * 100).cast("long").alias("rounded"))


@query(r"""SELECT regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1""")
def domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(bare_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT upper(n_name) AS option FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT DISTINCT c_mktsegment FROM customer")
def distinct_sorted_options(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    used = R.having(n, c.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey").select(F.upper("n_name").alias("option"))
    return used.unionByName(c.select(F.col("c_mktsegment").alias("option"))).distinct().orderBy("option")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_seen_order(spark, d):
    return R.first_seen(table(spark, d, "events"), "user_id", ["event_id"])


@query("SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def string_agg_ordered(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "; ").alias("nations"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_on_best(spark, d):
    return R.top_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("SELECT user_id, event_type, max(ts) AS latest, max_by(event_id, struct_pack(ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("latest"), F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 48")
def page_window(spark, d):
    return R.page(table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 3, 24)


@query("""WITH t AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' GROUP BY 1)
SELECT c_custkey, top, row_number() OVER (ORDER BY top DESC NULLS LAST, c_custkey) AS place FROM customer LEFT JOIN t ON o_custkey = c_custkey ORDER BY place LIMIT 500""")
def nulls_last_order(spark, d):
    top = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '2-HIGH'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    first = table(spark, d, "customer").select("c_custkey").join(top, "c_custkey", "left").orderBy(F.desc_nulls_last("top"), "c_custkey").limit(500)
    from pyspark.sql import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("top"), "c_custkey")).cast("long"))


@query("SELECT p_partkey, p_name, CAST(position AS INT) AS position FROM part JOIN (VALUES (17, 0), (3, 1), (101, 2), (55, 3), (2, 4)) v(k, position) ON k = p_partkey")
def reorder_by_given_ids(spark, d):
    return R.by_given_order(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", [17, 3, 101, 55, 2])


@query("""WITH y AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) AS y FROM orders)
SELECT 'both' AS part, k FROM (SELECT k FROM y WHERE y = 1996 INTERSECT SELECT k FROM y WHERE y = 1997)
UNION ALL SELECT 'first only', k FROM (SELECT k FROM y WHERE y = 1996 EXCEPT SELECT k FROM y WHERE y = 1997)
UNION ALL SELECT 'either', k FROM (SELECT k FROM y WHERE y = 1996 UNION SELECT k FROM y WHERE y = 1997)""")
def union_intersect_except(spark, d):
    y = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    a, b = y.where("y = 1996").select("k"), y.where("y = 1997").select("k")
    parts = {"both": a.intersect(b), "first only": a.subtract(b), "either": a.union(b).distinct()}
    named = [f.select(F.lit(n).alias("part"), "k") for n, f in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""SELECT doc_id, origin FROM (SELECT doc_id, 'toxic' AS origin, 0 AS p FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'good', 1 FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, lang, 2 FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1""")
def priority_union(spark, d):
    lab, docs = table(spark, d, "labels"), table(spark, d, "documents")
    frames = [lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("origin")), lab.where("quality = 1").select("doc_id", F.lit("good").alias("origin")), docs.select("doc_id", F.col("lang").alias("origin"))]
    return R.priority_union(frames, ["doc_id"])


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def platform_pivot(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).fillna(0, kinds)


@query("""SELECT * FROM (SELECT 'error' AS queue, event_id AS item, ts AS at FROM events WHERE event_type = 'error'
UNION ALL SELECT 'signup', event_id, ts FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def moderation_queue(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    of = lambda f, name, item, at: f.select(F.lit(name).alias("queue"), F.col(item).alias("item"), F.col(at).cast("timestamp_ntz").alias("at"))
    parts = [of(e.where("event_type = 'error'"), "error", "event_id", "ts"), of(e.where("event_type = 'signup'"), "signup", "event_id", "ts"), of(o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"), "order", "o_orderkey", "o_orderdate")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("at", "queue", "item")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size <= 25 AND (regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') LIKE '%dbolt%'
OR p_brand IN (SELECT DISTINCT p_brand FROM part WHERE lower(p_brand) LIKE '%#1_' AND p_type = 'PROMO'))""")
def directory_search(spark, d):
    p = table(spark, d, "part")
    alias = p.where(F.col("p_brand").ilike("%#1_") & (F.col("p_type") == "PROMO")).select("p_brand").distinct().withColumn("by_alias", F.lit(True))
    found = p.where("p_size <= 25").join(alias, "p_brand", "left").where(search_key(F.col("p_name")).contains("dbolt") | F.col("by_alias"))
    return found.select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM (SELECT *, md5(c_custkey || 'seed-7') AS h FROM customer) ORDER BY h, c_custkey LIMIT 100")
def seeded_sample(spark, d):
    return R.seeded_sample(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, "seed-7")


@query("""SELECT s_suppkey, ps[1 + CAST(('0x' || substr(md5(s_suppkey || ':2024-05-01'), 1, 7))::BIGINT % len(ps) AS BIGINT)] AS picked
FROM (SELECT l_suppkey AS s_suppkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS ps FROM lineitem GROUP BY 1)""")
def daily_pick(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sort_array(F.collect_set("l_partkey")).alias("ps"))
    h = F.conv(F.substring(F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit(":2024-05-01"))), 1, 7), 16, 10).cast("long")
    return parts.select("s_suppkey", F.element_at("ps", (h % F.size("ps") + 1).cast("int")).alias("picked"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, d):
    return R.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def row_visibility(spark, d):
    seen = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.visible(table(spark, d, "customer"), seen, "c_nationkey", ["c_custkey", "c_name"])
