"""Texts, links, counters, references and lookups in detail, on the tables' own texts, pages and links."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions import times
from tessera.functions import urls as U
from tessera.operators import reconcile
from tessera.operators.relational import top_per_key
from tessera.plans.registry import query, table
from tessera.sources import providers
from tessera.storage import scratch

_HOST = r"lower(regexp_extract(u, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(r"""WITH d AS (SELECT doc_id, text, left(text, 90) AS s, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, regexp_replace(s, '([^\w\s])', '\\\1', 'g') AS pattern, regexp_matches(s, '^(?s:.*)$') AS matched, coalesce('''' || replace(s, '''', '''''') || '''', 'NULL') AS literal,
coalesce(CASE WHEN regexp_matches(s, '[",\n\r]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END, '') AS field, CASE WHEN text IS NULL OR text = '' THEN '(none)' ELSE '"' || left(flat, 30) || CASE WHEN length(flat) > 30 THEN '…' ELSE '' END || '"' END AS preview FROM d WHERE regexp_full_match(coalesce(left(text, 90), ''), '(?s)[\x00-\x7F]*')""")
def text_escapes(spark, d):
    """Beginnings of plain texts as patterns, literals and fields, and previews of whole texts."""
    s = F.col("s")
    docs = table(spark, d, "documents").select("doc_id", "text", F.left("text", F.lit(90)).alias("s")).where(F.coalesce(s, F.lit("")).rlike(r"^(?s:[\x00-\x7F]*)$"))
    return docs.select("doc_id", X.escape_regex(s).alias("pattern"), F.regexp_like(s, F.concat(F.lit("^"), X.escape_regex(s), F.lit("$"))).alias("matched"), X.sql_text(s).alias("literal"), X.csv_field(s).alias("field"), X.preview(F.col("text")).alias("preview"))


@query(r"""SELECT page_id, 'see ' || url || ' and ' || url || '/ü?a=1&b=%20 or http://gate.sc?url=%zz.' AS unwrapped, 'A' || chr(page_id::INT % 50000 + 200) || chr(128512 + page_id::INT % 60) || '&amp;&#;' || chr(65533) AS decoded, (['Approved', 'Not eligible', 'SC only', 'From MB lookup'])[page_id % 4 + 1] AS label FROM pages""")
def wrapped_texts(spark, d):
    """Links of pages wrapped by a click counter within texts, numeric entities, labels of states."""
    i = F.col("page_id")
    wrapped = lambda u: F.concat(F.lit("https://gate.sc?url="), F.replace(F.url_encode(u), F.lit("+"), F.lit("%20")), F.lit("&token=x"))
    text = F.concat(F.lit("see "), wrapped(F.col("url")), F.lit(" and "), wrapped(F.concat("url", F.lit("/ü?a=1&b=%20"))), F.lit(" or http://gate.sc?url=%zz."))
    coded = F.concat(F.lit("&#65;&#"), (i % 50000 + 200).cast("string"), F.lit(";&#x"), F.hex(128512 + i % 60), F.lit(";&amp;&#;&#xD800;"))
    state = F.element_at(F.array(*map(F.lit, ("approved", "not_eligible", "sc_only", "from_mb_lookup"))), (i % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.without_wrappers(text, r"gate\.sc").alias("unwrapped"), X.number_entities(coded).alias("decoded"), X.status_label(state).alias("label"))


@query(rf"""WITH p AS (SELECT page_id, url AS u, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '(#.+)$', 1) AS frag FROM pages), h AS (SELECT *, {_HOST} AS host FROM p),
c AS (SELECT *, 'https://' || regexp_replace(host, '^www\.', '') || CASE WHEN regexp_replace(path, '(.)/$', '\1') = '' THEN '/' ELSE regexp_replace(path, '(.)/$', '\1') END AS base, list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('page', 'si')) AS kept FROM h)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || frag AS compared, true AS same, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'https://' || host END AS core, lower(u) LIKE '%/en/%' OR lower(u) LIKE '%/fr/%' AS deep,
host LIKE '%.example.com' AS own, NOT host LIKE '%.example.com' AS off, CASE WHEN page_id % 3 = 0 THEN 'http://i/' || page_id || '-t500x500.jpg' WHEN page_id % 3 = 1 THEN 'http://i/' || page_id || '-t500x500' END AS image, page_id % 2 = 0 AS placeholder FROM c""")
def link_details(spark, d):
    """Comparable forms, front pages, what lies deeper, sites' guards and image links."""
    u, i = F.col("url"), F.col("page_id")
    image = F.when(i % 3 == 0, F.concat(F.lit("http://i/"), i.cast("string"), F.lit("-large.jpg"))).when(i % 3 == 1, F.concat(F.lit("http://i/"), i.cast("string"), F.lit("-large"))).otherwise("")
    avatar = F.when(i % 2 == 0, "https://a/images/default_avatar_large.png").when(i % 4 == 1, "https://a/avatars-1-large.jpg")
    upper = F.regexp_replace(u, "^https?://(www\\.)?", "HTTP://www.")
    return table(spark, d, "pages").select(
        "page_id", U.comparable(u, ("page", "si")).alias("compared"), U.same_link(upper, u).alias("same"), U.core_url(u, "example.com").alias("core"), U.is_deep(u, ("/en/", "/fr/")).alias("deep"),
        U.own_subdomain(u, "example.com").alias("own"), U.landed_off(u, "example.com").alias("off"), U.resized(image, "large", "t500x500").alias("image"), U.is_placeholder(avatar).alias("placeholder"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM events")
def time_texts(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", times.date_key(ts).alias("day"), times.iso_stamp(ts).alias("stamp"), times.shown(ts).alias("shown"))


@query("""SELECT 'customers' AS key, floor(count(*) / 100) * 100 AS value, count(*) AS exact, floor(count(*) / 100) * 100 AS returned FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'parts', 7, 7, floor(count(*) / 100) * 100 FROM customer WHERE c_acctbal > 0""")
def refreshed_counter(spark, d):
    """A counter brought up to date in its table, with the value that the caller gets."""
    stats = spark.createDataFrame([("customers", 5, 5), ("parts", 7, 7)], "key string, value long, exact long").withColumn("updated", F.current_timestamp())
    after, value = reconcile.refresh_count(stats, "customers", table(spark, d, "customer").where("c_acctbal > 0"))
    return after.join(F.broadcast(value.select(F.col("value").cast("double").alias("returned")))).select("key", F.col("value").cast("double").alias("value"), "exact", "returned")


@query("""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 = 0), og AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM gone))
SELECT 'orders' AS t, count(*) AS n, count(o_custkey) AS held, sum(o_orderkey)::BIGINT AS total FROM orders WHERE o_orderkey NOT IN (SELECT id FROM og)
UNION ALL SELECT 'lines', count(*), count(l_orderkey), sum(l_orderkey * 10 + l_linenumber)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM og)
UNION ALL SELECT 'notes', count(*), count(*) FILTER (o_orderkey NOT IN (SELECT id FROM og)), sum(o_orderkey)::BIGINT FROM orders""")
def cascaded_deletes(spark, d):
    """Customers go with their orders and these with their lines; notes on orders stay and lose their order."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order"))
    notes = o.select(F.col("id"), F.col("id").alias("order"))
    references = [("orders", "customer", "customers", "cascade"), ("lines", "order", "orders", "cascade"), ("notes", "order", "orders", "set null")]
    left = reconcile.delete_with_references({"customers": c, "orders": o, "lines": lines, "notes": notes}, references, {"customers": c.where("id % 7 = 0")})
    told = lambda name, column: left[name].agg(F.lit(name).alias("t"), F.count("*").alias("n"), F.count(column).alias("held"), F.sum("id").alias("total")).select("t", "n", "held", "total")
    return told("orders", "customer").unionByName(told("lines", "order")).unionByName(told("notes", "order"))


@query("""WITH f AS (SELECT l_orderkey, l_suppkey, max(l_linenumber * 100000 + l_partkey) % 100000 AS part FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_suppkey || ':' || part, ',' ORDER BY part, l_suppkey) AS items FROM f GROUP BY 1""")
def flattened_nested(spark, d):
    """Lines embedded in orders: refused ones filtered, of a supplier's several the last, sorted by part."""
    item = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"))
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("x"))
    kept = F.filter("x", lambda v: v["flag"] != "R")
    last = F.filter("kept", lambda v, i: ~F.exists("kept", lambda w: (w["id"] == v["id"]) & ((w["l_linenumber"] > v["l_linenumber"]) | ((w["l_linenumber"] == v["l_linenumber"]) & (w["part"] > v["part"])))))
    shown = F.array_sort(F.array_distinct(F.transform("last", lambda v: F.struct(v["part"].alias("part"), v["id"].alias("id")))))
    return nested.select("l_orderkey", kept.alias("kept")).where("size(kept) > 0").select("l_orderkey", last.alias("last")).select("l_orderkey", F.array_join(F.transform(shown, lambda v: F.concat_ws(":", v["id"].cast("string"), v["part"].cast("string"))), ",").alias("items"))


@query(r"""SELECT count(*) FILTER (text ILIKE '%the%') AS has_the, count(*) FILTER (contains(lower(text), '100%')) AS has_percent, count(*) FILTER (lower(text) LIKE '%a\_b%' ESCAPE '\') AS has_wild, count(*) FILTER (lower(left(text, 1)) LIKE '\%' ESCAPE '\') AS starts_percent FROM documents""")
def like_searches(spark, d):
    """Searches without regard to case: with wildcards, as substrings, and for texts whose wildcards are escaped."""
    low = F.lower("text")
    hit = lambda c, name: F.count_if(c).alias(name)
    wild = F.like(low, F.concat(F.lit("%"), X.escape_like(F.lit("a_b")), F.lit("%")))
    return table(spark, d, "documents").agg(hit(F.col("text").ilike("%the%"), "has_the"), hit(low.contains("100%"), "has_percent"), hit(wild, "has_wild"), hit(F.like(F.lower(F.left("text", F.lit(1))), X.escape_like(F.lit("%"))), "starts_percent"))


@query("""SELECT s_suppkey, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_linenumber = 1) < 3 THEN 'sparse' ELSE 'kept' END AS status FROM supplier""")
def sparse_statuses(spark, d):
    """A state set by how many rows point to each, none included."""
    n = table(spark, d, "lineitem").where("l_discount > 0.09 and l_linenumber = 1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", F.when(F.coalesce("n", F.lit(0)) < 3, "sparse").otherwise("kept").alias("status"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS id, p_type AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45)
SELECT 'supplier' AS side, CAST(id AS VARCHAR) AS key, string_agg(item, ',' ORDER BY item) AS members FROM e GROUP BY id UNION ALL SELECT 'type', item, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM e GROUP BY item""")
def sets_both_ways(spark, d):
    """Each supplier's set of types, and each type's list of suppliers."""
    parts = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item"))
    e = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("id")).join(parts, "l_partkey").select("id", "item").distinct()
    own = e.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("m")).select(F.lit("supplier").alias("side"), F.col("id").cast("string").alias("key"), F.array_join("m", ",").alias("members"))
    of = e.groupBy("item").agg(F.sort_array(F.collect_list("id")).alias("m")).select(F.lit("type").alias("side"), F.col("item").alias("key"), F.array_join("m", ",").alias("members"))
    return own.unionByName(of)


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 25)""")
def first_distinct(spark, d):
    """All orders of the first 25 distinct customers in the order of prices."""
    o = table(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("p")).orderBy(F.desc("p"), "o_custkey").limit(25)
    return o.join(F.broadcast(first.select("o_custkey")), "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


@query("""SELECT s.service, page_id FROM pages, (VALUES ('mb', 3), ('sp', 4)) s(service, k) WHERE page_id % s.k <> 0 AND page_id % 11 <> 0""")
def work_by_service(spark, d):
    """What each service has still to do: pages less those that its log has, or that all logs have."""
    p = table(spark, d, "pages").select("page_id")
    services = spark.createDataFrame([("mb", 3), ("sp", 4)], "service string, k int")
    work = p.join(F.broadcast(services)).select("service", "page_id")
    log = p.join(F.broadcast(services)).where((F.col("page_id") % F.col("k") == 0) | (F.col("page_id") % 11 == 0)).select("service", "page_id")
    return work.join(log, ["service", "page_id"], "left_anti")


@query("""SELECT event_type, count(*) AS n, 2 AS runs FROM events GROUP BY 1""")
def scheduled_runs(spark, d):
    """A refresh that a scheduler starts: each run takes what came since the last one, by the stream's checkpoint."""
    folder = f"{scratch(spark)}/scheduled-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "event_type")
    for run in (0, 1):
        events.where(F.col("event_id") % 2 == run).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in").withColumn("run", F.lit(run))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("run").cast("int").alias("runs"))


@query(r"""SELECT page_id, regexp_extract(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS key, CASE WHEN page_id % 3 = 0 THEN 'yes' ELSE 'no' END AS hit, CASE WHEN page_id % 3 = 0 THEN length(html) END AS size FROM pages WHERE page_id IN
(SELECT min(page_id) FROM pages GROUP BY regexp_extract(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1))""")
def files_by_key(spark, d):
    """Rows joined to a folder of JSON files, one for each key, by the last segment of their links, with a mark whether there is a file."""
    folder = f"{scratch(spark)}/files-{uuid.uuid4().hex}"
    pages = top_per_key(table(spark, d, "pages").withColumn("key", U.last_segment(F.col("url"))), ["key"], [F.col("page_id")])
    pages.where("page_id % 3 = 0").select("key", F.length("html").cast("long").alias("size")).write.partitionBy("key").json(f"{folder}/cache")
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("key", T.StringType())])
    cache = spark.read.schema(schema).json(f"{folder}/cache")
    return pages.join(cache.select("key", "size", F.lit("yes").alias("hit")), "key", "left").select("page_id", "key", F.coalesce("hit", F.lit("no")).alias("hit"), "size")


@query("SELECT 'shown_customers' AS table, 'c_acctbal' AS column UNION ALL SELECT 'shown_regions', 'r_name' FROM (SELECT count(*) AS n FROM region) WHERE n > 0")
def exposed_columns(spark, d):
    """What the session's catalog shows of two views beyond what is allowed."""
    table(spark, d, "customer").createOrReplaceTempView("shown_customers")
    table(spark, d, "region").createOrReplaceTempView("shown_regions")
    allowed = {"shown_customers": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "shown_regions": ("r_regionkey",)}
    return providers.exposed(spark, allowed).where(F.col("table").isin(*allowed))
