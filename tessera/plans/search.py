"""Searches without blocks or bounds: all alike names and words, redirect chains, nested JSON, streams out of order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import alike, json_tree, redirects
from tessera.plans.match import _R4, _TRI
from tessera.plans.registry import query, table
from tessera.storage import scratch
from tessera.streaming import ordered

_GRAMS = f"n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT name, '  ' || regexp_replace(name, '[^a-z0-9]', '', 'g') || ' ' AS p FROM n), g AS (SELECT name, {_TRI} AS g FROM k), s AS (SELECT x.name AS a, y.name AS b, len(list_intersect(x.g, y.g)) AS c, len(x.g) + len(y.g) AS n FROM g x, g y WHERE x.name < y.name)"


@query(f"WITH {_GRAMS} SELECT least, a, b, {_R4.format('c / (n - c)')} AS similarity FROM s, (VALUES (300), (500), (700)) t(least) WHERE 1000 * c >= least * (n - c)")
def names_alike(spark, d):
    """All pairs of names, at three thresholds of trigram similarity."""
    names = table(spark, d, "part").select("p_name").distinct()
    at = lambda p: alike.trigram_pairs(names, "p_name", X.search_key(F.col("p_name")), p).select(F.lit(p).alias("least"), "a", "b", X.round4(F.col("similarity")).alias("similarity"))
    return at(300).unionByName(at(500)).unionByName(at(700))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]{4,}')) AS w FROM pages)
SELECT x.w AS a, y.w AS b, levenshtein(x.w, y.w) AS edits FROM w x JOIN w y ON x.w < y.w AND abs(length(x.w) - length(y.w)) <= 2 WHERE levenshtein(x.w, y.w) <= 2""")
def words_within_edits(spark, d):
    """All pairs of words of page titles that two edits part at most."""
    words = F.regexp_extract_all(F.lower(H.title(F.col("html"))), F.lit("[a-z]{4,}"), F.lit(0))
    return alike.edit_pairs(table(spark, d, "pages").select(F.explode(words).alias("w")), "w", 2)


_LANDED = r"""u AS (SELECT url, min(page_id) AS id, lower(regexp_replace(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')) AS host FROM pages GROUP BY url),
l AS MATERIALIZED (SELECT a.url, CASE WHEN a.id % 10 < 6 THEN 301 WHEN a.id % 10 IN (7, 8) THEN 302 WHEN a.id % 50 = 9 THEN 308 WHEN a.id % 40 = 16 THEN 404 WHEN a.id % 40 = 26 THEN NULL ELSE 200 END AS status, b.url AS location, CASE WHEN a.id % 40 = 26 THEN 'timeout' END AS error
FROM u a LEFT JOIN u b ON b.id = CASE WHEN a.id % 10 < 6 OR a.id % 10 = 7 THEN a.id + 1 WHEN a.id % 10 = 8 THEN a.id - 1 WHEN a.id % 50 = 9 THEN a.id - 3 END WHERE a.id % 70 <> 34)"""


@query(rf"""WITH RECURSIVE {_LANDED}, way AS (SELECT url, url AS at_, 0 AS hops FROM u UNION ALL SELECT way.url, l.location, hops + 1 FROM way JOIN l ON l.url = way.at_ WHERE l.location IS NOT NULL AND l.status BETWEEN 300 AND 399 AND hops < 5),
e AS (SELECT url, arg_max(at_, hops) AS at_, max(hops) AS hops FROM way GROUP BY url), f AS (SELECT e.*, u.host, CASE length(u.host) % 3 WHEN 0 THEN 'reclassify' WHEN 1 THEN 'validate' END AS tier, l.url IS NOT NULL AS landed, l.status, l.error, l.status BETWEEN 300 AND 399 AND l.location IS NOT NULL AS sends, t.host AS there,
regexp_extract(e.at_, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM e JOIN u ON u.url = e.url LEFT JOIN l ON l.url = e.at_ JOIN u t ON t.url = e.at_),
r AS (SELECT *, CASE WHEN tier IS NULL THEN 'not-resolvable' WHEN NOT landed THEN 'not-landed' WHEN error = 'timeout' THEN 'timeout' WHEN error IS NOT NULL THEN 'network-error' WHEN hops = 0 THEN 'no-redirect' WHEN sends THEN 'max-hops' WHEN status >= 400 THEN 'dead-destination'
WHEN tier = 'validate' AND NOT ((there = 'example.com' OR there LIKE '%.example.com') AND there <> host AND regexp_matches(path, '^/(en|fr)/')) THEN 'validation-failed' END AS reason FROM f)
SELECT url, tier, reason IS NULL AS resolved, CASE WHEN reason IS NULL THEN at_ ELSE url END AS kept, CASE WHEN reason IS NULL OR reason IN ('max-hops', 'dead-destination', 'validation-failed') THEN at_ END AS destination,
CASE WHEN tier IS NOT NULL AND landed AND NOT coalesce(sends, false) THEN status END AS final_status, CASE WHEN tier IS NOT NULL THEN hops END AS hops, reason FROM r""")
def redirect_reasons(spark, d):
    """Pages that send on to one another in chains and loops, judged by the rules of their hosts."""
    u = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("id"))
    i = F.col("id")
    to = F.when((i % 10 < 6) | (i % 10 == 7), i + 1).when(i % 10 == 8, i - 1).when(i % 50 == 9, i - 3)
    status = F.when(i % 10 < 6, 301).when((i % 10).isin(7, 8), 302).when(i % 50 == 9, 308).when(i % 40 == 16, 404).when(i % 40 != 26, 200)
    there = u.select(F.col("id").alias("to"), F.col("url").alias("location"))
    landed = u.where("id % 70 <> 34").withColumns({"to": to, "status": status, "error": F.when(i % 40 == 26, "timeout")}).join(there, "to", "left")
    host = U.bare_host(F.col("url"))
    kind = F.length("host") % 3
    rules = u.select(host.alias("host")).distinct().where(kind < 2).select("host", F.when(kind == 0, "reclassify").otherwise("validate").alias("tier"), F.lit("example.com").alias("expect_host"), F.lit("^/(en|fr)/").alias("expect_path"))
    return redirects.resolve(u, landed, rules)


@query("""SELECT l_orderkey AS id, CAST(l_orderkey % 4 AS INT) AS depth, '{"n":' || count(*) || '}' AS value FROM lineitem WHERE l_orderkey % 4 < 3 GROUP BY l_orderkey""")
def buried_values(spark, d):
    """An object somewhere in each order's JSON, before or behind its lines; lines hold one deeper down."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.struct(F.col("l_suppkey").alias("by")).alias("sold"))).alias("lines"))
    account = F.struct(F.size("lines").alias("n"))
    deeper = F.transform("lines", lambda x: F.struct(x["part"].alias("part"), F.struct(F.struct(x["sold"].alias("account")).alias("y")).alias("z")))
    k = F.col("l_orderkey") % 4
    one = F.struct(account.alias("account"))
    text = F.when(k == 0, F.to_json(F.struct(deeper.alias("lines"), account.alias("account")))).when(k == 1, F.to_json(F.struct(deeper.alias("lines"), one.alias("up")))).when(k == 2, F.to_json(F.struct(deeper.alias("lines"), F.array(F.struct(F.lit(None).cast("struct<n:int>").alias("account")), one).alias("up")), {"ignoreNullFields": "true"}))
    return json_tree.first_values(lines.select(F.col("l_orderkey").alias("id"), text.alias("text")), "id", "text", "account")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events), o AS (SELECT user_id, min(ms) AS opened FROM e GROUP BY 1 UNION ALL SELECT o.user_id, min(ms) FROM o JOIN e ON e.user_id = o.user_id AND ms >= opened + 21600000 GROUP BY 1),
w AS (SELECT e.user_id, event_id, CAST(row_number() OVER (PARTITION BY e.user_id, opened ORDER BY ms, event_id) AS INT) AS count FROM e ASOF JOIN o ON e.user_id = o.user_id AND ms >= opened)
SELECT user_id, event_id, count, count <= 5 AS allowed FROM w""")
def stream_ordered_limit(spark, d):
    """All events, shuffled over five batches of a stream; a last one far ahead lets the watermark pass them."""
    folder = f"{scratch(spark)}/ordered-{uuid.uuid4().hex}"
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    events = table(spark, d, "events").select("user_id", "event_id", ms.alias("ms"))
    for i in range(5):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    events.agg(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.max("ms") + 10**11).alias("ms")).write.parquet(f"{folder}/in/5")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    before = spark.conf.get(ordered.SETTING)
    spark.conf.set(ordered.SETTING, ordered.STORE)
    try:
        limited = ordered.rate_limit(stream, "user_id", "ms", "event_id", 5, 6 * 3600 * 1000, "400 days")
        limited.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ordered.SETTING, before)
    return spark.read.schema(limited.schema).parquet(f"{folder}/out").where("event_id >= 0")
