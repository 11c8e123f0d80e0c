"""URLs, pages, JSON and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import urls as U
from tessera.plans.registry import query, table
from tessera.storage import scratch
from tessera.streaming.windows import tumbling_counts

_NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://(www\.)?', '', 'i'), '[?#].*$', ''), '/+$', ''))"
_HOST = r"lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_PATH = r"regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"


@query(f"SELECT page_id, {_NORMAL} AS normal FROM pages")
def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", U.normal_url(F.col("url")).alias("normal"))


@query(f"WITH k AS (SELECT page_id, {_NORMAL} AS k FROM pages), m AS (SELECT k, min(page_id) AS a FROM k GROUP BY 1) SELECT a, page_id AS b, k AS normal FROM k JOIN m USING (k) WHERE a < page_id")
def url_norm_self_join(spark, d):
    """Each page with the least page of its normal URL, so that a URL of many pages makes no pairs among them."""
    k = table(spark, d, "pages").select(F.col("page_id").alias("b"), U.normal_url(F.col("url")).alias("normal"))
    return k.join(k.groupBy("normal").agg(F.min("b").alias("a")), "normal").where("a < b").select("a", "b", "normal")


@query(rf"""WITH p AS (SELECT page_id, 'https://' || regexp_replace({_HOST}, '^www\.', '') || {_PATH} AS u, list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN
('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'fbclid', 'gclid', 'igshid', 'igsh', 'si', 'ref', 'mc_cid', 'mc_eid')) AS q FROM pages)
SELECT page_id, u || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS clean FROM p""")
def url_strip_tracking(spark, d):
    return table(spark, d, "pages").select("page_id", U.strip_tracking(F.col("url")).alias("clean"))


_RULES = [("spam", "spam|cheap"), ("blog", "^blog\\."), ("mobile", "^m\\."), ("network", "\\.net$")]


@query(rf"""SELECT page_id, CASE WHEN regexp_matches({_HOST}, 'spam|cheap') THEN 'spam' WHEN regexp_matches({_HOST}, '^blog\.') THEN 'blog' WHEN regexp_matches({_HOST}, '^m\.') THEN 'mobile'
WHEN regexp_matches({_HOST}, '\.net$') THEN 'network' ELSE 'other' END AS kind FROM pages""")
def classify_host_rules(spark, d):
    return table(spark, d, "pages").select("page_id", U.classify(F.col("url"), _RULES, fallback=F.lit("other")).alias("kind"))


@query(rf"""SELECT page_id, array_to_string(list_slice(string_split(regexp_replace({_HOST}, '^www\.', ''), '.'), -2, -1), '.') AS domain, count(*) OVER (PARTITION BY {_HOST}) AS on_host FROM pages""")
def registrable_domains(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"), F.count("*").over(W.partitionBy(U.host(F.col("url")))).alias("on_host"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(lower(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]+)"', 1)), '') AS lang,
CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def html_meta_title_links(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", H.title(h).alias("title"), H.language(h).alias("lang"), F.size(H.hrefs(h)).cast("long").alias("links"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>\s*<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<li[^>]*>\s*<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS place, h[i] AS href, l[i] AS label FROM p, unnest(range(1, len(h) + 1)) t(i)""")
def html_list_items(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(H.list_items(F.col("html"))).alias("place", "x")).select("page_id", "place", "x.href", "x.label")


_ENTITIES = "replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>', chr(10), 'g')"""
_LINES = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', '', 'g'), '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
_TO_TEXT = rf"SELECT page_id, regexp_replace({_ENTITIES.format(f'''trim(regexp_replace({_LINES}, '\n{{3,}}', chr(10) || chr(10), 'g'))''')}, '&amp;?', '&', 'g') AS plain FROM pages"


@query(_TO_TEXT)
def html_to_text(spark, d):
    plain = H.unescaped_closed(H.to_text(F.col("html")))
    return table(spark, d, "pages").select("page_id", plain.alias("plain"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_payload_project(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 50")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counts = tumbling_counts(source, "ts", "1 day", ["event_type"], "2 days")
    # each batch replaces its windows' counts in a table of its own folder; the latest batch of a window wins
    job = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/counts")).start()
    job.awaitTermination()
    w = F.max_by("n", "batch")
    return spark.read.parquet(f"{folder}/counts").groupBy("start", "event_type").agg(w.alias("n")).select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")
