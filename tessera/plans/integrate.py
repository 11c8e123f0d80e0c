"""Bindings with one link for each, purges by provenance and functions for SQL over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import binding, provenance
from tessera.operators.relational import sample_function
from tessera.plans.registry import query, table

_TERMS = """known AS (SELECT s_suppkey AS artist_id, 'web' AS platform, 'w' || s_suppkey AS url FROM supplier UNION ALL SELECT s_suppkey, 'tag', 't' || s_nationkey FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey, 'site', 'site/' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0),
mine AS (SELECT c_custkey AS term_id, 'web' AS platform, 'w' || c_custkey % 200 AS url FROM customer UNION ALL SELECT c_custkey, 'tag', 't' || c_nationkey FROM customer WHERE c_custkey % 3 = 0), site AS (SELECT c_custkey AS term_id, 'site/' || c_custkey % 400 AS url FROM customer)"""


@query(f"""WITH {_TERMS}, hit AS (SELECT term_id, list(DISTINCT artist_id ORDER BY artist_id) AS ids FROM mine JOIN known USING (platform, url) GROUP BY term_id), dec AS (SELECT term_id, url, coalesce(ids, []) AS ids FROM site LEFT JOIN hit USING (term_id)),
bound AS (SELECT term_id, url, ids[1] AS artist_id, 'social_match' AS method FROM dec WHERE len(ids) = 1 UNION ALL SELECT term_id, url, (SELECT max(artist_id) FROM known) + row_number() OVER (ORDER BY term_id), 'seeded_new' FROM dec WHERE len(ids) = 0),
claim AS (SELECT b.*, h.url AS held, coalesce(h.url, first_value(b.url) OVER (PARTITION BY b.artist_id ORDER BY term_id)) AS existing, row_number() OVER (PARTITION BY b.artist_id ORDER BY term_id) AS r FROM bound b LEFT JOIN (SELECT artist_id, min(url) AS url FROM known WHERE platform = 'site' GROUP BY 1) h ON h.artist_id = b.artist_id),
post AS (SELECT DISTINCT unnest([o_custkey, o_custkey + 1]) AS term_id, unnest([o_orderpriority, o_orderpriority]) AS p, month(o_orderdate) AS m FROM orders), tag AS (SELECT artist_id, p AS tag FROM post JOIN bound USING (term_id) UNION SELECT artist_id, 'm' || m FROM post JOIN bound USING (term_id))
SELECT 'bound' AS frame, term_id AS k, artist_id AS id, method AS said FROM bound UNION ALL SELECT 'ambiguous', term_id, NULL, list_aggregate(ids, 'string_agg', ',') FROM dec WHERE len(ids) > 1
UNION ALL SELECT 'links', term_id, artist_id, url FROM claim WHERE held IS NULL AND r = 1 UNION ALL SELECT 'conflicts', term_id, artist_id, url || ' ' || existing FROM claim WHERE url <> existing UNION ALL SELECT 'tags', NULL, artist_id, tag FROM tag""")
def bind_and_fan_out(spark, d):
    """Customers as another site's people, suppliers as known ones, orders as the sets that credit two customers each."""
    c, s, o = (table(spark, d, t) for t in ("customer", "supplier", "orders"))
    cat = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    i, k = F.col("s_suppkey"), F.col("c_custkey")
    of = lambda df, key, name, platform, url: df.select(key.alias(name), F.lit(platform).alias("platform"), url.alias("url"))
    known = of(s, i, "artist_id", "web", cat("w", i)).unionByName(of(s.where("s_suppkey % 10 = 0"), i, "artist_id", "tag", cat("t", F.col("s_nationkey")))).unionByName(of(s.where("s_suppkey % 4 = 0"), i, "artist_id", "site", cat("site/", i)))
    mine = of(c, k, "term_id", "web", cat("w", k % 200)).unionByName(of(c.where("c_custkey % 3 = 0"), k, "term_id", "tag", cat("t", F.col("c_nationkey"))))
    sets = o.select(F.array("o_custkey", F.col("o_custkey") + 1).alias("term_ids"), F.array("o_orderpriority", cat("m", F.month("o_orderdate"))).alias("tags"))
    out = binding.integrate(c.select(k.alias("term_id")), mine, known, sets, "site", cat("site/", F.col("term_id") % 400))
    none = F.lit(None).cast("long")
    said = {
        "bound": (F.col("term_id"), F.col("artist_id"), F.col("method")), "ambiguous": (F.col("term_id"), none, F.array_join("artist_ids", ",")), "links": (F.col("term_id"), F.col("artist_id"), F.col("url")),
        "conflicts": (F.col("term_id"), F.col("artist_id"), F.concat_ws(" ", "url", "existing")), "tags": (none, F.col("artist_id"), F.col("tag")),
    }
    return reduce(DataFrame.unionByName, [out[name].select(F.lit(name).alias("frame"), a.alias("k"), b.alias("id"), x.alias("said")) for name, (a, b, x) in said.items()])


_LINKS = "links AS (SELECT l_suppkey AS owner, l_partkey % 12 AS platform, min(l_orderkey) % 15 AS src FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_LINKS}, gone AS (SELECT s_suppkey AS owner, 3::BIGINT AS source FROM supplier UNION SELECT l.owner, l.platform FROM links l JOIN gone g ON l.owner = g.owner AND l.src = g.source WHERE l.src < 12),
img AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_suppkey) AS owner, min(l_partkey % 12) AS platform FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), del AS (SELECT id FROM img JOIN gone ON gone.owner = img.owner AND gone.source = platform),
art AS (SELECT s_suppkey AS id, (SELECT max(id) FROM img WHERE img.owner = s_suppkey) AS main_image, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS seen_at FROM supplier)
SELECT 'images' AS table, 'delete' AS verb, CAST(id AS VARCHAR) AS id, (SELECT count(*) FROM img) - (SELECT count(*) FROM del) AS left_images, (SELECT count(main_image) FROM art WHERE main_image NOT IN (SELECT id FROM del)) AS left_main FROM del
UNION ALL SELECT 'links', 'delete', owner || '/' || platform, (SELECT count(*) FROM img) - (SELECT count(*) FROM del), (SELECT count(main_image) FROM art WHERE main_image NOT IN (SELECT id FROM del)) FROM links JOIN gone USING (owner) WHERE gone.source = platform
UNION ALL SELECT 'artists', 'null_ref', CAST(id AS VARCHAR), (SELECT count(*) FROM img) - (SELECT count(*) FROM del), (SELECT count(main_image) FROM art WHERE main_image NOT IN (SELECT id FROM del)) FROM art WHERE main_image IN (SELECT id FROM del)
UNION ALL SELECT 'artists', 'reset', CAST(id AS VARCHAR), (SELECT count(*) FROM img) - (SELECT count(*) FROM del), (SELECT count(main_image) FROM art WHERE main_image NOT IN (SELECT id FROM del)) FROM art WHERE seen_at IS NOT NULL""")
def provenance_purge(spark, d):
    """All that one platform brought in, over several steps, with what each verb touches and what is left."""
    lines, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    links = lines.groupBy(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 12).alias("platform")).agg((F.min("l_orderkey") % 15).alias("src"))
    source = F.when(F.col("src") < 12, F.concat(F.lit("harvest:"), F.col("src").cast("string"))).otherwise("submission")
    links = links.select(F.concat_ws("/", F.col("owner").cast("string"), F.col("platform").cast("string")).alias("id"), "owner", "platform", source.alias("source"))
    images = lines.where("l_linenumber <= 2").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_suppkey").alias("owner"), F.min(F.col("l_partkey") % 12).alias("platform"))
    main = images.groupBy("owner").agg(F.max("id").alias("main_image"))
    artists = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("owner"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("seen_at")).join(main, "owner", "left")
    gone = provenance.doomed(links, s.select(F.col("s_suppkey").alias("owner"), F.lit("3").alias("source")))
    V = provenance.Verb  # noqa: N806
    registry = [V("artists", "reset", columns=("seen_at",)), V("artists", "null_ref", columns=("main_image",), target="images"), V("images", "delete", "platform"), V("links", "delete", "platform")]
    after, plan = provenance.purge({"links": links, "images": images, "artists": artists}, registry, gone)
    left = after["images"].agg(F.count("*").alias("left_images")).join(F.broadcast(after["artists"].agg(F.count("main_image").alias("left_main"))))
    return plan.join(F.broadcast(left))


@query("SELECT q, c_custkey, c_name FROM (VALUES (1), (2)) t(q), (SELECT * FROM (SELECT *, md5(c_custkey || 'seed-7') AS h FROM customer) ORDER BY h, c_custkey LIMIT 20)")
def sample_in_sql(spark, d):
    """A set-returning function in SQL, called for each of two rows."""
    table(spark, d, "customer").createOrReplaceTempView("sample_customers")
    sample_function(spark, "sampled_customers", "sample_customers", "c_custkey", ["c_custkey", "c_name"], "seed-7")
    return spark.sql("SELECT q, c_custkey, c_name FROM VALUES (1), (2) AS t(q), LATERAL sampled_customers(20)")
