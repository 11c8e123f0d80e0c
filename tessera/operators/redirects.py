"""Where links lead, from a landed table of answers: hops by pointer doubling, then what each host is trusted with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.urls import bare_host, path
from tessera.storage import release, stored

RULE = "host string, tier string, expect_host string, expect_path string"
# Hosts whose links stand for others. A validated one must lead to its own site, behind the others may be anything.
RULES = [
    ("on.soundcloud.com", "validate", "soundcloud.com", None),
    ("soundcloud.app.goo.gl", "validate", "soundcloud.com", None),
    ("fb.me", "validate", "facebook.com", None),
    ("spotify.link", "validate", "spotify.com", None),
    ("vm.tiktok.com", "validate", "tiktok.com", "^/@[^/]+"),
    ("bit.ly", "reclassify", None, None),
    ("goo.gl", "reclassify", None, None),
    ("tinyurl.com", "reclassify", None, None),
    ("shorturl.at", "reclassify", None, None),
    ("cutt.ly", "reclassify", None, None),
    ("ow.ly", "reclassify", None, None),
    ("rb.gy", "reclassify", None, None),
    ("buff.ly", "reclassify", None, None),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE)


def with_scheme(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c.rlike("(?i)^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def absolute(location: Column, base: Column) -> Column:
    """A Location header seen from the page that sent it; null if it makes no URL."""
    c = F.trim(location)
    root = F.regexp_extract(base, r"^([^:]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:]+://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    out = F.when(c.rlike("(?i)^[a-z][a-z0-9+.-]*:"), c).when(c.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), c)).when(c.startswith("/"), F.concat(root, c)).when(c.startswith("?"), F.concat(root, path(base), c)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), c))
    return F.when(out.rlike(r"(?i)^https?://[^/?#\s]+[^\s]*$"), out)


def answers(landed: DataFrame) -> DataFrame:
    """One row for each URL of ``landed`` (url, status, location, error): where it sends on, or how it ended. A Location that makes no URL is a network error."""
    sends = F.col("status").between(300, 399) & F.col("location").isNotNull()
    to = absolute(F.col("location"), F.col("url"))
    said = landed.where("url is not null").select("url", F.struct(F.when(sends, to).alias("next"), F.col("status").cast("int").alias("status"), F.when(sends & to.isNull(), "network-error").otherwise(F.col("error")).alias("error")).alias("a"))
    return said.groupBy("url").agg(F.min("a").alias("a")).select("url", "a.*")


def follow(urls: DataFrame, steps: DataFrame, max_hops: int) -> DataFrame:
    """url, at and hops: where ``max_hops`` steps (url, next) lead from each of the distinct ``urls`` (url), or fewer if the way ends before.

    Tables of 1, 2, 4 ... steps are made from one another, and those that max_hops is the sum of are taken one after the other."""
    jump = stored(steps.where("next is not null").select("url", F.col("next").alias("to"), F.lit(1).alias("n")), "jumps")
    place = urls.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"))
    left = max_hops
    while left:
        if left & 1:
            here = jump.select(F.col("url").alias("at"), "to", "n")
            place = stored(place.join(here, "at", "left").select("url", F.coalesce("to", "at").alias("at"), (F.col("hops") + F.coalesce("n", F.lit(0))).alias("hops")), "places")
        left >>= 1
        if left:
            on = jump.select(F.col("url").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
            twice = stored(jump.join(on, "to", "left").select("url", F.coalesce("further", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "jumps")
            release(jump)
            jump = twice
    return place


def resolve(links: DataFrame, landed: DataFrame, rules: DataFrame | None = None, max_hops: int = 5) -> DataFrame:
    """For each distinct ``url`` of ``links``: its tier, whether it is resolved, the URL to keep (the given one unless resolved), the destination reached, its status, the hops and, if not resolved, why:

    not-resolvable (no rule for the host), not-landed (the way leads to a URL without an answer), timeout, network-error, no-redirect,
    max-hops (still sent on: a loop or too long a way), dead-destination (400 and above), validation-failed (not the site that the rule expects)."""
    rules = default_rules(links.sparkSession) if rules is None else rules
    asked = links.where("url is not null").select("url").distinct().withColumn("from", with_scheme(F.col("url"))).withColumn("host", bare_host(F.col("from")))
    ruled = stored(asked.join(rules, "host", "left"), "ruled")
    steps = stored(answers(landed), "answers")
    known = ruled.where("tier is not null")
    place = follow(known.select(F.col("from").alias("url")).distinct(), steps, max_hops)
    end = place.join(steps.withColumnRenamed("url", "at"), "at", "left").withColumn("landed", F.col("status").isNotNull() | F.col("error").isNotNull()).withColumnRenamed("url", "from")
    both = ruled.join(end, "from", "left")
    there = bare_host(F.col("at"))
    own_site = (there == F.col("expect_host")) | there.endswith(F.concat(F.lit("."), F.col("expect_host")))
    expected = own_site & (there != F.col("host")) & (F.col("expect_path").isNull() | F.regexp_like(path(F.col("at")), F.col("expect_path")))
    reason = (
        F.when(F.col("tier").isNull(), "not-resolvable").when(~F.col("landed"), "not-landed").when(F.col("error") == "timeout", "timeout").when(F.col("error").isNotNull(), "network-error").when(F.col("hops") == 0, "no-redirect")
        .when(F.col("next").isNotNull(), "max-hops").when(F.col("status") >= 400, "dead-destination").when((F.col("tier") == "validate") & ~F.coalesce(expected, F.lit(False)), "validation-failed")
    )
    judged = both.withColumn("reason", reason)
    seen = ~F.col("reason").isin("not-resolvable", "not-landed", "timeout", "network-error", "no-redirect") | F.col("reason").isNull()
    return judged.select(
        "url", "tier", F.col("reason").isNull().alias("resolved"), F.when(F.col("reason").isNull(), F.col("at")).otherwise(F.trim("url")).alias("kept"), F.when(seen, F.col("at")).alias("destination"),
        F.when(F.col("next").isNull() & F.col("landed"), F.col("status")).alias("final_status"), F.col("hops").cast("int").alias("hops"), "reason",
    )
