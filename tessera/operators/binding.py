"""Binding of another site's people to known ones: matches by links, new entries for the rest, one link of the site for each, and what follows for their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.matching import decide
from tessera.operators.relational import numbered
from tessera.storage import stored


def integrate(terms: DataFrame, term_links: DataFrame, known_links: DataFrame, sets: DataFrame, site: str, site_url: Column) -> dict[str, DataFrame]:
    """Planned frames for ``terms`` (term_id and what ``site_url`` needs), whose links (term_id, platform, url) are looked up among known ones (artist_id, platform, url):

    * bound: term_id, artist_id, method; ``social_match`` where all found links lead to one artist, ``seeded_new`` where none is found,
      with ids after the largest known one, in order of term_id;
    * ambiguous: term_id and the sorted array of artist_ids where links lead to several;
    * links: the site's link (artist_id, url, term_id) for artists that have none; of several terms of an artist the least one's;
    * conflicts: term_id, artist_id, url and the existing one where the artist has another link of the site, as one is all it may have;
    * tags: artist_id and tag of all ``sets`` (term_ids and tags, arrays) that credit a bound term, each once.
    """
    mine = term_links.where(F.col("platform") != site).select("term_id", "platform", "url").distinct()
    hits = mine.join(known_links.select("artist_id", "platform", "url").distinct(), ["platform", "url"]).groupBy("term_id").agg(F.sort_array(F.collect_set("artist_id")).alias("artist_ids"))
    found = terms.select("term_id", site_url.alias("url")).join(hits, "term_id", "left")
    decided = stored(found.withColumn("artist_ids", F.coalesce("artist_ids", F.array().cast(hits.schema["artist_ids"].dataType))).withColumn("outcome", decide(F.col("artist_ids"))), "decided")
    last = known_links.agg(F.coalesce(F.max("artist_id"), F.lit(0)).alias("last"))
    seeds = numbered(decided.where("outcome = 'seed'").select("term_id", "url"), ["term_id"], "place").join(F.broadcast(last))
    new = seeds.select("term_id", "url", (F.col("last") + F.col("place")).alias("artist_id"), F.lit("seeded_new").alias("method"))
    old = decided.where("outcome = 'bind'").select("term_id", "url", F.col("artist_ids")[0].alias("artist_id"), F.lit("social_match").alias("method"))
    bound = stored(old.unionByName(new), "bound")
    held = known_links.where(F.col("platform") == site).groupBy("artist_id").agg(F.min("url").alias("held"))
    first = F.first("url").over(W.partitionBy("artist_id").orderBy("term_id"))
    claims = stored(bound.join(held, "artist_id", "left").withColumn("existing", F.coalesce("held", first)).withColumn("claim", F.row_number().over(W.partitionBy("artist_id").orderBy("term_id"))), "claims")
    credits = sets.select(F.explode(F.array_distinct("term_ids")).alias("term_id"), "tags").join(bound.select("term_id", "artist_id"), "term_id")
    return {
        "bound": bound.select("term_id", "artist_id", "method"),
        "ambiguous": decided.where("outcome = 'ambiguous'").select("term_id", "artist_ids"),
        "links": claims.where("held is null and claim = 1").select("artist_id", "url", "term_id"),
        "conflicts": claims.where("url <> existing").select("term_id", "artist_id", "url", "existing"),
        "tags": credits.select("artist_id", F.explode("tags").alias("tag")).where("tag is not null").distinct(),
    }
