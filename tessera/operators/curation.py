"""Composite operators of curation. Each gives planned frames; nothing is written here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import name_score, round4
from tessera.functions.scores import location_score, popularity_score, text_coverage
from tessera.operators.matching import break_ties
from tessera.operators.relational import top_per_key
from tessera.operators.similarity import weighted_available


def resolve_candidates(requests: DataFrame, candidates: DataFrame, weights: dict[str, float], least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(scored candidates with rank, one decision for each request). requests: q, name, place, bio; candidates: q, id, c_name, c_place, c_bio, popularity."""
    both = candidates.join(requests, "q")
    signals = both.withColumns({
        "s_name": name_score(F.col("name"), F.col("c_name")), "s_place": location_score(F.col("place"), F.col("c_place")),
        "s_bio": text_coverage(F.col("bio"), F.col("c_bio")), "s_popularity": popularity_score(F.col("popularity"), F.length(F.coalesce("bio", F.lit("")))),
    }).withColumn("confidence", round4(weighted_available({f"s_{k}": w for k, w in weights.items()})))
    ranked = signals.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("confidence").desc(), "id")))
    return ranked, break_ties(ranked, "q", "confidence", "c_name", "name", "id", least)


def integrate_links(staged: DataFrame, live: DataFrame) -> dict[str, DataFrame]:
    """Staged links (id, owner, platform, url, at) against live ones (owner, platform, url, not_found): exact repeats; for each owner and platform the earliest, and the others; links to insert; those that meet a not-found mark; those that differ from the live one."""
    keys = ["owner", "platform"]
    exact = staged.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "url").orderBy("at", "id")))
    first = top_per_key(exact.where("_r = 1"), keys, [F.col("at"), F.col("id")])
    known = live.select(*keys, F.col("url").alias("live_url"), "not_found")
    met = first.join(known, keys, "left").drop("_r")
    return {
        "repeats": exact.where("_r > 1").select("id"),
        "later": exact.where("_r = 1").join(first.select("id"), "id", "left_anti").select("id"),
        "insert": met.where("not_found is null").select("id", *keys, "url"),
        "not_found": met.where("not_found").select("id", *keys, "url"),
        "mismatch": met.where("not not_found and url <> live_url").select("id", *keys, "url", "live_url"),
    }


def decide_links(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """What becomes of resolved links (id, owner, platform, url, new_platform, new_url): a row keeps its place if nothing changes; a new place (owner, platform) belongs to who holds it, else to the least id that claims it. Places that rows leave in this pass are not free yet."""
    held = rows.select("owner", F.col("platform").alias("new_platform"), F.col("url").alias("held_url"), F.col("id").alias("held_by"))
    held = top_per_key(held, ["owner", "new_platform"], [F.col("held_by")])
    known = platforms.select(F.col("key").alias("new_platform"), F.lit(True).alias("known"))
    out = rows.join(known, "new_platform", "left").join(held, ["owner", "new_platform"], "left")
    moves = (F.col("new_platform") != F.col("platform")) | (F.col("new_url") != F.col("url"))
    claim = F.row_number().over(W.partitionBy("owner", "new_platform").orderBy(F.when(moves, 1).otherwise(0), "id"))
    taken = F.col("held_by").isNotNull() & (F.col("held_by") != F.col("id"))
    decision = F.when(~moves, "unchanged").when(F.col("known").isNull(), "unknown-platform").when(taken & (F.col("held_url") == F.col("new_url")), "duplicate").when(taken, "collision").when(claim > 1, "collision").otherwise("updated")
    return out.select("id", "owner", "platform", "url", "new_platform", "new_url", decision.alias("decision"))


def merge_groups(terms: DataFrame, links: DataFrame, key: Column, canonical: Column) -> dict[str, DataFrame]:
    """Terms (id, name) with an equal key become one: the one with the canonical name, then most links, then the least id. Gives the map of ids, links (owner, term) under it and the terms that go."""
    used = links.groupBy(F.col("term").alias("id")).agg(F.count("*").alias("links"))
    ranked = terms.join(used, "id", "left").fillna(0, ["links"]).withColumns({"_key": key, "_canonical": (F.col("name") == canonical).cast("int")}).where("_key is not null")
    w = W.partitionBy("_key").orderBy(F.col("_canonical").desc(), F.col("links").desc(), "id")
    mapping = ranked.select(F.col("id").alias("old"), F.first("id").over(w).alias("new"))
    moved = links.join(mapping.withColumnRenamed("old", "term"), "term", "left").select("owner", F.coalesce("new", "term").alias("term")).distinct()
    return {"mapping": mapping.where("old <> new"), "links": moved, "gone": mapping.where("old <> new").select(F.col("old").alias("id"))}


def bind_by_slug(things: DataFrame, terms: DataFrame) -> DataFrame:
    """things (id, slug) and terms (term, slug, bound): bind where the slug is unique on both sides and free; else already, conflict, ambiguous or unmatched."""
    a = things.where("slug is not null").groupBy("slug").agg(F.count_distinct("id").alias("things"), F.min("id").alias("id"))
    b = terms.groupBy("slug").agg(F.count("*").alias("terms"))
    out = terms.join(a, "slug", "left").join(b, "slug", "left")
    state = F.when(F.col("things").isNull(), "unmatched").when((F.col("things") > 1) | (F.col("terms") > 1), "ambiguous").when(F.col("bound") == F.col("id"), "already").when(F.col("bound").isNotNull(), "conflict").otherwise("bind")
    return out.select("term", F.when(state == "bind", F.col("id")).alias("id"), state.alias("state"))


def contradictions(decisions: DataFrame, id_: str, action: str) -> DataFrame:
    """Ids with more than one action: must be empty before decisions are applied."""
    return decisions.groupBy(id_).agg(F.count_distinct(action).alias("actions")).where("actions > 1")


def rename_safely(rows: DataFrame, id_: str, owner: str, url: str, bare: Column) -> DataFrame:
    """Rows whose link changes to ``bare``: delete if the owner has the bare link already (or a smaller id brings it), else rename."""
    changed = rows.withColumn("_bare", bare)
    have = rows.select(F.col(owner).alias("_owner"), F.col(url).alias("_bare")).distinct().withColumn("_have", F.lit(True))
    todo = changed.where(F.col("_bare") != F.col(url)).withColumn("_r", F.row_number().over(W.partitionBy(owner, "_bare").orderBy(id_)))
    out = todo.join(have, (todo[owner] == have["_owner"]) & (todo["_bare"] == have["_bare"]), "left").select(todo[id_], todo["_bare"].alias("to"), "_have", "_r")
    return out.select(id_, "to", F.when(F.col("_have") | (F.col("_r") > 1), "delete").otherwise("rename").alias("action"))


def image_work(links: DataFrame, images: DataFrame, failures: DataFrame) -> DataFrame:
    """links (owner, platform, url), images (owner, platform, source), failures (owner, platform, url, definitive): skip what was fetched or failed for good at this link, drop an image whose link changed to one that has none, retry after transient failures, else fetch; images without a link are orphans."""
    keys = ["owner", "platform"]
    all_ = links.join(images, keys, "full").join(failures.select(*keys, F.col("url").alias("failed_url"), "definitive"), keys, "left")
    same = F.col("failed_url").eqNullSafe(F.col("url"))
    action = (
        F.when(F.col("url").isNull(), "orphan").when(F.col("source") == F.col("url"), "skip").when(same & F.col("definitive") & F.col("source").isNotNull(), "drop")
        .when(same & F.col("definitive"), "skip").when(same & ~F.col("definitive"), "retry").otherwise("fetch")
    )
    return all_.select(*keys, action.alias("action"))


def related_edges(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """entities (owner, members, groups of external ids) and ids (external, id): distinct a < b with how often they are named; unknown ones and loops go."""
    named = entities.select("owner", F.explode(F.concat("members", "groups")).alias("external")).join(ids, "external")
    return named.where("owner <> id").select(F.least("owner", "id").alias("a"), F.greatest("owner", "id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def new_aliases(found: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """Names (owner, name) whose key the owner has not; one for each key."""
    fresh = top_per_key(found.withColumn("_key", key).where("_key is not null"), ["owner", "_key"], [F.col("name")])
    return fresh.join(known.withColumn("_key", key).select("owner", "_key"), ["owner", "_key"], "left_anti").select("owner", "name")


def two_key_lookup(rows: DataFrame, dim: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """The value by the first key, else by the second; the second key's least value counts."""
    a = dim.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(value).alias("_a"))
    b = dim.where(F.col(second).isNotNull()).groupBy(second).agg(F.min(value).alias("_b"))
    return rows.join(a, first, "left").join(b, second, "left").select(*rows.columns, F.coalesce("_a", "_b").alias(value))


def search(entities: DataFrame, key: str, aliases: DataFrame | None = None, text: str | None = None, filters: dict | None = None, tags: tuple[DataFrame, str] | None = None, order: str = "name", page: int = 1, size: int = 24) -> DataFrame:
    """A directory page: equal filters, a tag that must be there, and a folded text within the name key or an alias key. One row more than ``size`` tells of a next page."""
    out = entities
    for column, value in (filters or {}).items():
        out = out.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    if tags is not None:
        out = out.join(tags[0].where(F.col("tag") == tags[1]).select(key), key, "left_semi")
    if text:
        hit = F.col("name_key").contains(text)
        if aliases is not None:
            by_alias = aliases.where(F.col("alias_key").contains(text)).select(key).distinct().withColumn("_alias", F.lit(True))
            out = out.join(by_alias, key, "left").where(hit | F.col("_alias")).drop("_alias")
        else:
            out = out.where(hit)
    return out.orderBy(order, key).offset((page - 1) * size).limit(size + 1)


def promote(candidates: DataFrame, links: DataFrame, approved: str = "approved") -> dict[str, DataFrame]:
    """Approved candidates (entity, service, id, confidence, status) for a table of links (entity, service, id): of each entity and service the one of greatest confidence (then least id) is inserted, updates another link or is there already; ``stats`` counts candidates by service and status."""
    best = top_per_key(candidates.where(F.col("status") == approved), ["entity", "service"], [F.col("confidence").desc_nulls_last(), F.col("id")]).select("entity", "service", "id")
    met = best.join(links.select("entity", "service", F.col("id").alias("held")), ["entity", "service"], "left")
    return {
        "insert": met.where("held is null").select("entity", "service", "id"),
        "update": met.where("held <> id").select("entity", "service", "id", "held"),
        "already": met.where("held = id").select("entity", "service", "id"),
        "stats": candidates.groupBy("service", "status").agg(F.count("*").alias("n")),
    }


def migrate_links(pairs: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """What becomes of the link of each duplicate when it moves to the entity that survives: pairs (row, source, target), entities (id, status, deleted), links (id, url). One action a row: skipped with a note, conflict, or copy. Of rows that bring a link to one target the first counts, and later ones meet its link."""
    e = lambda side: entities.select(F.col("id").alias(side), F.col("status").alias(f"{side}_status"), F.col("deleted").alias(f"{side}_deleted"), F.lit(True).alias(f"{side}_there"))
    u = lambda side: links.select(F.col("id").alias(side), F.col("url").alias(f"{side}_url"), F.lit(True).alias(f"{side}_linked"))
    rows = pairs.withColumn("_again", F.row_number().over(W.partitionBy("source", "target").orderBy("row")) > 1)
    for side in ("source", "target"):
        rows = rows.join(e(side), side, "left").join(u(side), side, "left")
    barred = (
        F.when(F.col("_again"), "repeated pair").when(F.col("source") == F.col("target"), "same entity").when(F.col("target_there").isNull(), "no target").when(F.col("target_deleted"), "target deleted")
        .when(F.col("source_there").isNull(), "no source").when(F.col("source_status") != "duplicate", "source is no duplicate").when(F.col("source_linked").isNull(), "no link to copy")
    )
    free = rows.withColumn("_barred", barred)
    bringing = F.col("_barred").isNull() & F.col("target_linked").isNull()
    first = F.first(F.when(bringing, F.col("source_url")), ignorenulls=True).over(W.partitionBy("target").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    met = free.withColumn("_met", F.coalesce("target_url", first))
    action = F.when(F.col("_barred").isNotNull(), "skipped").when(F.col("_met").isNull(), "copy").when(F.col("_met") == F.col("source_url"), "skipped").otherwise("conflict")
    note = F.coalesce("_barred", F.when(F.col("_met") == F.col("source_url"), "already there").when(F.col("_met").isNotNull(), "another link"))
    return met.select("row", "source", "target", F.when(F.col("_barred").isNull(), F.col("source_url")).alias("url"), action.alias("action"), note.alias("note"))


def apply_decisions(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """Sheet decisions (id, action, value) against rows (id, value): each row once, as contradicted (several answers for one id), unknown (no such row), satisfied (it has the value) or apply."""
    answers = decisions.groupBy("id").agg(F.count_distinct("action", F.coalesce("value", F.lit(""))).alias("_answers"), F.min(F.struct("action", "value")).alias("_one"))
    met = answers.join(current.select("id", F.col("value").alias("held"), F.lit(True).alias("_there")), "id", "left")
    state = F.when(F.col("_answers") > 1, "contradicted").when(F.col("_there").isNull(), "unknown").when(F.col("held").eqNullSafe(F.col("_one.value")), "satisfied").otherwise("apply")
    single = F.col("_answers") == 1
    return met.select("id", F.when(single, F.col("_one.action")).alias("action"), F.when(single, F.col("_one.value")).alias("value"), state.alias("state"))


def term_report(terms: DataFrame, links: DataFrame, staged: DataFrame, names: DataFrame, aliases: dict[str, str], broad: tuple[str, ...], reason: Column, key: Column) -> DataFrame:
    """Each term (id, name) with its links (term), staged links (term), the alias it should merge into, whether it is too broad, and why it may be no term: ``reason``, else that an entity (names: name) is called so."""
    many = lambda f, n: f.where("term is not null").groupBy(F.col("term").alias("id")).agg(F.count("*").alias(n))
    called = names.select(key.alias("_key")).where("_key is not null").distinct().withColumn("_called", F.lit(True))
    alias = F.lit(None).cast("string")
    for said, meant in sorted(aliases.items(), reverse=True):
        alias = F.when(F.col("_key") == said, meant).otherwise(alias)
    out = terms.withColumn("_key", key).join(many(links, "links"), "id", "left").join(many(staged, "staged"), "id", "left").join(called, "_key", "left")
    why = F.when(reason != "", reason).when(F.col("_called"), "entity name").otherwise("")
    is_broad = F.coalesce(F.col("_key").isin(*broad), F.lit(False))
    return out.select("id", "name", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("staged", F.lit(0)).alias("staged"), F.when(~is_broad & (alias != F.col("_key")), alias).alias("merge_into"), is_broad.alias("broad"), why.alias("reason"))


def credits(releases: DataFrame, various: tuple[int, str] = (194, "various")) -> DataFrame:
    """Releases (release, artists, tracks: arrays of structs id and name, fallback) to one row for each credit, with its place: blank names go, an artist counts once by id, else by name; a release of nobody but ``various`` credits its tracks' artists; without any credit the fallback stands."""

    def named(items: Column) -> Column:
        items = F.transform(F.coalesce(items, F.array().cast("array<struct<id:long,name:string>>")), lambda x: F.struct(x["id"].cast("long").alias("id"), F.trim(x["name"]).alias("name")))
        items = F.filter(items, lambda x: F.coalesce(x["name"], F.lit("")) != "")
        keys = F.transform(items, lambda x: F.when(x["id"] > 0, F.concat(F.lit("id:"), x["id"].cast("string"))).otherwise(F.concat(F.lit("name:"), F.lower(x["name"]))))
        first = F.transform(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.filter(items, lambda x, i: F.get(first, i))

    own, tracks = named(F.col("artists")), named(F.col("tracks"))
    lone = F.get(own, F.lit(0))
    nobody = (F.size(own) == 1) & ((lone["id"] == various[0]) | (F.lower(lone["name"]) == various[1]))
    stand_in = F.array(F.struct(F.lit(None).cast("long").alias("id"), F.trim(F.coalesce("fallback", F.lit(""))).alias("name")))
    chosen = F.when(nobody & (F.size(tracks) > 0), tracks).when(F.size(own) > 0, own).otherwise(stand_in)
    return releases.select("release", F.posexplode(chosen).alias("place", "c")).select("release", "place", "c.id", "c.name")


def patch_groups(patches: DataFrame, id_: str, size: int = 500, sets: str | None = None) -> DataFrame:
    """Rows (id and the columns to set) as batches of at most about ``size`` ids that take the same patch: patch (JSON), batch, ids. A null
    value is a patch that sets null; a column that a row leaves alone is not in the array of names ``sets``. Hashes deal a patch's ids to
    batches, so no patch gathers in one task."""
    columns = [c for c in patches.columns if c not in (id_, sets)]
    field = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)
    fields = F.array(*[F.when(F.array_contains(sets, c), field(c)) if sets else field(c) for c in columns])
    said = patches.select(id_, F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("patch"))
    sizes = said.groupBy("patch").agg(F.ceil(F.count("*") / size).alias("_batches"))
    dealt = said.join(sizes, "patch").withColumn("batch", F.pmod(F.xxhash64(id_), "_batches"))
    return dealt.groupBy("patch", "batch").agg(F.sort_array(F.collect_list(id_)).alias("ids"))


def audit(frames: dict[str, DataFrame], id_: str, run: str) -> DataFrame:
    """One frame of what a run plans or did: run, action (the frame's name) and id."""
    parts = [f.select(F.lit(run).alias("run"), F.lit(action).alias("action"), F.col(id_).cast("string").alias("id")) for action, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
