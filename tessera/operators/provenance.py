"""Removal of all that came from a source: what it brought in, link by link, and verbs for every table that a source feeds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import closure
from tessera.storage import stored

_SEP = "\x01"


@dataclass(frozen=True)
class Verb:
    """What happens to a table: ``delete`` the rows of a doomed owner and source (column ``scope``; all rows of the owner without one),
    ``reset`` the ``columns`` of a doomed owner's rows to null, or ``null_ref`` the ``columns`` that point to rows deleted from ``target``."""

    table: str
    verb: str
    scope: str | None = None
    columns: tuple[str, ...] = ()
    target: str | None = None


def doomed(links: DataFrame, seeds: DataFrame, prefix: str = "harvest:") -> DataFrame:
    """owner and source of all that ``seeds`` (owner, source) brought in: an owner's link (owner, platform, source) whose source is
    ``prefix`` and a doomed platform dooms its own platform. Other sources (given by people, or unknown) are protected: nothing follows from
    them and they doom nothing. Cycles end, as each is visited once."""
    key = lambda owner, platform: F.concat_ws(_SEP, owner.cast("string"), platform.cast("string"))
    from_ = F.substring("source", len(prefix) + 1, 1 << 30)
    edges = links.where(F.col("source").startswith(prefix)).select(key(F.col("owner"), from_).alias("a"), key(F.col("owner"), F.col("platform")).alias("b")).distinct()
    found = closure(seeds.select(key(F.col("owner"), F.col("source")).alias("id")), edges)
    parts = F.split("id", _SEP)
    return found.select(parts[0].cast(links.schema["owner"].dataType).alias("owner"), parts[1].alias("source"), "depth")


def in_order(registry: Iterable[Verb]) -> list[Verb]:
    """Deletions of a table before what clears references to it, resets last."""
    registry = list(registry)
    lost = [v for v in registry if v.verb == "null_ref" and not any(w.table == v.target and w.verb == "delete" for w in registry)]
    if lost or any(v.verb not in ("delete", "null_ref", "reset") for v in registry):
        raise ValueError(f"no deletion or verb for {lost or registry}")
    return sorted(registry, key=lambda v: ("delete", "null_ref", "reset").index(v.verb))


def purge(tables: dict[str, DataFrame], registry: Iterable[Verb], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables after all verbs, the plan: table, verb and id of every row that a verb touches). Tables have id and owner; ``gone`` has owner and source. A row that is deleted is not touched again, and one that already is as a verb would leave it is no part of the plan."""
    gone = stored(gone.select("owner", F.col("source").alias("_source")).distinct(), "gone")
    owners = stored(gone.select("owner").distinct(), "owners")
    after, deleted, plan = dict(tables), {}, None
    for v in in_order(registry):
        df = after[v.table]
        if v.verb == "delete":
            hit = df.join(gone, (df["owner"] == gone["owner"]) & (df[v.scope].cast("string") == gone["_source"]), "left_semi") if v.scope else df.join(owners, "owner", "left_semi")
            touched = stored(hit.select("id").distinct(), "touched")
            deleted[v.table] = touched if v.table not in deleted else deleted[v.table].unionByName(touched)
            after[v.table] = df.join(touched, "id", "left_anti")
        else:
            held = None
            for c in v.columns:
                one = df.where(F.col(c).isNotNull())
                one = one.join(owners, "owner", "left_semi").select("id", F.lit(c).alias("_c")) if v.verb == "reset" else one.join(deleted[v.target].select(F.col("id").alias(c)), c, "left_semi").select("id", F.lit(c).alias("_c"))
                held = one if held is None else held.unionByName(one)
            hits = stored(held.groupBy("id").agg(F.collect_set("_c").alias("_cleared")), "touched")
            touched = hits.select("id")
            after[v.table] = df.join(hits, "id", "left").select(*[F.when(~F.coalesce(F.array_contains("_cleared", c), F.lit(False)), F.col(c)).alias(c) if c in v.columns else F.col(c) for c in df.columns])
        rows = touched.select(F.lit(v.table).alias("table"), F.lit(v.verb).alias("verb"), F.col("id").cast("string").alias("id"))
        plan = rows if plan is None else plan.unionByName(rows)
    return after, plan
