"""Upserts, remaps and diffs as functions to the desired state; writers are apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import closure
from tessera.operators.relational import numbered, top_per_key
from tessera.storage import stored


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def replace_all(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows win with all their columns; of those with an equal key the first by ``order`` (by default the greatest by its other columns); old rows without a new one stay."""
    rest = order or [F.col(c).desc_nulls_last() for c in new.columns if c not in keys] or [F.lit(0)]
    return top_per_key(new, keys, rest).unionByName(old.join(new.select(*keys), keys, "left_anti"))


def keep_existing(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows win; of new rows with an equal key the first by ``order`` comes in."""
    return old.unionByName(top_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti"))


def keep_unless_given(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new null leaves the old value."""
    rest = [c for c in old.columns if c not in keys]
    both = new.alias("n").join(old.alias("o"), _same("n", "o", keys), "full")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*keys, *rest]])


def keep_decisions(old: DataFrame, new: DataFrame, keys: list[str], status: str, decided: tuple[str, ...]) -> DataFrame:
    """New rows win, but a status that people decided stays."""
    before = old.select(*keys, F.col(status).alias("_old"))
    marked = new.join(before, keys, "left").withColumn(status, F.when(F.col("_old").isin(*decided), F.col("_old")).otherwise(F.col(status))).drop("_old")
    return replace_all(old, marked.select(*old.columns), keys)


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))


def replace_children(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """All children of touched parents are the new ones; a touched parent may end with none."""
    return old.join(touched.select(parent), parent, "left_anti").unionByName(new)


def remember_original(df: DataFrame, url: str, original: str, changed: Column) -> DataFrame:
    """Put ``changed`` into ``url``; the first value it ever had stays in ``original``."""
    differs = ~changed.eqNullSafe(F.col(url))
    return df.withColumn(original, F.when(differs, F.coalesce(F.col(original), F.col(url))).otherwise(F.col(original))).withColumn(url, changed)


def remap(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Ids through a map (old, new); ids that it lacks stay."""
    return df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def repoint_edges(edges: DataFrame, a: str, b: str, mapping: DataFrame) -> DataFrame:
    """Both ends through a map; loops and edges that become equal go."""
    return remap(remap(edges.select(a, b), a, mapping), b, mapping).where(F.col(a) != F.col(b)).select(a, b).distinct()


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with status added, removed, changed or same."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    equal = reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in rest], F.lit(True))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(equal, "same").otherwise("changed")
    return o.join(n, _same("o", "n", keys), "full").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], status.alias("status"))


def winners(df: DataFrame, group: str, id_: str, order: list[Column]) -> DataFrame:
    """old -> new for every row of a group: the group's first id by ``order``."""
    first = top_per_key(df, [group], order).select(group, F.col(id_).alias("new"))
    return df.select(group, F.col(id_).alias("old")).join(first, group).select("old", "new")


def survivors(df: DataFrame, group: str, id_: str, rank: list[Column]) -> DataFrame:
    """Each row of groups of two or more: survivor, or duplicate with the id that survives; chains can't arise."""
    many = df.join(df.groupBy(group).count().where("count > 1"), group, "left_semi")
    to = winners(many, group, id_, rank)
    return to.select(F.col("old").alias(id_), F.when(F.col("old") == F.col("new"), "survivor").otherwise("duplicate").alias("role"), F.when(F.col("old") != F.col("new"), F.col("new")).alias("survivor_id"))


def new_ids(df: DataFrame, start: DataFrame, id_: str, key: str) -> DataFrame:
    """Keys that ``start`` lacks get ids after its greatest, in the order of the keys."""
    top = start.agg(F.coalesce(F.max(id_), F.lit(0)).alias("top")).first()["top"]
    fresh = df.select(key).distinct().join(start.select(key), key, "left_anti")
    return numbered(fresh, [key], "_n").select(key, (F.col("_n") + top).alias(id_))


def refresh_count(stats: DataFrame, key: str, rows: DataFrame, step: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the table of counters (key, value, exact, updated) with the number of ``rows`` under ``key``, rounded down to ``step``; one row with that value, as the caller gets it)."""
    exact = rows.agg(F.count("*").alias("exact"))
    now = exact.select(F.lit(key).alias("key"), (F.floor(F.col("exact") / step) * step).alias("value"), "exact", F.current_timestamp().alias("updated"))
    return stats.where(F.col("key") != key).unionByName(now.select(*[F.col(c).cast(stats.schema[c].dataType).alias(c) for c in stats.columns])), now.select("value")


def delete_with_references(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (each with id) after the rows of ``gone`` (table -> frame of ids) are deleted and all ``references`` (table, column,
    target, action) kept: rows that point to a deleted one go too (``cascade``), lose the pointer (``set null``) or forbid the deletion
    (``restrict``, an error). References form no cycle between tables."""
    deleted = {name: stored(df.select("id").distinct(), "deleted") for name, df in gone.items()}
    waiting, order = set(tables), []
    while waiting:
        ready = sorted(t for t in waiting if not any(child == t and target in waiting and target != t for child, _, target, _ in references))
        if not ready:
            raise ValueError("references form a cycle")
        order += ready
        waiting -= set(ready)
    out = {}
    for name in order:
        df = tables[name]
        mine = [(column, target, action) for child, column, target, action in references if child == name and (target in deleted or target == name)]
        for column, target, action in mine:
            if action == "cascade":
                if target == name:  # a tree within one table: children of deleted rows, level by level
                    edges = df.where(F.col(column).isNotNull()).select(F.col(column).alias("a"), F.col("id").alias("b"))
                    more = closure(deleted[name], edges).select("id") if name in deleted else None
                else:
                    more = df.join(deleted[target].select(F.col("id").alias(column)), column, "left_semi").select("id")
                if more is not None:
                    deleted[name] = stored((more if name not in deleted else more.unionByName(deleted[name])).distinct(), "deleted")
        if name in deleted:
            df = df.join(deleted[name], "id", "left_anti")
        for column, target, action in mine:
            if action != "cascade" and target in deleted:
                hit = deleted[target].select(F.col("id").alias(column), F.lit(True).alias("_hit"))
                found = df.join(hit, column, "left")
                if action == "restrict" and not found.where("_hit").isEmpty():
                    raise ValueError(f"{name}.{column} still points to deleted rows of {target}")
                df = found.select(*[F.when(F.col("_hit").isNull(), F.col(column)).alias(column) if c == column else F.col(c) for c in df.columns])
        out[name] = df
    return out
