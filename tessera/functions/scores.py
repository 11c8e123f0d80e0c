"""Scores of candidates against an entity, as Column expressions. Null means that a signal is not there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, overlap, tokens


def location_score(ours: Column, theirs: Column) -> Column:
    """Shared place words over the fewer words; null without words on either side."""
    return overlap(tokens(ours, 2, STOP_WORDS), tokens(theirs, 2, STOP_WORDS))


def text_coverage(ours: Column, theirs: Column) -> Column:
    """How much of our vocabulary (words of four letters or more) theirs has; null if ours has none."""
    a, b = tokens(ours, 4, STOP_WORDS), tokens(theirs, 4, STOP_WORDS)
    return F.when((F.size(a) > 0) & theirs.isNotNull(), F.size(F.array_intersect(a, b)) / F.size(a))


def popularity_score(popularity: Column, bio_length: Column) -> Column:
    """Very popular candidates for an entity with hardly a biography are doubtful; popularity beyond 70 counts against; at least 0.3, and 1 where it is unknown."""
    fade = F.greatest(1 - F.greatest(F.lit(0), popularity - 70) / 100, F.lit(0.3))
    return F.when(popularity.isNull(), 1.0).when((popularity >= 80) & (bio_length < 100), 0.5).otherwise(fade)


def mean_features(df_features: dict[str, tuple[str, float]]) -> dict[str, Column]:
    """Aggregates name -> mean of a column over its ceiling, 1 at most."""
    return {name: F.least(F.avg(F.col(c) / top), F.lit(1.0)) for name, (c, top) in df_features.items()}


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the text's UTF-8 bytes."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("([0-9A-F]{2})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    # Offset basis and prime of the 32-bit variant.
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def pick_by_day(items: Column, id_: Column, day: str) -> Column:
    """One item of an array, steady for an id over a day."""
    at = fnv1a(F.concat_ws(":", id_.cast("string"), F.lit(day))) % F.size(items)
    return F.when(F.size(items) > 0, F.get(items, at.cast("int")))


def primary_or_first(items: Column, field: str, value: str) -> Column:
    """The first struct whose field has the value, else the first of all."""
    return F.coalesce(F.get(F.filter(items, lambda x: x[field] == value), F.lit(0)), F.get(items, F.lit(0)))


def largest(items: Column, field: str, n: int) -> Column:
    """The n structs with the greatest field."""
    return F.slice(F.array_sort(items, lambda a, b: F.when(a[field] > b[field], -1).when(a[field] < b[field], 1).otherwise(0)), 1, n)
