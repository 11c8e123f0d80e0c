"""Naive timestamps and JSON records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive(c: Column) -> Column:
    """``2024-05-01T10:00:00`` or with a blank, without zone; null for anything else."""
    found = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.\d+)?$", 0)
    return F.when(found != "", F.try_to_timestamp(F.replace(F.substring(found, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def start_argument(c: Column) -> Column:
    """A date, or a date and time with or without seconds."""
    plain = F.replace(F.trim(c), F.lit("T"), F.lit(" "))
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]).cast("timestamp_ntz")


def rewind(c: Column, days: int) -> Column:
    return c - F.expr(f"INTERVAL {days} DAYS")


def expires(c: Column, hours: int = 48) -> Column:
    return c + F.expr(f"INTERVAL {hours} HOURS")


def post_record(json: Column) -> Column:
    """A post of a content system as a flat struct; missing lists are empty ones."""
    kind = "id long, date string, modified string, link string, title struct<rendered:string>, content struct<rendered:string>, tags array<int>, authors array<struct<term_id:int,slug:string>>"
    p = F.from_json(json, kind)
    none = F.array().cast("array<int>")
    return F.struct(p["id"].alias("post_id"), naive(p["date"]).alias("post_date"), naive(p["modified"]).alias("post_modified"), p["title"]["rendered"].alias("title"), F.coalesce(p["tags"], none).alias("tag_ids"), F.coalesce(F.transform(p["authors"], lambda a: a["term_id"]), none).alias("term_ids"))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def rest_of_object(json: Column, known: tuple[str, ...]) -> Column:
    """A JSON object without the known keys."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*known)))


def date_key(c: Column) -> Column:
    """The day of a time, as text."""
    return F.date_format(c, "yyyy-MM-dd")


def iso_stamp(c: Column) -> Column:
    """A time of UTC with its zone, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown(c: Column) -> Column:
    """A time of UTC as reports show it."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
