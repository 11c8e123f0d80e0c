"""Operator 7: quality rules with cross-document line frequency (DataFrame functions only).

Normalised lines are hashed, the distinct documents of each host that hold a
line are counted, lines above the limits are taken out, and documents with too
little left are rejected, besides those that fail the base rules.

A line is removed when more than ``least_docs`` documents and more than
``share`` of its host's documents hold it. Documents of equal text count as one,
so copies do not condemn each other. A document is rejected when less than
``least_left`` of its line characters remain.

Defined cases: null texts have no words and fail; a null or missing host is a
host of its own; repeated rows are judged each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_or_empty

LEAST_DOCS = 20
SHARE = 0.01
LEAST_LEFT = 0.3
PLACE_BITS = 20
GAP = r"[\x20\x09-\x0D]+"


def repeated_words(word_hashes: Column) -> Column:
    """How many words lie in 5-word windows that occur twice or more in the text."""
    n = F.size(word_hashes) - 4
    windows = F.transform(F.arrays_zip(*[F.slice(word_hashes, k + 1, n) for k in range(5)]), lambda w: F.xxhash64(w))
    return F.when(n >= 2, windows)


def _covered(windows: Column) -> Column:
    """Words covered by the windows whose hash occurs again: sort, compare neighbours, add up gaps of at most five."""
    n = F.size(windows)
    order = F.array_sort(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(1), n).alias("i")))
    nulls = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(order.alias("own"), F.concat(nulls, order).alias("before"), F.concat(F.slice(order, 2, n), nulls).alias("after"))
    again = F.filter(beside, lambda x: (x["own"]["h"] == x["before"]["h"]) | (x["own"]["h"] == x["after"]["h"]))
    return _union_length(F.array_sort(F.transform(again, lambda x: x["own"]["i"])))


def _union_length(at: Column) -> Column:
    """Words in windows of five that start at rising places."""
    return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-9).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(5), i - a["last"])).cast("int").alias("sum"), i.alias("last")), lambda a: a["sum"])


def _keys(windows: Column) -> Column:
    """The windows' hashes with their last PLACE_BITS replaced by their places, in order: whole numbers sort much faster than structs."""
    return F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))))


def _covered_by_keys(order: Column, windows: Column) -> Column:
    """Like ``_covered``, from the keys; that one decides where places don't fit or different hashes look alike here. Both arguments are columns."""
    place = lambda k: k.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    alike = lambda k, other: F.shiftright(k.bitwiseXOR(other), PLACE_BITS) == 0
    again = F.filter(order, lambda k, j: alike(k, F.get(order, j + 1)) | alike(k, F.get(order, j - 1)))
    unsure = F.filter(order, lambda k, j: alike(k, F.get(order, j + 1)) & (F.get(windows, place(k)) != F.get(windows, place(F.get(order, j + 1)))))
    quick = _union_length(F.sort_array(F.transform(again, place)))
    return F.when((F.size(windows) < (1 << PLACE_BITS)) & (F.size(unsure) == 0), quick).otherwise(_covered(windows))


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: the base counts, the host, a hash of the text and (hash, characters) of its lines."""
    whose = F.coalesce(F.col(host).cast("string"), F.lit("")) if host in docs.columns else F.lit("")
    a = docs.select("doc_id", whose.alias("host"), text_or_empty().alias("text"))
    b = a.select("doc_id", "host", "text", F.array_remove(F.split("text", GAP, -1), "").alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    c = b.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
        F.transform("l", lambda x: F.struct(F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[0-9]+", "0"), GAP, " ")).alias("h"), F.length(x).alias("n"))).alias("lines"),
    )
    d = c.withColumn("win", repeated_words(F.col("wh"))).drop("wh")
    e = d.withColumn("order", F.when(F.size(F.array_distinct("win")) < F.size("win"), _keys(F.col("win"))))
    repeats = F.when(F.col("order").isNotNull(), _covered_by_keys(F.col("order"), F.col("win"))).otherwise(0)
    return e.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"), "lines", F.monotonically_increasing_id().alias("row"))


def judge(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The base counts of every row, base_failed, the share of line characters that remains, and kept."""
    own = stored(statistics(docs, host), "op7-own")
    lines = own.select("row", "host", "text_hash", F.explode("lines").alias("l")).select("row", "host", "text_hash", F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    held = lines.groupBy("host", "h").agg(F.countDistinct("text_hash").alias("docs")).where(F.col("docs") > least_docs)
    of_host = own.groupBy("host").agg(F.countDistinct("text_hash").alias("all"))
    common = stored(held.join(of_host, "host").where(F.col("docs") > share * F.col("all")).select("host", "h"), "op7-common")  # stored, so that Spark can split a hot line in the next join
    taken = lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("taken"))
    whole = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    left = F.when(whole > 0, 1 - F.coalesce("taken", F.lit(0)) / whole).otherwise(1.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return own.join(taken, "row", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (left >= least_left)).alias("kept"), left.alias("left_share"))
