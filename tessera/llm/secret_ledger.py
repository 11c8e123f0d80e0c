"""Operator 6: secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a document is named by the SHA-256 of its text. The ledger is a
table of findings by blob, partitioned by rule version, to which runs append.
Digests alone are compared with it; only blobs that it lacks for the current rules
are scanned, each in one of the rows that hold it, where that row is read. Findings
are then joined back to all rows (paths) that hold the blob.

A rule's matches split a text into gaps and hits, and a running sum of their
lengths in code points gives the spans, so texts never leave the JVM.

Defined cases: null texts are empty blobs; repeated rows get their blob's
findings each; rows with a null doc_id are reported; extra columns are ignored;
an empty table gives an empty result and no ledger rows. ``docs`` must read the same
rows in the same order each time, as a stored table does.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import release, scratch, stored, text_or_empty
from tessera.storage import exists

#: Kind, pattern, group whose length counts, least length. Fixed values.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]++", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
#: Row numbers that are sent to all tasks at most.
FEW = 1 << 20
FINDINGS = "array<struct<start:int,kind_no:int,end:int>>"
LEDGER = f"sha binary, findings {FINDINGS}, rule_version string"


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.length(x))


def _matches(pattern: str, group: int) -> Column:
    """Lengths of gaps, hits and counted groups; null where nothing matches."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all("text", p, F.lit(0))
    counted = F.regexp_extract_all("text", p, F.lit(group))
    return F.when(F.col("text").rlike(pattern), F.arrays_zip(_lengths(F.split("text", pattern, -1)).alias("gap"), _lengths(hits).alias("hit"), _lengths(counted).alias("n")))


def scan(texts: DataFrame, unseen: DataFrame) -> DataFrame:
    """Ledger rows of ``unseen`` (row, sha), from the ``texts`` (row, text) of these rows."""
    raw = stored(texts.select("row", *[_matches(p, g).alias(kind) for kind, p, g, _ in RULES]), "op6-scan")
    parts = [raw.where(F.col(kind).isNotNull()).select("row", F.lit(k).alias("kind_no"), F.lit(least).alias("least"), F.posexplode(kind).alias("i", "m")) for k, (kind, _, _, least) in enumerate(RULES)]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    upto = F.sum(F.col("m.gap") + F.coalesce("m.hit", F.lit(0))).over(W.partitionBy("row", "kind_no").orderBy("i"))
    spans = rows.withColumn("end", upto.cast("int")).where("m.n >= least").select("row", F.struct((F.col("end") - F.col("m.hit")).alias("start"), "kind_no", "end").alias("f"))
    found = spans.groupBy("row").agg(F.sort_array(F.collect_list("f")).alias("findings"))
    return unseen.join(found, "row", "left").select("sha", F.coalesce("findings", F.expr("array()").cast(FINDINGS)).alias("findings"), F.lit(RULE_VERSION).alias("rule_version"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's pairs of the current rules; none where there is no ledger yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).where(F.col("rule_version") == RULE_VERSION)


def unseen_rows(docs: DataFrame, ledger: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id and sha of every row; row and sha of one row for each blob that the ledger lacks), both stored."""
    keys = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("sha")), "op6-keys")
    once = keys.groupBy("sha").agg(F.min("row").alias("row"))
    return keys, stored(once.join(read_ledger(docs.sparkSession, ledger).select("sha"), "sha", "left_anti").select("row", "sha"), "op6-unseen")


def texts_of(docs: DataFrame, unseen: DataFrame, rows: int | None = None) -> DataFrame:
    """row and text of the unseen blobs; ``rows`` is the number of ``docs``, if known. Where the ledger has nearly all, the few row numbers (FEW at most, 8 bytes each) are sent to the texts; else both sides are shuffled, at every size."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    wanted = stored(unseen.select("row"), "op6-rows")
    n = wanted.count()
    few = n <= FEW and 20 * n <= (docs.count() if rows is None else rows)
    return texts.join(F.broadcast(wanted) if few else wanted.hint("merge"), "row", "left_semi")


def update(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, sha and findings of every row of ``docs``; the blobs that the table at the path ``ledger`` lacked are appended to it (a table of this run's own by default)."""
    spark = docs.sparkSession
    ledger = ledger or f"{scratch(spark)}/op6-ledger-{uuid.uuid4().hex}"
    keys, unseen = unseen_rows(docs, ledger)
    scan(texts_of(docs, unseen, keys.count()), unseen).write.mode("append").partitionBy("rule_version").parquet(ledger)
    current = read_ledger(spark, ledger).where(F.size("findings") > 0).select("sha", "findings")
    release(unseen)
    return keys.join(current, "sha", "left").select("doc_id", "sha", F.coalesce("findings", F.expr("array()").cast(FINDINGS)).alias("findings"))


def report(paths: DataFrame) -> DataFrame:
    """The digest columns of ``update``'s result; the ledger adds no spans to the base ones."""
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", F.get(kinds, f["kind_no"]), f["start"], f["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind_no"] == k)).cast("long")

    return paths.select("doc_id", *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(RULES)], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
