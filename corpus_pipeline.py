"""The corpus pipeline: classify, de-duplicate, redact, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``. No stage can be said in SQL as a whole (a fitted classifier,
a fitted mixture, a tokenizer), so ``ORACLE_SQL`` is None and tests compare the
stages with plain Python.
"""

from __future__ import annotations

from tessera.llm import bayes_minhash, contextual_pii, quality_classifier, soft_mixing, tier_packing
from tessera.llm.common import stored, table

#: Shares of the expected tokens of each domain. The budget gives ``prime`` a mean rate of one, and no document is repeated.
WEIGHTS = {"prime": 0.88, "rough": 0.08, "toxic": 0.04}


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return bayes_minhash.keep_first(docs)


def pii(spark, docs, sf_dir):
    """All documents, with personal data replaced by its kind."""
    return contextual_pii.redact(docs)


def mixing(spark, docs, sf_dir):
    """Documents drawn at the rates that bring the domains to their weights."""
    return soft_mixing.mix(docs, soft_mixing.domains(table(spark, sf_dir, "labels")), WEIGHTS, anchor="prime", cap=1.0)


def packing(spark, docs, sf_dir):
    """Pieces of full sequences."""
    return tier_packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage before it is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
