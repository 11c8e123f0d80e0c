"""The stages chained over the smallest tables, each held against a plain answer for its own input."""

import glob
import os
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import queries, quality_classifier, soft_mixing, tier_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def check_quality(spark, before, after):
    good = quality_classifier.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert set(texts(after)) == {r["doc_id"] for r in good.collect()}


def check_near_dedup(spark, before, after):
    own = texts(before)
    assert texts(after) == {i: own[i] for i, (_, c) in brute.near(own.items()).items() if c == i}


def check_pii(spark, before, after):
    out = texts(after)
    for i, t in texts(before).items():
        runs = []
        for kind, a, b in sorted(brute.private(t), key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0]))):
            if runs and a < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], b)
            else:
                runs.append([kind, a, b])
        for kind, a, b in reversed(runs):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        assert out[i] == t  # no context has five seeds here, so the rules' spans are all


def check_mixing(spark, before, after):
    marks = soft_mixing.domains(spark.read.parquet(f"{SF}/labels.parquet"))
    rates = soft_mixing.soft_rates(before, marks, corpus_pipeline.WEIGHTS, anchor="prime", cap=1.0)
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)) < F.col("rate")
    assert set(texts(after)) == {r["doc_id"] for r in rates.where(drawn | (F.col("rate") >= 1)).collect()}


def check_packing(spark, before, after):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tier_packing.default_tokenizer())
    pieces = defaultdict(list)
    for r in after.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, t in texts(before).items():
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for a, n, crc in sorted(pieces[i]):
            assert a == at and zlib.crc32(ids[a : a + n].tobytes()) == crc
            at += n
        assert at == len(ids)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        globals()[f"check_{name}"](spark, docs, after)
        if name != "packing":
            assert after.columns == columns
            sizes.append(after.count())
        docs = after
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    pick = lambda rows, cols: sorted((tuple(r[cols.index(x)] for x in sorted(cols)) for r in rows), key=repr)
    assert pick(df.collect(), df.columns) == pick(want.fetchall(), want.columns)
