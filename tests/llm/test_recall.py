"""Recall of the relaxed search where its trees prune: clustered vectors in several cells."""

import numpy as np
import pytest

from tessera.llm import vantage_search

ROWS, DIMENSIONS, CLUSTERS, K = 6000, 12, 60, 20


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(CLUSTERS, DIMENSIONS))
    x = centres[rng.integers(0, CLUSTERS, ROWS)] + 0.25 * rng.normal(size=(ROWS, DIMENSIONS))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    vantage_search.vectors(df).write.parquet(path)
    queries = np.arange(0, ROWS, 20)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    return spark.read.parquet(path), {int(q): set(np.lexsort((np.arange(ROWS), -s))[:K].tolist()) for q, s in zip(queries, score, strict=True)}


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (0.8, 0.9), (0.6, 0.0)])
def test_recall(clustered, factor, least):
    rows, want = clustered
    found = {q: set() for q in want}
    for r in vantage_search.search(rows, rows.where("id % 20 = 0"), K, factor, shard_rows=400, block_queries=128).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = np.mean([len(found[q] & want[q]) / K for q in want])
    print(f"factor {factor}: recall {recall:.4f}")
    assert all(len(v) == K for v in found.values()) and recall >= least
