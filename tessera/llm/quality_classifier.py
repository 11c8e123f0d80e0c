"""Operator 10: a kernel quality classifier by random Fourier features.

Statistics of each whole text are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel; the standardised statistics stand
beside them as linear terms. Each task sums its part of the normal equations of
each fold; their sum gives ridge weights. Isotonic regression over score bins turns
ridge scores into probabilities; it is fitted on scores that each fold gets from the
weights of the other folds.

Defined cases: null texts count as empty, and empty texts get a score; a null
doc_id belongs to fold -1, is scored and never learnt from; repeated rows are
scored each; labels that repeat are averaged, null labels are ignored; without
labels of both classes every score is the smoothed share of label 1 (0.5 for
none). Columns besides doc_id and text are carried by ``keep_good`` and else
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytetext import per_row, slices, words
from tessera.llm.common import free_names, stored

FEATURES = 256
RIDGE = 1.0
BINS = 2000
THRESHOLD = 0.3
SEED = 7

#: Byte classes: lower, upper, digit, space, line feed, stops, symbols, brackets and quotes, other ASCII, beyond ASCII.
N_CLASS = 10
_CLASS = np.full(256, 8, np.int64)
_CLASS[128:] = 9
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:!?", b"#*$%&|<>^~=+@\\/_", b"()[]{}\"'`")):
    _CLASS[list(_chars)] = _k
N_STATS = 25


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of N_STATS numbers for each text."""
    n = len(starts) - 1
    size = np.diff(starts).astype(float)
    some = np.maximum(size, 1)
    rows = np.repeat(np.arange(n), np.diff(starts))
    share = np.bincount(rows * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS) / some[:, None] if len(data) else np.zeros((n, N_CLASS))
    row, first, after, code = words(data, starts)
    count = np.bincount(row, minlength=n).astype(float)
    length = (after - first).astype(float)
    many = np.maximum(count, 1)
    mean = per_row(length, row, n) / many
    spread = np.sqrt(np.maximum(per_row(length**2, row, n) / many - mean**2, 0))
    short = per_row(length <= 3, row, n) / many
    long = per_row(length >= 12, row, n) / many
    single = per_row(length == 1, row, n) / many
    kind = _CLASS[data]
    odd_end = per_row((kind[after - 1] == 6) & (length > 1), row, n) / many if len(row) else np.zeros(n)
    capital = per_row(kind[first] == 1, row, n) / many if len(row) else np.zeros(n)
    order = np.lexsort((code, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = per_row(fresh, row[order], n)
    run = np.diff(np.append(np.flatnonzero(fresh), len(order))) if len(order) else np.zeros(0)
    top = np.zeros(n)
    if len(order):
        np.maximum.at(top, row[order][fresh], run)
    pair_same = np.zeros(n)
    if len(row) > 4:
        # the share of 5-word windows that repeat in their text
        inside = row[4:] == row[:-4]
        window = np.zeros(len(row) - 4, np.uint64)
        for k in range(5):
            window = window * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - 4 + k]
        window, at = window[inside], row[4:][inside]
        o = np.lexsort((window, at))
        same = (window[o][1:] == window[o][:-1]) & (at[o][1:] == at[o][:-1]) if len(o) else np.zeros(0, bool)
        pair_same = per_row(same, at[o][1:], n) / many
    twice = np.flatnonzero((code[1:] == code[:-1]) & (row[1:] == row[:-1]))
    lines = share[:, 4] * some + 1
    return np.column_stack([
        np.log1p(size), np.log1p(count), share, mean, spread, short, long, single, odd_end, capital,
        distinct / np.sqrt(many), top / many, pair_same, np.log1p(size / lines), np.log1p(lines), np.bincount(row[twice], minlength=n) / many,
    ])


@F.arrow_udf(T.BinaryType())
def stats_of(text: pa.Array) -> pa.Array:
    """N_STATS float32 as binary of each text; only texts pass to Python."""
    out = []
    for _, data, starts in slices(pa.RecordBatch.from_arrays([text], ["text"])):
        out += [r.tobytes() for r in np.nan_to_num(statistics(data, starts)).astype("<f4")]
    return pa.array(out, pa.binary())


def with_stats(docs: DataFrame, fold: str = "fold", stats: str = "stats") -> DataFrame:
    """``docs`` with the fold (crc32 of doc_id as text, mod 5; -1 for null) and the statistics of every row."""
    number = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(-1)).cast("int")
    return docs.select(*docs.columns, number.alias(fold), stats_of(F.col("text").cast("string")).alias(stats))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), N_STATS).astype(float)


@dataclass
class Model:
    """All that scoring needs; its size depends on FEATURES and BINS alone."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.phase) * np.sqrt(2 / FEATURES), z / 8, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising values by pooling adjacent bins; each pool's value is smoothed by half a label of either class."""
    pools: list[list[float]] = []
    for a, w, t in zip(at, weight, total, strict=True):
        pools.append([a * w, w, t])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    knots = np.array([p[0] / p[1] for p in pools])
    values = np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])
    return knots, np.maximum.accumulate(values)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from the labelled rows of ``stats`` (doc_id, fold, stats) whose fold is 1 to 4."""
    marks = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    train = stored(stats.where("fold > 0").join(marks, "doc_id").select("fold", "stats", "y"), "op10-train")
    tally = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((N_STATS, FEATURES)) / np.sqrt(N_STATS)
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), w, phase, np.zeros(FEATURES + N_STATS + 1), np.zeros(1), np.zeros(1))
    ones, all_ = tally.get(1.0, 0), sum(tally.values())
    model.values = np.array([(ones + 0.5) / (all_ + 1)])
    if ones in (0, all_):
        return model

    def moments(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("stats"))
                yield pa.RecordBatch.from_pydict({"i": np.arange(N_STATS), "n": np.full(N_STATS, float(len(x))), "s": x.sum(0), "q": (x**2).sum(0)})

    m = train.select("stats").mapInArrow(moments, "i long, n double, s double, q double").groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("i").collect()
    n, s, q = (np.array([r[k] for r in m]) for k in (1, 2, 3))
    model.mean, model.scale = s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-6))

    def normal(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, x, y = b.column("fold").to_numpy(), matrix(b.column("stats")), b.column("y").to_numpy()
            for f in np.unique(fold):
                z = model.fourier(x[fold == f])
                sums[int(f)] = sums.get(int(f), 0) + z.T @ np.column_stack([z, y[fold == f]])
        for f, a in sums.items():
            yield pa.RecordBatch.from_pydict({"fold": np.full(len(a), f, np.int32), "i": np.arange(len(a)), "row": [r.tobytes() for r in a]})

    def total(key, part):
        rows = np.frombuffer(b"".join(part.column("row").to_pylist()), float).reshape(part.num_rows, -1)
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "i": [key[1].as_py()], "row": [rows.sum(0).tobytes()]})

    # at most four folds of one row for each weight
    sums = train.select("fold", "stats", "y").mapInArrow(normal, "fold int, i long, row binary").groupBy("fold", "i").applyInArrow(total, "fold int, i long, row binary").collect()
    of_fold = {f: np.array([np.frombuffer(r["row"], float) for r in sorted(sums, key=lambda r: r["i"]) if r["fold"] == f]) for f in {r["fold"] for r in sums}}
    ridge = np.full(len(model.beta), RIDGE)
    ridge[-1] = 1e-9
    solve = lambda a: np.linalg.solve(a[:, :-1] + np.diag(ridge), a[:, -1])
    every = sum(of_fold.values())
    model.beta = solve(every)
    without = {f: solve(every - a) for f, a in of_fold.items()}

    def binned(batches):
        for b in batches:
            if b.num_rows:
                beta = np.array([without[f] for f in b.column("fold").to_pylist()])
                raw = np.clip((model.fourier(matrix(b.column("stats"))) * beta).sum(1), -1, 2)
                yield pa.RecordBatch.from_pydict({"bin": np.floor((raw + 1) / 3 * BINS).astype(np.int64), "raw": raw, "y": b.column("y").to_numpy()})

    bins = train.select("fold", "stats", "y").mapInArrow(binned, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("at"), F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.knots, model.values = isotonic(*(np.array([float(r[k]) for r in bins]) for k in ("at", "n", "y")))
    return model


def score_of(model: Model):
    """An Arrow function from statistics to scores."""

    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(stats)) if len(stats) else [], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (fold 0), score and predicted of every row of ``docs``, by a model fitted on ``labels``."""
    stats = stored(with_stats(docs.select("doc_id", "text")).drop("text"), "op10-stats")
    scored = stats.select("doc_id", (F.col("fold") == 0).alias("held_out"), score_of(fit(stats, labels))("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns. The rows are stored with their statistics, so that no text is read by Python twice or shuffled."""
    fold, stats = free_names(docs, "fold", "stats")
    kept = stored(with_stats(docs, fold, stats), "op10-rows")
    model = fit(kept.select("doc_id", F.col(fold).alias("fold"), F.col(stats).alias("stats")), labels)
    return kept.where(score_of(model)(stats) >= threshold).select(*docs.columns)
