"""Operator 1: mixing by soft membership.

A classifier learnt from a labelled table gives each document posteriors over
domains. Nonnegative document rates are then fitted by accelerated projected
gradient descent, so that the expected tokens of each domain, the sum of
rate x tokens x posterior, meet their targets in the least-squares sense. Slopes
are taken in the inverse of the domains' Gram matrix, so that a rare domain moves
as fast as a common one; where that misses a target, plain slopes are tried too,
the smaller sum of squares counts, and a warning tells what is missed. Each round
is one distributed sum of as many numbers as there are domains; a
document's rate follows from its posteriors and the rounds so far, so no rates
are kept between rounds.

The classifier is naive Bayes on hashed words with a softmax calibration, fitted
on at most SAMPLE labelled documents (those with the least hashes of their doc_id;
of rows that share a doc_id, that of the least hash of its text): one half for the
words, the other for the calibration.

Tokens are words (ASCII white space parts them). Defined cases: null texts are
empty and have no tokens; null doc_ids take part as documents; repeated rows
take part each; labels that repeat count once, with the greatest domain name;
without labelled rows the posteriors are uniform; an empty table gives an empty
result; extra columns are carried by ``mix`` and else ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import slices, words
from tessera.llm.common import free_names, stored

SAMPLE = 20_000
BUCKETS = 1 << 16
ROUNDS = 60
TOLERANCE = 1e-4
WEIGHTS = {"prime": 0.75, "rough": 0.2, "toxic": 0.05}


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the driver's label table: toxic, else prime or rough by quality."""
    return labels.where("doc_id is not null and (quality is not null or toxic is not null)").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "prime").otherwise("rough").alias("domain"))


@dataclass
class Membership:
    """Word scores and calibration; BUCKETS x domains numbers."""

    names: list[str]
    theta: np.ndarray
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, evidence of each domain against the mean of all: mean, sum over the root of tokens, and the greatest of a word)."""
        n = len(starts) - 1
        row, _, _, code = words(data, starts)
        score = self.theta[(code & np.uint64(BUCKETS - 1)).astype(np.int64)]
        count = np.bincount(row, minlength=n)
        total = np.column_stack([np.bincount(row, s, n) for s in score.T]) if len(row) else np.zeros((n, len(self.names)))
        top = np.zeros((n, len(self.names)))
        some = np.flatnonzero(count)
        if len(some):
            top[some] = np.maximum.reduceat(score, np.searchsorted(row, some))
        many = np.maximum(count, 1)[:, None]
        return count, np.column_stack([total / many, total / np.sqrt(many), top, np.log1p(count)])

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]) @ self.coef
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return p / p.sum(1, keepdims=True) if len(z) else p


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps."""
    z = np.column_stack([x, np.ones(len(x))])
    target = np.eye(k)[y]
    w = v = np.zeros((z.shape[1], k))
    step = 1 / (0.5 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] + ridge / len(z))
    for t in range(rounds):
        s = z @ v
        p = np.exp(s - s.max(1, keepdims=True))
        g = z.T @ (p / p.sum(1, keepdims=True) - target) / len(z) + ridge / len(z) * v
        w, old = v - step * g, w
        v = w + t / (t + 3) * (w - old)
    return w


def learn(docs: DataFrame, labelled: DataFrame, names: list[str], sample: int = SAMPLE) -> Membership:
    """Fit on at most ``sample`` labelled documents, which bounds what is broadcast and what the driver gets."""
    spark, k = docs.sparkSession, len(names)
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    once = labelled.where("doc_id is not null").groupBy("doc_id").agg(F.max("domain").alias("domain")).select("doc_id", number[F.col("domain")].alias("y")).where("y is not null")
    rows = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    model = Membership(names, np.zeros((BUCKETS, k)), np.zeros((3 * k + 2, k)), np.zeros(3 * k + 1), np.ones(3 * k + 1))
    if not rows:
        return model
    kind = labelled.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame([(r["doc_id"], r["y"], i % 2) for i, r in enumerate(rows)], f"doc_id {kind}, y int, half int")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    train = stored(found.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("half").alias("half"), F.min(F.struct(F.xxhash64("text"), "text")).alias("m")).select("y", "half", "m.text"), "op1-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * BUCKETS)
        for batch in batches:
            for part, data, starts in slices(batch):
                row, _, _, code = words(data, starts)
                if len(row):
                    y = part.column("y").to_numpy()
                    share = np.ones(len(row))
                    counts += np.bincount(y[row] * BUCKETS + (code & np.uint64(BUCKETS - 1)).astype(np.int64), share, k * BUCKETS)
        yield pa.RecordBatch.from_pydict({"y": np.arange(k), "counts": [c.tobytes() for c in counts.reshape(k, BUCKETS)]})

    def total(key, part):
        return pa.table({"y": [key[0].as_py()], "counts": [sum(np.frombuffer(c) for c in part.column("counts").to_pylist()).tobytes()]})

    sums = train.where("half = 0").mapInArrow(tally, "y long, counts binary").groupBy("y").applyInArrow(total, "y long, counts binary").collect()
    counts = np.zeros((k, BUCKETS))
    for r in sums:
        counts[r["y"]] = np.frombuffer(r["counts"])
    log = np.log(counts + 1.0) - np.log(counts.sum(1, keepdims=True) + BUCKETS)
    model.theta = (log - log.mean(0)).T.copy()

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in slices(batch):
                yield pa.RecordBatch.from_pydict({"y": part.column("y"), "x": pa.array(model.features(data, starts)[1].tolist(), pa.list_(pa.float64()))})

    half = train.where("half = 1").mapInArrow(evidence, "y int, x array<double>").collect()  # at most ``sample`` rows
    if half:
        x, y = np.array([r["x"] for r in half]), np.array([r["y"] for r in half])
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        model.coef = softmax_fit(np.clip((x - model.mean) / model.scale, -8, 8), y, k)
    return model


def membership_of(model: Membership):
    """An Arrow function from texts to tokens and posteriors."""
    kind = pa.struct([("n", pa.int64()), ("p", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<n:long,p:array<double>>")
    def membership(text: pa.Array) -> pa.Array:
        out = []
        for _, data, starts in slices(pa.RecordBatch.from_arrays([text], ["text"])):
            count, x = model.features(data, starts)
            out += [{"n": int(c), "p": p} for c, p in zip(count, model.posteriors(x).tolist(), strict=True)]
        return pa.array(out, kind)

    return membership


def members(docs: DataFrame, model: Membership) -> DataFrame:
    """doc_id, tokens and posteriors of every row."""
    found = docs.select("doc_id", membership_of(model)(F.col("text").cast("string")).alias("m"))
    return found.select("doc_id", F.col("m.n").alias("n_tokens"), *[F.get("m.p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(model.names)])


#: Documents that one row of the packed table holds, and rounds read, at most.
PACK = 1 << 16


def packed(table: DataFrame, names: list[str]) -> DataFrame:
    """n and p, as bytes: tokens and posteriors of up to PACK documents a row, so that a round converts few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, p, size = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"n": [np.concatenate(n).tobytes()], "p": [np.concatenate(p).tobytes()]})

        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK)
                if size + part.num_rows > PACK:
                    yield row()
                    n, p, size = [], [], 0
                n.append(part.column("n_tokens").to_numpy().astype(float))
                p.append(np.column_stack([part.column(f"p_{x}").to_numpy() for x in names]))
                size += part.num_rows
        if size:
            yield row()

    return table.select("n_tokens", *[f"p_{x}" for x in names]).mapInArrow(run, "n binary, p binary")


@dataclass
class Descent:
    """The rounds so far, from which every document's rate is replayed."""

    step: float
    cap: float
    slopes: list[np.ndarray] = field(default_factory=list)
    missed: np.ndarray | None = None  # expected tokens less targets, as shares of the budget

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, the point ahead of them where the next slope is taken)."""
        r = y = np.ones(len(p))
        for t, slope in enumerate(self.slopes):
            r, old = np.clip(y - self.step * (p @ slope), 0, self.cap), r
            y = r + t / (t + 3) * (r - old)
        return r, y


def fit_rates(table: DataFrame, names: list[str], weights: dict[str, float], budget: float | None = None, anchor: str | None = None, cap: float = float("inf"), rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Descent:
    """Rates for a members table. Targets are the weights (scaled to sum 1) x budget; the budget is by default all tokens, or with ``anchor`` what gives that domain a mean rate of one."""
    k = len(names)
    w = np.array([weights[n] for n in names], float)
    w /= w.sum()
    rows = stored(packed(table, names), "op1-packed")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for n, p in zip(b.column("n").to_pylist(), b.column("p").to_pylist(), strict=True):
                yield np.frombuffer(n), np.frombuffer(p).reshape(-1, k)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for n, p in pairs(batches):
            total += np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    def summed(run) -> np.ndarray:
        return np.array([r["v"] for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])

    first = summed(moments)
    if not len(first) or first[:k].sum() == 0:
        return Descent(0.0, cap)
    own, all_ = first[:k], first[:k].sum()
    budget = budget or (own[names.index(anchor)] / w[names.index(anchor)] if anchor else all_)
    gram = first[k:].reshape(k, k) / all_
    size = np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
    inverse = np.linalg.pinv(gram / np.outer(size, size), rcond=1e-10, hermitian=True) / np.outer(size, size)

    def descend(descent: Descent, metric: np.ndarray) -> Descent:
        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * k + 1)
            for n, p in pairs(batches):
                r, y = descent.replay(p)
                total += np.concatenate([(n * y) @ p, (n * r) @ p, [n @ np.maximum(-(p @ descent.slopes[-1]), 0)]])
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

        ahead, now = own, own
        for _ in range(rounds):
            descent.slopes.append(metric @ ((ahead - w * budget) / all_))
            before = now
            ahead, now, (most,) = np.split(summed(expected), [k, 2 * k])
            if np.abs(now - w * budget).max() < tolerance * budget or (len(descent.slopes) > 5 and np.abs(now - before).max() < 0.02 * tolerance * budget):
                break
            # no rates up to the cap give more along the slope than ``most`` x cap: beyond it the targets can't be met, and plain slopes fit them
            if metric is inverse and most > 0 and -descent.slopes[-1] @ (w * budget) > most * cap + 1e-9 * budget * np.abs(descent.slopes[-1]).max():
                break
        descent.missed = (now - w * budget) / budget
        return descent

    met = lambda d: np.abs(d.missed).max() < tolerance
    found = descend(Descent(1.0, cap), inverse)
    if not met(found):
        found = min(found, descend(Descent(1 / np.linalg.eigvalsh(gram)[-1], cap), np.eye(k)), key=lambda d: (not met(d), float(d.missed @ d.missed)))
    if not met(found):
        warnings.warn(f"rates miss the targets after {len(found.slopes)} rounds, in shares of the budget by " + ", ".join(f"{n} {m:+.5f}" for n, m in zip(names, found.missed, strict=True)), stacklevel=2)
    return found


def rates(table: DataFrame, names: list[str], descent: Descent) -> DataFrame:
    """The members table with each document's rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, _ = descent.replay(np.column_stack([b.column(f"p_{x}").to_numpy() for x in names]))
            yield b.append_column("rate", pa.array(r))

    return table.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema) + ", rate double")


def soft_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = WEIGHTS, **options) -> DataFrame:
    """doc_id, n_tokens, posteriors and rate of every row of ``docs``."""
    names = sorted(weights)
    table = stored(members(docs, learn(docs, labelled, names)), "op1-members")
    return rates(table, names, fit_rates(table, names, weights, **options))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = 1, **options) -> DataFrame:
    """``docs`` with each row repeated by its rate: the whole part surely, one more with the chance of the rest, drawn from a hash of doc_id and seed. The rows are stored with their posteriors, so that no text is read by Python twice or shuffled."""
    names = sorted(weights)
    (m,) = free_names(docs, "membership")
    model = learn(docs, labelled, names)
    kept = stored(docs.select(*docs.columns, membership_of(model)(F.col("text").cast("string")).alias(m)), "op1-rows")
    table = kept.select(F.col(f"{m}.n").alias("n_tokens"), *[F.get(f"{m}.p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)])
    descent = fit_rates(table, names, weights, **options)

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(descent.replay(np.array(p.flatten()).reshape(len(p), -1))[0] if len(p) else [], pa.float64())

    (r,) = free_names(kept, "rate")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(r) + (draw < F.col(r) % 1).cast("int")
    return kept.withColumn(r, rate(F.col(f"{m}.p"))).withColumn(m, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)
