"""Operator 8: near-duplicates by MinHash bands and sequential Bayesian verification.

Rows of equal shingle sets form a class, named by one of its rows; classes that
hold rows of one doc_id are linked. Bands of the classes' signatures give
buckets. In each bucket one member, the one that shares most buckets with
others, is compared with all; then members that this left in another component
are compared with the rest of the bucket, block by block within tasks, where
pairs that the comparison leaves are verified at once and only links that join
two components become rows. So no pair within a bucket that could join two
components goes untested.

A pair is compared in batches of BATCH hashes. With a flat prior, m of n equal
hashes give the posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as
the chance that its similarity reaches the threshold falls below MISS. Survivors
are verified on their full sets.

Banding misses a link of similarity 0.75 with a chance of about 2e-5.

Defined cases: null and empty texts, and texts without words, have empty sets,
are linked with nothing and kept; rows that share a doc_id are one document for
reachability; rows without doc_id take no part and are kept, with a null
component; repeated rows are reported each; extra columns are carried by
``keep_first`` and else ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import mix, slices
from tessera.llm.common import free_names, release, shuffle_partitions, stored
from tessera.llm.shingles import shingle_sets

#: Least similarity in hundredths.
SIMILAR = 75
#: Hashes of a signature; the first BANDS x BAND of them make the bands, all of them the sequential comparison.
HASHES = 540
BANDS, BAND = 54, 6
BATCH = 36
MISS = 1e-7
#: Members that one task compares with a pivot, and shingles of members that it holds at most (more only for a single longer set).
MEMBERS, SHINGLES = 256, 1 << 21
_U = np.uint64
_RNG = np.random.default_rng(8)
_FACTOR = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
#: Rows of a block of members that stand apart, and of a block of a bucket's other members.
APART_BLOCK, OTHER_BLOCK = 256, 2048


def signatures(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """16 bits of each MinHash of the n rows; rows without shingles have zeros."""
    out = np.zeros((n, HASHES), "<u2")
    some = np.unique(rows)
    if len(some):
        first = np.searchsorted(rows, some)
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(h * _FACTOR[k], first) >> _U(24) & _U(0xFFFF)
    return out


def least_matches(similar: int = SIMILAR, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least equal ones): fewer leave a chance below ``miss`` of reaching the threshold. The tail of a Beta with whole parameters is a binomial sum."""
    t, out = similar / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """row, doc_id, a hash of the text, n (set size), two fingerprints of the set and the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in slices(batch):
                n = len(starts) - 1
                at, h = shingle_sets(data, starts)
                size = np.bincount(at, minlength=n)
                prints = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                for f, salt in zip(prints, (0, 0x5851F42D4C957F2D), strict=True):
                    np.add.at(f, at, mix(h ^ _U(salt)))
                sig = signatures(at, h, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size), *[pa.array(f.view(np.int64)) for f in prints], pa.array([s.tobytes() for s in sig], pa.binary())], ["row", "doc_id", "h", "n", "f1", "f2", "sig"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, h long, n long, f1 long, f2 long, sig binary")


def bands(classes: DataFrame) -> DataFrame:
    """key, band and id: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
                for b in range(BANDS):
                    key = np.full(len(sig), b + 1, np.uint64)
                    for k in range(b * BAND, b * BAND + BAND):
                        key = mix(key * _U(0x2545F4914F6CDD1D) + sig[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(sig), b, np.int32)), part.column("id")], ["key", "band", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, band int, id long")


def pruned(pairs: DataFrame, classes: DataFrame, similar: int, miss: float) -> DataFrame:
    """The pairs (a, b), with the set size of b, that sizes and sequential comparison leave."""
    limits = least_matches(similar, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sa", "sb"))
                live, equal, seen = np.arange(len(left)), np.zeros(len(left), np.int64), 0
                for n, least in limits:
                    equal[live] += (left[live, seen:n] == right[live, seen:n]).sum(1)
                    live, seen = live[equal[live] >= least], n
                yield batch.select(["a", "b", "nb"]).take(pa.array(live))

    one = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = (100 * F.least("na", "nb")) >= similar * F.greatest("na", "nb")
    return pairs.join(one, "a").join(two, "b").where(sized).select("a", "b", "nb", "sa", "sb").mapInArrow(run, "a long, b long, nb long").distinct()


def crossing(placed: DataFrame, classes: DataFrame, texts: DataFrame, similar: int, miss: float) -> DataFrame:
    """Links (a, b) that join components within buckets. ``placed`` has key, band, id, its set size n, pivot and the components of both.

    Buckets of equal members count once. A block of members that stand apart meets a block of the bucket's others in one task, which
    compares them, confirms what is left on full sets and joins components as it goes; a pair is taken in the first band that it shares
    only, and a block gives fewer links than it has members."""
    limits = least_matches(similar, miss)
    apart = F.col("own") != F.col("its")
    blocks = lambda rows, n: F.ceil(F.greatest(F.count_if(rows) / n, F.sum(F.when(rows, F.col("n"))) / SHINGLES)).cast("int")
    print_ = lambda salt: F.sum(F.xxhash64("id", F.lit(salt)).cast("decimal(20,0)"))
    others = placed.where("id <> pivot")
    buckets = others.groupBy("key", "band").agg(blocks(apart, APART_BLOCK).alias("ub"), blocks(F.lit(True), OTHER_BLOCK).alias("xb"), F.count("*").alias("members"), print_(0).alias("m1"), print_(1).alias("m2"), (F.min("own") < F.max("own")).alias("several"))
    once = buckets.where("ub > 0 and several").groupBy("members", "m1", "m2").agg(F.min(F.struct("band", "key", "ub", "xb")).alias("least")).select("least.key", "least.ub", "least.xb")
    # stored, so that both sides of the join come from plain shuffles, whose hot keys Spark can split
    once = stored(once, "op8-buckets")
    chosen = stored(others.select("key", "band", "id", "own", apart.alias("apart")).join(once, "key"), "op8-chosen")
    wanted = chosen.select("id").distinct()
    sets = stored(classes.select("id", "n", "sig").join(wanted, "id", "left_semi").join(texts, "id"), "op8-sets")
    rows = chosen.join(sets, "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["id", "own", "apart", "n", "band", "sig", "text"]
    left = rows.where("apart").select("key", one("ub").alias("u"), every("xb").alias("x"), F.lit(True).alias("left"), *columns)
    right = rows.select("key", every("ub").alias("u"), one("xb").alias("x"), F.lit(False).alias("left"), *columns)

    def compare(g: pa.Table) -> list[tuple[int, int]]:
        side, away = g.column("left").to_numpy(), g.column("apart").to_numpy()
        ids, n = g.column("id").to_numpy(), g.column("n").to_numpy()
        _, label = np.unique(g.column("own").to_numpy(), return_inverse=True)
        if label.max() == 0:
            return []
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        band, rest, full, links = g.column("band")[0].as_py(), np.flatnonzero(~side), FullSets(g.column("text")), []
        for k in np.flatnonzero(side):
            fits = (label[rest] != label[k]) & (~away[rest] | (ids[rest] > ids[k])) & (100 * np.minimum(n[rest], n[k]) >= similar * np.maximum(n[rest], n[k]))
            live, seen = rest[fits], 0
            equal = np.zeros(len(live), np.int64)
            for upto, least in limits:
                if not len(live):
                    break
                equal += (sig[live, seen:upto] == sig[k, seen:upto]).sum(1)
                on = equal >= least
                live, equal, seen = live[on], equal[on], upto
            if len(live):
                shared = (sig[live, : BANDS * BAND] == sig[k, : BANDS * BAND]).reshape(len(live), -1, BAND).all(2)
                live = live[shared.argmax(1) == band]
            while len(live):
                some, live = live[:64], live[64:]
                for b in some[full.similar(k, some, similar)]:
                    if label[b] != label[k]:
                        links.append((ids[k], ids[b]))
                        label[label == label[b]] = label[k]
                live = live[label[live] != label[k]]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch:
            links = compare(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "u", "x")), strict=True))
            begin = 0
            for at in range(len(names) + 1):
                if at == len(names) or names[at] != last:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    begin = at
                    if at < len(names):
                        if held:
                            yield close()
                        held, last = [], names[at]
        if held:
            yield close()

    dealt = left.unionByName(right).repartition(shuffle_partitions(placed.sparkSession), "key", "u", "x").sortWithinPartitions("key", "u", "x")
    links = stored(dealt.mapInArrow(run, "a long, b long").distinct(), "op8-links")
    release(once, chosen, sets)
    return links


class FullSets:
    """Shingle sets of the texts of a block, made when first asked for."""

    def __init__(self, texts: pa.ChunkedArray):
        self.texts, self.sets = texts, {}

    def similar(self, k: int, others: np.ndarray, similar: int) -> np.ndarray:
        """Which of ``others`` are similar to k on their full sets."""
        new = [int(i) for i in (k, *others) if int(i) not in self.sets]
        if new:
            at = 0
            for part, data, starts in slices(pa.RecordBatch.from_arrays([self.texts.take(pa.array(new)).combine_chunks()], ["text"])):
                row, h = shingle_sets(data, starts)
                self.sets.update(zip(new[at : at + part.num_rows], np.split(h, np.searchsorted(row, np.arange(1, part.num_rows))), strict=True))
                at += part.num_rows
        own, theirs = self.sets[int(k)], [self.sets[int(i)] for i in others]
        size = np.array([len(s) for s in theirs])
        joined = np.concatenate(theirs)
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        both = np.add.reduceat((own[place] == joined).astype(np.int64), np.cumsum(size) - size)
        return 100 * both >= similar * (len(own) + size - both)


def verified(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; ``a`` is compared with about MEMBERS of its partners, or SHINGLES of their shingles, in each task."""
    spread = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("nb") / SHINGLES)).cast("int").alias("salts"))
    side_b = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(False).alias("pivot"))
    side_a = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(True).alias("pivot"))

    def check(key, part):
        part = part.sort_by([("pivot", "descending")])
        pivots = sum(part.column("pivot").to_pylist())
        ids, linked, sets = part.column("id").to_numpy(), [], []
        for batch in part.select(["id", "text"]).combine_chunks().to_batches():
            for rows, data, starts in slices(batch):
                at, h = shingle_sets(data, starts)
                sets += np.split(h, np.searchsorted(at, np.arange(1, rows.num_rows)))
        for k in range(pivots, len(sets)):
            for p in sets[:pivots]:
                both = np.intersect1d(p, sets[k], assume_unique=True).size
                if 100 * both >= similar * (len(p) + len(sets[k]) - both):
                    linked.append(ids[k])
        return pa.table({"a": pa.array([key[0].as_py()] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    both = side_a.unionByName(side_b).join(texts, "id")
    return both.groupBy("a", "salt").applyInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label (least id reachable) of the ids that links (a, b) name: labels spread to neighbours and jump to their label's label."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "op8-edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "op8-label")
    while True:
        old = label
        near = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        lower = label.join(near, "id").select("id", F.col("label").alias("before"), F.least("label", "other").alias("label"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("root"))
        after = stored(lower.join(jump, "label", "left").select("id", "before", F.least("label", F.coalesce("root", "label")).alias("label")), "op8-label")
        done = after.where("label <> before").isEmpty()
        release(old)
        if done:
            release(both)
            return after
        label = after


def same_document(known: DataFrame) -> DataFrame:
    """Links (a, b) between the classes (id) that hold rows of one doc_id."""
    several = known.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    return known.join(several, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, miss: float = MISS) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    rows = stored(sketches(docs), "op8-rows")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2")
    first = F.min(F.struct("doc_id", "row", "h")).alias("first")
    classes = stored(sets.agg(first, F.min("sig").alias("sig")).select("n", "f1", "f2", "sig", F.col("first.row").alias("id"), F.col("first.doc_id").alias("of"), F.col("first.h").alias("h")), "op8-classes")
    known = stored(rows.select("row", "doc_id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "id", "of"), ["n", "f1", "f2"], "left").select("row", "doc_id", "n", "id", "of"), "op8-known")
    release(rows)
    keys = bands(classes)
    # grouped sides are stored before they are joined, so that both sides come from plain shuffles, whose hot keys Spark can split
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "op8-sizes")
    shared = stored(keys.join(sizes, "key"), "op8-shared")
    wanted = classes.select("id", F.col("of").alias("doc_id"), "h").join(shared.select("id").distinct(), "id", "left_semi")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    texts = stored(read.join(wanted, ["doc_id", "h"]).select("id", "text"), "op8-texts")

    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = stored(shared.join(weight, "id").groupBy("key").agg((-F.max(F.struct("weight", -F.col("id"))).getField("col2")).alias("pivot")), "op8-pivots")
    dealt = stored(shared.select("key", "band", "id").join(pivots, "key"), "op8-dealt")
    stars = dealt.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stored(pruned(stars, classes, similar, miss), "op8-pairs")
    links = stored(verified(pairs, texts, similar).unionByName(same_document(known)), "op8-links")
    release(sizes, shared, pivots, pairs)

    label = components(links)
    of_id, of_pivot = label.select("id", F.col("label").alias("own")), label.select(F.col("id").alias("pivot"), F.col("label").alias("its"))
    sized = dealt.join(classes.select("id", "n"), "id").join(of_id, "id", "left").join(of_pivot, "pivot", "left")
    placed = stored(sized.select("key", "band", "id", "n", "pivot", F.coalesce("own", "id").alias("own"), F.coalesce("its", "pivot").alias("its")), "op8-placed")
    more = crossing(placed, classes, texts, similar, miss)
    release(dealt, placed, texts)
    if not more.isEmpty():
        release(label)
        label = components(links.unionByName(more))
    release(links, more)

    linked = label.select("id", "label").join(classes.select("id", "of"), "id")
    least = stored(linked.groupBy("label").agg(F.min("of").alias("least")), "op8-least")
    found = known.join(label.select("id", "label").join(least, "label").select("id", "least"), "id", "left")
    component = F.coalesce("least", "of", "doc_id")
    return found.select("row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of its least doc_id, and every row without words or doc_id; all columns stay. ``docs`` must read the same rows in the same order each time, as a stored table does."""
    found = near_duplicates(docs, **options).where("kept")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    (row,) = free_names(docs, "row")
    kept = found.groupBy("component_id", F.when(alone, F.col("row")).alias("alone")).agg(F.min("row").alias(row)).select(row)
    return docs.select(*docs.columns, F.monotonically_increasing_id().alias(row)).join(kept, row, "left_semi").select(*docs.columns)
