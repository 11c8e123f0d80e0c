"""Operator 9: nearest neighbours by vantage-point trees, a tree for each shard.

Nearness is the inner product. With one more coordinate, the root of the greatest
squared norm less the own, rows lie on a sphere and the largest inner product is the
least Euclidean distance, so the triangle inequality prunes, between shards and within.
What is left out has a least possible distance above ``factor`` times the distance of
the k-th nearest so far; factor one is exact, lower is faster.

Shards: rows go to the nearest of a few vantage points (CELLS at most for each vector
length, spread over a sample of SAMPLE rows, which decides pruning only), and cells
are cut into pieces of about SHARD_ROWS rows by a hash of the id, each with a tree.
Queries travel in packed blocks of a cell; trees meet CHUNK blocks at a time. A block
first meets one piece of its own cell, which bounds its k-th nearest; with that bound
each query goes only to the cells that it can reach, and to all their pieces. Results
travel packed by block and are merged at most FAN at a time.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and rows without id, take no part; rows that share an id count once,
with their least vector; vectors of different lengths are never compared; ties
go to the smaller id; fewer than k candidates give them all; extra columns are
ignored; an empty table gives an empty result. Of equal vectors in a shard only
the k + 1 smallest ids can be among the nearest, and only those are kept.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

NEAREST = 20
FACTOR = 1.0
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4096
#: Blocks that one copy of a tree meets.
CHUNK = 16
LEAF = 64
FAN = 64
#: Vantage points of a vector length, numbers that they (and a block of queries, and an eighth of a shard) have at most, lengths that have any (the most frequent), and rows they are chosen from.
CELLS, NUMBERS, LENGTHS, SAMPLE = 256, 1 << 20, 4, 4096
#: Rounding of inner products that is forgiven before scores are computed one by one.
SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of one shard; children are halves by distance rank, with their distance ranges."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x = ids, x
        norms = (x.astype(float) ** 2).sum(1)
        self.reach = float(norms.max())
        full = np.column_stack([x, np.sqrt(np.maximum(self.reach - norms, 0))])
        self.nodes: list[tuple] = []  # (rows) or (vantage vector, ((child, least, greatest), ...))
        self._grow(full, np.arange(len(ids)), leaf)

    def _grow(self, full: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) <= leaf:
            return me
        mean = full[rows].mean(0)
        vantage = full[rows[np.argmax(((full[rows] - mean) ** 2).sum(1))]]
        d = np.sqrt(((full[rows] - vantage) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        parts = []
        for half in np.array_split(order, 2):
            parts.append((self._grow(full, rows[half], leaf), d[half].min(), d[half].max()))
        self.nodes[me] = (vantage, tuple(parts))
        return me

    def search(self, own: np.ndarray, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k nearest of each query, by query; scores below the query's ``bound`` are of no use."""
        best = np.full((len(q), k), -np.inf) if bound is None else np.repeat(bound[:, None], k, 1)
        square = (q**2).sum(1) + self.reach
        held: list[tuple] = []
        slack = SLACK * np.sqrt((q**2).sum(1) * max(self.reach, 1e-300))
        near = np.zeros(len(q), np.int64)  # greedy descent first, for a good k-th nearest
        for _ in range(64):
            going = np.array([len(n) == 2 for n in self.nodes])[near]
            if not going.any():
                break
            for node in np.unique(near[going]):
                at = np.flatnonzero(near == node)
                vantage, parts = self.nodes[node]
                d = self._distance(q[at], vantage)
                gap = np.column_stack([np.maximum(np.maximum(lo - d, d - hi), 0) for _, lo, hi in parts])
                middle = np.column_stack([np.abs(d - (lo + hi) / 2) for _, lo, hi in parts])
                near[at] = np.array([c for c, _, _ in parts])[np.argmin(gap + 1e-6 * middle, 1)]
        first = near.copy()
        for node in np.unique(first):
            self._scan(np.flatnonzero(first == node), node, own, q, best, held, slack)
        self._visit(0, np.arange(len(q)), first, own, q, k, factor, best, square, held, slack)
        query, row = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        s = np.zeros(len(query))
        for c in range(self.x.shape[1]):  # added up in order, as SQL does
            s += q[query, c] * self.x[row, c]
        fits = s >= best[query, -1] - 2 * slack[query]
        query, row, s = query[fits], row[fits], s[fits]
        order = np.lexsort((self.ids[row], -s, query))
        query, row, s = query[order], row[order], s[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < k], row[rank < k], s[rank < k]

    def _distance(self, q: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((q - vantage[:-1]) ** 2).sum(1) + vantage[-1] ** 2, 0))

    def _scan(self, at, node, own, q, best, held, slack) -> None:
        rows = self.nodes[node][0]
        s = q[at] @ self.x[rows].T.astype(float)
        s[own[at][:, None] == self.ids[rows][None, :]] = -np.inf
        i, j = np.nonzero((s >= (best[at, -1] - 2 * slack[at])[:, None]) & (s > -np.inf))
        held.append((at[i], rows[j]))
        both = np.concatenate([best[at], s], 1)
        k = best.shape[1]
        best[at] = -np.sort(np.partition(-both, k - 1, 1)[:, :k], 1)

    def _visit(self, node, at, first, own, q, k, factor, best, square, held, slack) -> None:
        if len(self.nodes[node]) == 1:
            at = at[first[at] != node]
            if len(at):
                self._scan(at, node, own, q, best, held, slack)
            return
        vantage, parts = self.nodes[node]
        d = self._distance(q[at], vantage)
        gaps = [np.maximum(np.maximum(lo - d, d - hi), 0) for _, lo, hi in parts]
        for part in np.argsort([g.mean() for g in gaps]):
            kth = np.sqrt(np.maximum(square[at] - 2 * best[at, -1], 0))
            on = ~(gaps[part] > factor * kth * (1 + 1e-7) + 1e-9)
            if on.any():
                self._visit(parts[part][0], at[on], first, own, q, k, factor, best, square, held, slack)


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (doubles) and dim of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _packed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("id").to_numpy()
    x = np.array(rows.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], x[order]


class Cells:
    """The vantage points of one vector length, and once rows are dealt the range of distances and the pieces of each cell."""

    def __init__(self, points: np.ndarray, reach: float):
        self.points, self.reach = points, reach
        self.lift = np.sqrt(np.maximum(reach - (points**2).sum(1), 0))
        self.least, self.most = np.full(len(points), np.inf), np.full(len(points), -np.inf)

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Of rows (on the sphere) or queries (whose last coordinate is zero) to the points."""
        square = (x**2).sum(1)
        own = np.sqrt(np.maximum(self.reach - square, 0)) if lifted else np.zeros(len(x))
        flat = square[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T
        return np.sqrt(np.maximum(flat + (own[:, None] - self.lift) ** 2, 0))

    def reached(self, q: np.ndarray, kth: np.ndarray, factor: float) -> np.ndarray:
        """Which cells (columns) may hold something nearer to a query than its k-th score."""
        d = self.distances(q, False)
        gap = np.maximum(np.maximum(self.least - d, d - self.most), 0)
        radius = np.sqrt(np.maximum((q**2).sum(1) + self.reach - 2 * kth, 0))
        return gap <= (factor * radius * (1 + 1e-7) + 1e-6)[:, None]


def spread(x: np.ndarray, n: int, reach: float) -> np.ndarray:
    """n rows of a sample, each the farthest from those before it; fewer if the rest are copies."""
    full = np.column_stack([x, np.sqrt(np.maximum(reach - (x**2).sum(1), 0))])
    picked, away = [0], ((full - full[0]) ** 2).sum(1)
    while len(picked) < n and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((full - full[picked[-1]]) ** 2).sum(1))
    return x[picked]


def choose_cells(rows: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """Vantage points for the most frequent lengths that have more rows than a shard."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    often = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("reach")).where(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    out = {}
    for r in often:
        dim = r["dim"]
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        n = max(1, min(CELLS, NUMBERS // dim, math.ceil(r["n"] / shard_rows)))
        out[dim] = Cells(spread(np.array([s["v"] for s in sample]), n, r["reach"]), r["reach"])
    return out


def placed(rows: DataFrame, cells: dict[int, Cells], lifted: bool) -> DataFrame:
    """``rows`` with the nearest vantage point's cell and the distance to it; cell 0 where a length has no points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                cell, away = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if int(dim) in cells:
                    d = cells[int(dim)].distances(np.array(part.column("v").flatten()).reshape(part.num_rows, -1), lifted)
                    if not lifted:
                        d = np.where(np.isfinite(cells[int(dim)].least), d, np.inf)  # a query's home holds rows
                    cell, away = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "v", "dim")), pa.array(cell), pa.array(away)], ["id", "v", "dim", "cell", "away"])

    return rows.select("id", "v", "dim").mapInArrow(run, "id long, v array<double>, dim int, cell long, away double")


def build_index(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """A pickled tree for each dim, cell and piece."""

    def build(key, part):
        ids, x = _packed(part)
        _, same = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, same.ravel()))
        same = same.ravel()[order]
        keep = np.sort(order[np.arange(len(order)) - np.searchsorted(same, same) <= k])
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "cell": [key[1].as_py()], "piece": [key[2].as_py()], "tree": [pickle.dumps(Tree(ids[keep], x[keep]), 5)]})

    return rows.groupBy("dim", "cell", "piece").applyInArrow(build, "dim int, cell long, piece long, tree binary")


def _merge(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, ids, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, -s, query))
    query, ids, s = query[order], ids[order], s[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], ids[top], s[top]


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


_KEY = ["dim", "cell", "piece"]
_WORK = "dim int, cell long, piece long, home long, block long, queries binary"


def search(rows: DataFrame, queries: DataFrame, k: int = NEAREST, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query; both frames come from ``vectors``."""
    cells = choose_cells(rows, shard_rows)
    dealt = stored(placed(rows, cells, True), "op9-placed")
    at_most = lambda n, numbers: F.greatest(F.lit(1), F.least(F.lit(n), F.lit(numbers) / F.col("dim")))
    sizes = stored(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / at_most(shard_rows, 8 * NUMBERS)).alias("pieces"), F.min("away").alias("least"), F.max("away").alias("most")), "op9-sizes")
    for r in sizes.where(F.col("dim").isin([*cells])).collect():  # at most LENGTHS x CELLS
        cells[r["dim"]].least[r["cell"]], cells[r["dim"]].most[r["cell"]] = r["least"], r["most"]
    pieces = sizes.select("dim", "cell", "pieces")
    index = stored(build_index(dealt.join(pieces, ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("id"), "pieces")), k), "op9-index")

    asked = stored(placed(queries, cells, False), "op9-asked")
    blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / at_most(block_queries, NUMBERS)).alias("blocks"))
    # each cell holds its point's own row, so no query stays without a home unless no row has its length
    numbered = asked.join(blocks, ["dim", "cell"]).join(pieces, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), "blocks")).withColumn("piece", F.pmod(F.xxhash64("block", "cell"), "pieces"))

    def pack(key, part):
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "cell": [key[1].as_py()], "piece": [key[2].as_py()], "home": [key[1].as_py()], "block": [key[3].as_py()], "queries": [pickle.dumps((*_packed(part), None), 5)]})

    first = stored(numbered.groupBy("dim", "cell", "piece", "block").applyInArrow(pack, _WORK), "op9-blocks")
    n = first.count()

    def meet(work: DataFrame, chunks: int, step, schema: str) -> DataFrame:
        """Bring blocks to the trees of their pieces, CHUNK blocks or so to a copy of a tree."""
        left = work.withColumn("chunk", F.pmod(F.xxhash64("home", "block"), F.lit(chunks)))
        used = left.select(*_KEY, "chunk").distinct().join(index, _KEY).select(*_KEY, "chunk", "tree")
        copies = used.toDF("dim_", "cell_", "piece_", "chunk_", "tree")  # names of their own, as both sides come from the same rows
        return left.groupBy(*_KEY, "chunk").cogroup(copies.groupBy("dim_", "cell_", "piece_", "chunk_")).applyInArrow(step, schema)

    chunks = max(1, math.ceil(n / CHUNK))

    def home(work: pa.Table, trees: pa.Table) -> pa.Table:
        """What a block finds at home, and for each cell the queries that may find more there."""
        out = []
        tree = pickle.loads(trees.column("tree")[0].as_py()) if trees.num_rows else None  # hashes may leave a piece empty
        for r in work.to_pylist():
            own, q, _ = pickle.loads(r["queries"])
            kth = np.full(len(q), -np.inf)
            if tree is not None:
                query, row, s = tree.search(own, q, k, factor)
                out.append((r["dim"], -1, r["piece"], r["home"], r["block"], pickle.dumps((own[query], tree.ids[row], s), 5)))
                ends = np.flatnonzero(np.bincount(query, minlength=len(q)) == k)
                kth[ends] = s[np.searchsorted(query, ends, "right") - 1]
            may = cells[r["dim"]].reached(q, kth, factor) if r["dim"] in cells else np.ones((len(q), 1), bool)
            for c in np.flatnonzero(may.any(0)):
                some = may[:, c]
                out.append((r["dim"], int(c), r["piece"], r["home"], r["block"], pickle.dumps((own[some], q[some], kth[some]), 5)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return _table(out, kinds, [*_KEY, "home", "block", "queries"])

    begun = stored(meet(first, chunks, home, _WORK), "op9-home")
    more = begun.where("cell >= 0").join(pieces, ["dim", "cell"]).withColumn("seen", F.when(F.col("cell") == F.col("home"), F.col("piece"))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    work = more.where("seen is null or piece <> seen").select(*_KEY, "home", "block", "queries")

    def further(work: pa.Table, trees: pa.Table) -> pa.Table:
        out = []
        tree = pickle.loads(trees.column("tree")[0].as_py()) if trees.num_rows else None
        for r in work.to_pylist() if tree is not None else ():
            own, q, kth = pickle.loads(r["queries"])
            query, row, s = tree.search(own, q, k, factor, kth)
            out.append((r["dim"], r["home"], r["block"], (r["cell"] * 7919 + r["piece"]) % parts, pickle.dumps((own[query], tree.ids[row], s), 5)))
        return _table(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), ["dim", "home", "block", "part", "found"])

    shards = sizes.agg(F.sum("pieces")).first()[0] or 1
    left = parts = max(1, math.ceil(shards / FAN))

    def merge(key, part):
        found = _merge([pickle.loads(f) for f in part.column("found").to_pylist()], k)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "home": [key[1].as_py()], "block": [key[2].as_py()], "part": [key[3].as_py() // FAN], "found": [pickle.dumps(found, 5)]})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column("found").to_pylist():
                query, ids, s = pickle.loads(f)
                rank = (np.arange(len(query)) - np.searchsorted(query, query) + 1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"query_id": query, "rank": rank, "vec_id": ids, "score": s})

    kind = "dim int, home long, block long, part long, found binary"
    at_home = begun.where("cell < 0").select("dim", "home", "block", F.lit(0).cast("long").alias("part"), F.col("queries").alias("found"))
    found = at_home.unionByName(meet(work, chunks, further, kind))
    while True:
        found = found.groupBy("dim", "home", "block", "part").applyInArrow(merge, kind)
        if left <= 1:
            return found.mapInArrow(last, "query_id long, rank int, vec_id long, score double")
        left = math.ceil(left / FAN)
