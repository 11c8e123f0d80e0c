"""Operator 4: removal of repeated passages by longest-previous-factor arrays.

A factor is a string of LEAST bytes; it is repeated if it starts anywhere else.
Anchors cut the corpus into parts that can be compared apart: of the K-byte
strings in a factor the one with the least hash is its anchor, so equal factors
have equal anchors at equal offsets. Factors that follow each other and share an
anchor form a run, whose context is all bytes they cover.

Anchors that occur once are dropped. Where all contexts of an anchor are equal (by
128 bits of hashes), all their factors repeat. The distinct contexts of the others
are laid side by side in order of place and the suffixes at their factors are put
in alphabetical order by prefix doubling. In that order the nearest entries of
smaller position on either side, with the common prefixes towards them, give each
suffix's longest previous factor; the nearest entries of greater position give its
longest next one. A factor has an earlier copy if and only if the former reaches
LEAST, and a later one if and only if the latter does.

``keep="first"`` removes all copies of a factor but the earliest, ``keep="none"``
removes the earliest too. An anchor with more than HOT distinct contexts is split:
its contexts become texts of their own, cut by longer anchors (``levels``), of
which the last is the whole factor, so that only factors which share ever more bytes meet.

Defined cases: null texts are empty; texts below LEAST bytes lose nothing; each
of several equal rows is a place of its own; rows with a null doc_id take part;
extra columns are carried by ``remove`` and else ignored; an empty table gives
an empty result. ``docs`` must read the same rows in the same order each time,
as a stored table does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import BLOCK_BYTES, BYTE_CODE, mix, slices
from tessera.llm.common import free_names, release, shuffle_partitions, stored

LEAST = 200
#: Length of the anchors of the first cut.
ANCHOR = 20
#: Distinct contexts of an anchor (each shorter than two factors) that one task orders.
HOT = 4096
_U = np.uint64
_BASE = _U(0x5851F42D4C957F2D)
_INVERSE = _U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
SPAN = "array<struct<s:int,e:int>>"


def levels(least: int) -> tuple[int, ...]:
    """Lengths of anchors: of the first cut, of the next one where an anchor is hot, and at last whole factors."""
    return min(ANCHOR, least), max(min(ANCHOR, least), least * 4 // 5), least


class Prints:
    """Fingerprints of all substrings of a byte array from one running sum (polynomials modulo 2^64 over random byte codes)."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, _BASE)]))
        inverse = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, _INVERSE)]))
        self.sum = np.zeros(n, np.uint64)
        np.cumsum(BYTE_CODE[data] * inverse[:-1], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[start]) * self.power[start]

    def windows(self, size: int) -> np.ndarray:
        return (self.sum[size:] - self.sum[:-size]) * self.power[: len(self.sum) - size]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima of blocks from both sides."""
    n = len(x)
    full = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_runs(data: np.ndarray, starts: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, context hash, anchor place, first factor, last factor) of each run; places count from the text's start."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return (none,) * 6
    prints = Prints(data)
    h = mix(prints.windows(k))
    bits = int(len(h)).bit_length()
    least_at = sliding_min((h >> _U(bits) << _U(bits)) | np.arange(len(h), dtype=np.uint64), least - k + 1)
    text = np.repeat(np.arange(len(starts) - 1), np.maximum(np.diff(starts) - least + 1, 0))
    if not len(text):
        return (none,) * 6
    valid = np.arange(len(text)) - np.searchsorted(text, text) + starts[text]
    place = (least_at[valid] & _U((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    lo, hi, anchor, of = valid[at], valid[np.append(at[1:], len(valid)) - 1], place[at], text[at]
    context = mix(prints.of(lo, hi + least) + (hi - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + mix((anchor - lo).astype(np.uint64) + _U(1)))
    base = starts[of]
    return of, h[anchor].view(np.int64), context.view(np.int64), anchor - base, lo - base, hi - base


def block_runs(data: np.ndarray, starts: np.ndarray, least: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchor_runs`` of short texts at once, of a long one by blocks. A run that a block's end cuts is two; factors are compared whatever run they are in."""
    if len(data) <= 2 * BLOCK_BYTES or len(starts) != 2:
        yield anchor_runs(data, starts, least, k)
        return
    for at in range(0, len(data) - least + 1, BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES + least - 1]
        of, a, t, anchor, lo, hi = anchor_runs(part, np.array([0, len(part)]), least, k)
        yield of, a, t, anchor + at, lo + at, hi + at


def suffix_order(data: np.ndarray, places: np.ndarray, cap: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the places in alphabetical order of the up to ``cap`` bytes from them (a power of two; equal ones by place), and the common prefix of each entry with the one before it. Bytes beyond the end count as zeros."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * cap, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + cap].copy().view(">u8").ravel().astype(np.uint64)
    ranks, size = [np.unique(word, return_inverse=True)[1].astype(np.uint64)], 8
    while size < cap:
        rank = ranks[-1]
        ahead = np.concatenate([rank[size:], np.zeros(size, np.uint64)])
        ranks.append(np.unique(rank << _U(32) | ahead, return_inverse=True)[1].astype(np.uint64))
        size *= 2
    places = np.sort(places)
    order = places[np.argsort(ranks[-1][places], kind="stable")]
    p, q = order[:-1], order[1:]
    same = np.zeros(len(p), np.int64)
    whole = ranks[-1][p] == ranks[-1][q]
    for rank in ranks[-2::-1]:
        size //= 2
        same += size * (rank[p + same] == rank[q + same])
    for _ in range(7):
        same += padded[p + same] == padded[q + same]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(whole, cap, same)
    return order, common


def common_with_nearest(value: np.ndarray, common: np.ndarray, floor: int = 1) -> np.ndarray:
    """For each entry of an order the common prefix with the nearest entry before it of a smaller value: all entries jump at once to where the one that they stand on points. Answers below ``floor`` are only known to be below it."""
    at, low = np.arange(-1, len(value) - 1), common.copy()
    going = np.arange(1, len(value))
    while True:
        going = going[low[going] >= floor]
        going = going[value[at[going]] > value[going]]
        if not len(going):
            return low
        on = at[going]
        low[going], at[going] = np.minimum(low[going], low[on]), at[on]


def longest_factors(data: np.ndarray, places: np.ndarray, floor: int = 1, cap: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, longest previous factor, longest next factor) of the suffixes at ``places``, up to ``cap`` bytes (a power of two): the longest prefix that one shares with a suffix at an earlier, and at a later, of the places."""
    if not len(places):
        return places, places, places
    order, common = suffix_order(data, places, cap)
    back = np.concatenate([common[:1], common[:0:-1]])
    nearest = lambda v: np.maximum(common_with_nearest(v, common, floor), common_with_nearest(v[::-1], back, floor)[::-1])
    previous, following = nearest(order), nearest(-order)
    by_place = np.argsort(order)
    return order[by_place], previous[by_place], following[by_place]


def repeated_factors(contexts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, earlier, later) of each factor of ``contexts`` that has an equal one: whether one comes before it and after it. Contexts are in order of place."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size) - size
    count = np.maximum(size - least + 1, 0)
    which = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]
    # a factor whose fingerprint no other one has is longer than any it shares: it needs no place in the order, nor does a context of such factors only
    twin = _twins(Prints(data).windows(least)[place]) if len(place) else np.zeros(0, bool)
    which, place = which[twin], place[twin]
    used = np.unique(which)
    data = np.frombuffer(b"".join(contexts[i] for i in used), np.uint8)
    moved = np.zeros(len(contexts), np.int64)
    moved[used] = np.cumsum(size[used]) - size[used] - begin[used]
    _, previous, following = longest_factors(data, place + moved[which], least, max(256, 1 << (least - 1).bit_length()))
    earlier, later = previous >= least, following >= least
    found = earlier | later
    return which[found], (place - begin[which])[found], earlier[found], later[found]


def _twins(h: np.ndarray) -> np.ndarray:
    """Which values occur again."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _spans(which: np.ndarray, offset: np.ndarray, least: int, n: int) -> pa.ListArray:
    """Byte spans that factors at ``offset`` cover, for each of n contexts."""
    order = np.lexsort((offset, which))
    w, o = which[order], offset[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] > o[:-1] + least)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w))[: len(first)] - 1
    pairs = pa.StructArray.from_arrays([pa.array(o[first].astype(np.int32)), pa.array((o[last] + least).astype(np.int32))], ["s", "e"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(w[first], minlength=n))]).astype(np.int32)), pairs)


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(the row of each item, the items) of a column of lists of structs; null lists have none."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(column)), length), pc.list_flatten(column)


def _numbers(items: pa.StructArray, field: str) -> np.ndarray:
    return pc.struct_field(items, field).to_numpy(zero_copy_only=False)


def _cut(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.BinaryArray:
    """The strings of ``data`` that begin and are as long as said."""
    end = np.cumsum(size)
    at = np.repeat(begin - (end - size), size) + np.arange(int(size.sum()))
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], end]).astype("<i4").tobytes()), pa.py_buffer(data[at].tobytes())])


def runs(texts: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    """A row for each anchor run of ``texts`` (row, text): row, a and t (hashes of anchor and context), lo and hi (first and last factor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in slices(batch):
                for of, a, t, _, lo, hi in block_runs(data, starts, least, k):
                    if len(of) == 0:
                        continue
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(a), pa.array(t), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["row", "a", "t", "lo", "hi"])

    return texts.mapInArrow(run, f"row {_kind(texts)}, a long, t long, lo int, hi int")


def _kind(texts: DataFrame) -> str:
    return texts.schema["row"].dataType.simpleString()


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"), *more)


def _contexts(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The bytes of wanted contexts (row, lo, hi, a, t, kinds), cut from the texts."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("a", "t", "lo", "hi", "kinds")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in slices(batch):
                row, cuts = _flat(part.column("cuts"))
                for at in range(0, len(row), 16_384):
                    of, some = row[at : at + 16_384], cuts.slice(at, 16_384)
                    lo = _numbers(some, "lo").astype(np.int64)
                    made = _cut(data, starts[of] + lo, _numbers(some, "hi") - lo + least)
                    kept = [pc.struct_field(some, c) for c in ("a", "t", "lo", "kinds")]
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(of)), *kept, made], ["row", "a", "t", "lo", "kinds", "bytes"])

    return texts.join(lists, "row").mapInArrow(run, f"row {_kind(texts)}, a long, t long, lo int, kinds long, bytes binary")


def _matched(contexts: DataFrame, least: int, keep: str) -> DataFrame:
    """a, t and the spans of the factors to remove, of anchors with few contexts."""

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by([("row", "ascending"), ("lo", "ascending")])
        which, offset, earlier, _ = repeated_factors(rows.column("bytes").to_pylist(), least)
        if keep == "first":
            which, offset = which[earlier], offset[earlier]
        return pa.RecordBatch.from_arrays([rows.column("a").combine_chunks(), rows.column("t").combine_chunks(), _spans(which, offset, least, rows.num_rows)], ["a", "t", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                if size > 4096:  # all of the last anchor must stay together
                    a = batch.column("a").to_numpy()
                    cut = int(np.searchsorted(a, held[-1].column("a")[-1].as_py(), "right"))
                    if cut < len(a):
                        yield answer([*held, batch.slice(0, cut)] if cut else held)
                        held, size, batch = [], 0, batch.slice(cut)
                held.append(batch)
                size += batch.num_rows
        if held:
            yield answer(held)

    dealt = contexts.select("a", "t", "row", "lo", "bytes").repartition(shuffle_partitions(contexts.sparkSession), "a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, f"a long, t long, gone {SPAN}")


def _hot(contexts: DataFrame, least: int, keep: str, lengths: tuple[int, ...]) -> DataFrame:
    """The same for anchors with many contexts, whose contexts are texts with longer anchors. Row ids are bytes in order of place."""
    padded = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    row = F.col("row") if _kind(contexts) == "binary" else padded("row", 16)
    texts = stored(contexts.select(F.concat(row, padded("lo", 8)).alias("row"), "a", "t", F.col("bytes").alias("text")), "op4-hot")
    gone = _repeated(texts.select("row", "text"), least, keep, lengths)
    found = stored(texts.select("row", "a", "t").join(gone, "row").select("a", "t", F.col("spans").alias("gone")), "op4-hot-spans")
    release(texts, gone)
    return found


def _repeated(texts: DataFrame, least: int, keep: str, lengths: tuple[int, ...]) -> DataFrame:
    """row and the spans of bytes to remove of each of ``texts`` (row, text) that has any."""
    all_runs = stored(runs(texts, least, lengths[0]), "op4-runs")
    # the counts are stored so that both sides of the join come from plain shuffles, whose hot keys Spark can split
    often = stored(all_runs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "op4-often")
    live = stored(all_runs.join(often, "a"), "op4-live")
    release(all_runs, often)
    first = F.min(F.struct("row", "lo", "hi")).alias("first")
    kinds = stored(live.groupBy("a", "t").agg(F.count("*").alias("n"), first), "op4-kinds")
    several = stored(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "op4-several")
    wanted = kinds.join(several, "a").select("a", "t", "first.row", "first.lo", "first.hi", "kinds")
    contexts = stored(_contexts(texts, wanted, least), "op4-contexts")
    few, many = contexts.where(F.col("kinds") <= HOT), contexts.where(F.col("kinds") > HOT)
    split = _hot(many, least, keep, lengths[1:]) if lengths[1:] and not many.isEmpty() else None
    matched = _matched(contexts if split is None else few, least, keep)
    verdict = stored(kinds.join(matched if split is None else matched.unionByName(split), ["a", "t"], "left").where("n > 1 or size(gone) > 0"), "op4-verdict")
    every = F.array(F.struct(F.lit(0).alias("s"), (F.col("hi") - F.col("lo") + least).cast("int").alias("e")))
    is_first = (F.col("first.row") == F.col("row")) & (F.col("first.lo") == F.col("lo"))
    chosen = F.when(F.col("n") > 1, every).otherwise(F.col("gone")) if keep == "none" else F.when(is_first, F.col("gone")).otherwise(every)
    placed = live.join(verdict, ["a", "t"]).select("row", "lo", F.explode(chosen).alias("x")).select("row", F.struct((F.col("lo") + F.col("x.s")).alias("s"), (F.col("lo") + F.col("x.e")).alias("e")).alias("x"))
    spans = stored(placed.groupBy("row").agg(F.collect_list("x").alias("spans")), "op4-spans")
    release(live, kinds, several, contexts, verdict, *([] if split is None else [split]))
    return spans


def repeated_spans(docs: DataFrame, least: int = LEAST, keep: str = "none") -> DataFrame:
    """row and the spans of bytes to remove, of every row of ``docs`` that has any; spans may overlap."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    return _repeated(_rows(docs), least, keep, levels(least))


def _mask(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes any span covers."""
    return np.cumsum(np.bincount(begin, minlength=size + 1)[:-1] - np.bincount(end, minlength=size + 1)[:-1]) > 0


def report(docs: DataFrame, least: int = LEAST, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spans = repeated_spans(docs, least, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in slices(batch):
                row, spans_ = _flat(part.column("spans"))
                base = starts[row]
                gone = _mask(len(data), base + _numbers(spans_, "s"), base + _numbers(spans_, "e"))
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                begin = starts[:-1][np.diff(starts) > 0]
                edge[begin] = gone[begin]
                removed, edges = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in (gone, edge))
                kept = [hashlib.sha256(data[a:b][~gone[a:b]] if n else data[a:b]).hexdigest() for a, b, n in zip(starts[:-1].tolist(), starts[1:].tolist(), edges.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(starts)), pa.array(removed), pa.array(edges), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs, F.col("doc_id")).join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, least: int = LEAST, keep: str = "first") -> DataFrame:
    """``docs`` without the repeated bytes; a character is removed with any of its bytes."""
    spans = repeated_spans(docs, least, keep)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if found:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    gone = _mask(len(raw), *(np.array([x[k] for x in found]) for k in "se"))
                    lead = np.flatnonzero((raw & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(raw))))
                    text = raw[~gone].tobytes().decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : len(names)]], names)

    row, found = free_names(docs, "row", "spans")
    keyed = docs.select(*names, F.monotonically_increasing_id().alias(row))
    return keyed.join(spans.select(F.col("row").alias(row), F.col("spans").alias(found)), row, "left").select(*names, found).mapInArrow(run, docs.schema)
