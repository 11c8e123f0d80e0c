"""Operator 5: hierarchical packing into windows of several lengths.

Each text is tokenised and ends with END_ID. A document goes to the shortest
tier that holds it. A tier's documents are laid end to end and cut into
sequences of exactly that many tokens. Documents beyond the longest tier are cut
into whole long windows; the gap behind their tail is filled from the shorter
tiers. Sequences are dealt to step groups of equal token counts. A task packs
the documents that it reads and keeps a few thousand tokens at its end; these
rests are packed in a second round, a task for each REST_GROUP tasks of the
first, so that no more than one sequence of each such group is padded.

Defined cases: null and empty texts are END_ID alone; repeated rows are packed
each (pieces of rows that share a doc_id can't be told apart by it); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 16 * 4096
END_ID = 2
REST_GROUP = 64
#: Bytes of words and their ids that a Python worker remembers (each word counts 200 more), and texts that are tokenised together.
CACHE_BYTES = 1 << 28
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TEXTS = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"

#: What the word-by-word way rests on. Other tokenizers encode whole texts.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_cache: dict[str, dict[str, bytes]] = {}
_held: dict[str, int] = {}
_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_wise(definition: dict) -> bool:
    """Whether a tokenizer treats words apart and ends each piece's last id with a mark, as ``_learn`` takes for granted."""
    split = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = definition.get("model") or {}
    return (
        (definition.get("normalizer") or {}).get("normalizers") == NORMAL and len(split) == 2 and split[0].get("pattern") == {"Regex": SPLIT} and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
        and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and definition.get("post_processor") is None
    )


def _loaded(path: str) -> tuple:
    """(tokenizer, which ids end a piece, whether words are treated apart)."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        _tokenizers[path] = tokenizer, ends, word_wise(json.loads(tokenizer.to_str()))
    return _tokenizers[path]


def _learn(fresh: set[str], path: str) -> None:
    """Remember the ids of words. A word of letters with marks of TAIL behind is two pieces for the tokenizer, and letters count in lower case, so such words share the ids of their pieces."""
    tokenizer, ends, _ = _loaded(path)
    known = _cache[path]

    def whole(words: list[str]) -> None:
        for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    odd, lack, mixed, tails = [], set(), [], set()
    for w in fresh:
        body = w.rstrip(TAIL)
        low = body.lower()
        if not (low.isalpha() and body.isalpha()) or "Σ" in body:
            odd.append(w)
        elif low == w:
            lack.add(w)
        else:
            tail = w[len(body) :]
            mixed.append((w, low, tail))
            tails.add(tail)
            if low not in known:
                lack.add(low)
    whole([*odd, *(t for t in tails if t not in known)])
    rest = list(lack)
    for at in range(0, len(rest), 2000):
        part = rest[at : at + 2000]
        ids = np.array(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) == len(part) and last[-1] == len(ids):  # each piece ends with one of these ids
            flat, begin = ids.tobytes(), 0
            for x, end in zip(part, (last * 4).tolist(), strict=True):
                known[x] = flat[begin:end]
                begin = end
        else:
            whole(part)
    for w, low, tail in mixed:
        known[w] = known[low] + known[tail]


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text, with END_ID. A word-wise tokenizer drops white space between words, so a word's ids don't depend on its neighbours and are remembered."""
    tokenizer, _, apart = _loaded(path)
    if not apart:
        return [np.array([*e.ids, END_ID], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    known = _cache.setdefault(path, {})
    if _held.get(path, 0) > CACHE_BYTES:
        known.clear()
        _held[path] = 0
    split = [t.replace("\n", " ").split(" ") for t in texts]
    fresh = set().union(*split).difference(known)
    gc.disable()  # looking through millions of small objects again and again costs more than all else
    try:
        _learn(fresh, path)
    finally:
        gc.enable()
    _held[path] = _held.get(path, 0) + sum(200 + 3 * len(w) for w in fresh)
    end = np.array([END_ID], "<u4").tobytes()
    return [np.frombuffer(b"".join(map(known.__getitem__, ws)) + end, "<u4") for ws in split]


class Packer:
    """Packs documents as they come; holds less than one sequence of each tier."""

    def __init__(self, base: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.window, self.step_tokens, self.base = tiers, tiers[-1], step_tokens, base
        self.held: dict[int, list] = {c: [] for c in tiers}
        self.total = dict.fromkeys(tiers, 0)
        self.sequences, self.steps = 0, 0
        self.room: list[list[int]] = []  # [step, tokens free]
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.window if n >= self.window else 0
        for at in range(0, whole, self.window):
            self.emit([(doc_id, at, ids[at : at + self.window], n)], self.window)
        if whole == n:
            return
        tier = self.window if whole else next((c for c in self.tiers if n <= c), self.window)
        self.put(tier, (doc_id, whole, ids[whole:], n))
        if whole:
            self.fill()

    def put(self, tier: int, piece: tuple) -> None:
        self.held[tier].append(piece)
        self.total[tier] += len(piece[2])
        while self.total[tier] >= tier:
            self.emit(self.take(tier, tier), tier)

    def take(self, tier: int, n: int) -> list:
        """The first n tokens that a tier holds; the last piece is cut."""
        got, queue = [], self.held[tier]
        while n:
            doc_id, start, ids, size = queue[0]
            if len(ids) > n:
                got.append((doc_id, start, ids[:n], size))
                queue[0] = (doc_id, start + n, ids[n:], size)
                self.total[tier] -= n
                return got
            got.append(queue.pop(0))
            n -= len(ids)
            self.total[tier] -= len(ids)
        return got

    def fill(self) -> None:
        """Close the open long window with what shorter tiers hold, if they hold enough."""
        gap = self.window - self.total[self.window]
        if sum(self.total[c] for c in self.tiers[:-1]) < gap:
            return
        for c in reversed(self.tiers[:-1]):
            n = min(gap, self.total[c])
            for piece in self.take(c, n):
                self.held[self.window].append(piece)
            self.total[self.window] += n
            gap -= n
        self.emit(self.take(self.window, self.window), self.window)

    def step(self, n: int) -> int:
        """The first open step group with room."""
        for r in self.room:
            if r[1] >= n:
                r[1] -= n
                if not r[1]:
                    self.room.remove(r)
                return self.base + r[0]
        self.steps += 1
        if self.step_tokens > n:
            self.room.append([self.steps - 1, self.step_tokens - n])
        return self.base + self.steps - 1

    def emit(self, pieces: list, tier: int) -> None:
        at, step = 0, self.step(tier)
        for doc_id, start, ids, size in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), size, self.base + self.sequences, at, tier, step, None))
            at += len(ids)
        self.sequences += 1

    def rest(self) -> list:
        """What is held, after whole long windows of it."""
        for c in self.tiers[:-1]:
            pieces, self.held[c], self.total[c] = self.held[c], [], 0
            for p in pieces:
                self.put(self.window, p)
        return self.held[self.window]

    def rows(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out, strict=True)) or [[]] * 10, []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in f"{PIECE}, ids binary".split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece (PIECE); sequences of a tier are full, but for one long window of each group of rests."""
    path = tokenizer or default_tokenizer()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, tiers, step_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = token_ids(pc.fill_null(part.column(1), "").to_pylist(), path)
                for doc_id, own in zip(part.column(0).to_pylist(), ids, strict=True):
                    packer.add(doc_id, own)
                if len(packer.out) > 5000:
                    yield packer.rows()
        for doc_id, start, ids, size in packer.rest():
            packer.out.append((doc_id, start, len(ids), None, size, packer.base, 0, 0, 0, ids.tobytes()))
        if packer.out:
            yield packer.rows()

    def second(key, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        packer = Packer((1 << 62) + (key[0].as_py() << 32), tiers, step_tokens)
        for r in rows.to_pylist():
            packer.put(packer.window, (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        if packer.held[packer.window]:
            packer.emit(packer.held[packer.window], packer.window)
        return pa.Table.from_batches([packer.rows()]).drop_columns("ids")

    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, f"{PIECE}, ids binary"), "op5-pieces")
    group = F.shiftright("sequence_id", 32 + REST_GROUP.bit_length() - 1)
    rests = pieces.where("ids is not null").withColumn("group", group).groupBy("group").applyInArrow(lambda k, t: second(k, t.drop_columns("group")), PIECE)
    return pieces.where("ids is null").drop("ids").unionByName(rests)
