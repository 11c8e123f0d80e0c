"""Operator 13: which tokens of two tokenizers cover the same bytes.

Each byte of a text gets a label: no token ends there, one of A's, one of B's, or
both do. A regular expression scans the labels and cuts them behind each "both";
the labels of such a span say how many tokens of A and of B it groups. Within a
group each label is a link, the pair of tokens that cover the bytes before it.

Texts are cut before each blank that follows another character: there a token of
both ends, whatever comes. A blank that ends a text stays with the word before it,
as B gives no token for a word of no characters. What a word's labels say is
remembered, so a text is put together from the groups and links of its words.

A document's pairs are kept packed, with how often each occurs. Their counts over
the corpus are summed from each task's own sums. The most frequent pairs, HOT at
most, travel to all tasks, which add up most links on the spot; the other pairs of
a document meet their counts in a join, whose keys are rare by construction.

Defined cases: null and empty texts, and texts whose tokens don't give back the
text, have no tokens, zeros and an empty digest, and no links; special strings
are plain text; rows that share a doc_id, and repeated rows, are aligned each and
all count; extra columns are ignored; an empty table gives an empty result. Very
long texts are worked through in stretches that end before a blank.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import definition, raw_tokens
from tessera.llm.common import stored, text_or_empty

#: Characters of texts that are aligned together, and at which longer ones are cut; bytes that a worker remembers of words, and the longest of them.
SLICE, CACHE_BYTES, LONGEST = 1 << 19, 1 << 28, 256
#: Words that A encodes as one text.
TOGETHER = 64
#: Pairs that travel to all tasks at most (17 bytes each), and distinct pairs that a task sums up before it passes them on.
HOT, SUMS = 1 << 20, 1 << 21
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
#: The labels: none, end of a token of A, of B, of both.
LABELS = np.frombuffer(b".ab|", np.uint8)
#: Marks of a link, above its pair: a token of A, or of B, ends with it.
ENDS_A, ENDS_B = 1 << 62, 1 << 61
_PAIR = ENDS_B - 1
_span = re.compile(rb"[^|]*\|")
_cut, _blanks = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r"\s ")
_aligners: dict[tuple[str, str], Aligner] = {}


class ByteLevel:
    """A ``tokenizers`` file of byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        held = definition(path)
        raw = raw_tokens(held["model"])
        self.bytes = {i: raw[t] for t, i in held["model"]["vocab"].items()}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def encode(self, words: list[str], together: int = 1) -> list[list[int]]:
        """The tokens of words with a blank before each; those of ``together`` words, which end with no blank, as one list."""
        texts = [" " + " ".join(words[i : i + together]) for i in range(0, len(words), together)]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordPieces:
    """A ``sentencepiece`` model that changes no character, puts a blank before the text and has no piece with a blank behind another character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        form = sentencepiece_model_pb2.ModelProto()
        form.ParseFromString(self.model.serialized_model_proto())
        rule = form.normalizer_spec
        pieces = [p.piece for p in form.pieces]
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or form.trainer_spec.treat_whitespace_as_suffix or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path} does not keep texts and their words apart")
        self.bytes = {i: bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}

    def encode(self, words: list[str], together: int = 1) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class _Counts(dict):
    """(labels of A, labels of B) of a span."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        got = span.count(b"a") + 1, span.count(b"b") + 1
        if len(span) <= 32:
            self[span] = got
        return got


_counts = _Counts()


def pack(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order of (a, b) with a number each: steps of a, b and n as planes of their bytes, which compress well."""
    return np.concatenate([x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in (np.diff(a, prepend=0), b, n)]).tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(packed, np.uint8).reshape(12, -1)
    da, b, n = (np.ascontiguousarray(planes[k : k + 4].T).view("<u4").ravel().astype(np.int64) for k in (0, 4, 8))
    return np.cumsum(da), b, n


def group_text(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``a1,a2|b1;a3|b2,`` ... as bytes, where each group's text ends behind its mark) of groups of m and n tokens."""
    a_to, b_to = np.cumsum(m), np.cumsum(n)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[np.arange(len(a)) + np.repeat(b_to - n, m)] = a
    ids[np.arange(len(b)) + np.repeat(a_to, n)] = b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[a_to + b_to - n - 1] = ord("|")
    mark[a_to + b_to - 1] = ord(";")
    width, power = np.ones(len(ids), np.int64), 10
    while (longer := ids >= power).any():
        width += longer
        power *= 10
    to = np.cumsum(width + 1)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    out[to - 1] = mark
    for k in range(int(width.max()) if len(width) else 0):
        on = width > k
        out[to[on] - 2 - k] = ord("0") + ids[on] // 10**k % 10
    return out, to[a_to + b_to - 1]


class Aligner:
    """Words (the blank before each is not written) with the text of their groups and their links."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), WordPieces(path_b)
        self.width = max(self.b.bytes) + 1
        self.sizes = [np.zeros(max(t.bytes) + 1, np.int64) for t in (self.a, self.b)]
        for size, t in zip(self.sizes, (self.a, self.b), strict=True):
            size[list(t.bytes)] = [len(x) for x in t.bytes.values()]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.lost: set[str] = set()
        self.long: list[str] = []
        self.held = 0

    def learn(self, words: set[str]) -> None:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.lost.clear()
            self.held = 0
        fresh = [w for w in words if w not in self.known]
        self.long = [w for w in fresh if len(w) > LONGEST]
        open_ = [w for w in fresh if not w or w[-1].isspace()]  # a blank behind them is no cut
        if open_:
            fresh = [w for w in fresh if w and not w[-1].isspace()]
        found = [t.encode(fresh, TOGETHER) + t.encode(open_) for t in (self.a, self.b)]
        fresh += open_
        raw = [f" {w}".encode() for w in fresh]
        joined = b"".join(raw)
        if any(b"".join(map(t.bytes.__getitem__, chain.from_iterable(ids))) != joined for t, ids in zip((self.a, self.b), found, strict=True)):
            # some word doesn't come back: look at each
            found = [t.encode(fresh) for t in (self.a, self.b)]
            back = [all(b"".join(map(t.bytes.__getitem__, ids[k])) == r for t, ids in zip((self.a, self.b), found, strict=True)) for k, r in enumerate(raw)]
            lost = [w for w, ok in zip(fresh, back, strict=True) if not ok]
            self.lost.update(lost)
            self.known.update(dict.fromkeys(lost, (b"", b"")))
            keep = [k for k, ok in enumerate(back) if ok]
            fresh, raw, found = [fresh[k] for k in keep], [raw[k] for k in keep], [[ids[k] for k in keep] for ids in found]
        if fresh:
            self._align(fresh, np.cumsum([len(r) for r in raw]), *[np.fromiter(chain.from_iterable(ids), np.int64) for ids in found])

    def _align(self, words: list[str], to: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Label the bytes of the words, which end at ``to``, scan the labels and remember what each word has of groups and links."""
        labels = np.zeros(int(to[-1]), np.uint8)
        labels[np.cumsum(self.sizes[0][ids_a]) - 1] = 1
        labels[np.cumsum(self.sizes[1][ids_b]) - 1] |= 2
        spans = _span.findall(LABELS[labels].tobytes())
        counts = np.array(list(map(_counts.__getitem__, spans)), np.int64).reshape(-1, 2)
        group_to = np.searchsorted(np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans))), to, "right")  # groups up to the end of each word
        text, text_to = group_text(ids_a, ids_b, counts[:, 0], counts[:, 1])
        at = np.flatnonzero(labels)
        ends_a, ends_b = labels[at] & 1, labels[at] >> 1
        links = ids_a[np.cumsum(ends_a, dtype=np.int64) - ends_a] * self.width + ids_b[np.cumsum(ends_b, dtype=np.int64) - ends_b]
        links += ends_a * np.int64(ENDS_A) + ends_b * np.int64(ENDS_B)
        link_to = (8 * np.searchsorted(at, to)).tolist()
        text, links, t, k = text.tobytes(), links.tobytes(), 0, 0
        for w, t_to, k_to in zip(words, text_to[group_to - 1].tolist(), link_to, strict=True):
            self.known[w] = text[t : t_to - 1], links[k:k_to]
            t, k = t_to, k_to
        self.held += 300 * len(words) + len(text) + len(links)

    def forget(self) -> None:
        """Long words are not kept."""
        for w in self.long:
            del self.known[w]
            self.lost.discard(w)
        self.long = []


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def words_of(text: str) -> list[str]:
    """The words of a text that a blank was put before, without the blank before each."""
    if not text.endswith(" ") and _blanks.search(text) is None:
        return text[1:].split(" ")
    cuts = [0, *(m.start() for m in _cut.finditer(text)), len(text)]
    return [text[i + 1 : j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _stretches(text: str, size: int) -> Iterator[str]:
    """A blank and the text, cut before blanks."""
    text, at = " " + text, 0
    while at < len(text):
        cut = _cut.search(text, at + size) if at + size < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


class Document:
    """What is known of a document's stretches so far."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id, self.n, self.sha, self.lost, self.pairs = row, doc_id, np.zeros(4, np.int64), None, False, []

    def add(self, n: list[int], text: bytes, keys: np.ndarray, count: np.ndarray) -> None:
        self.n += n
        if self.sha is None:
            self.sha = hashlib.sha256()
        else:
            self.sha.update(b";")
        self.sha.update(text)
        self.pairs.append((keys, count))
        if len(self.pairs) > 64:
            self.pairs = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs[0] if len(self.pairs) == 1 else _summed(self.pairs)

    def result(self, width: int) -> tuple:
        if self.lost or self.sha is None:
            return self.row, self.doc_id, 0, 0, 0, 0, "", None
        keys, count = self.merged()
        return self.row, self.doc_id, *self.n.tolist(), self.sha.hexdigest(), pack(keys // width, keys % width, count)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _align(work: list[tuple[Document, str]], by: Aligner) -> None:
    """Add the tokens, groups and pairs of stretches to their documents."""
    words = [words_of(text) for _, text in work]
    by.learn(set().union(*words))
    on = []
    for (doc, _), own in zip(work, words, strict=True):
        doc.lost = doc.lost or bool(by.lost) and not by.lost.isdisjoint(own)
        if not doc.lost:
            on.append((doc, list(map(by.known.__getitem__, own))))
    by.forget()
    if not on:
        return
    links = np.frombuffer(b"".join([x for _, own in on for _, x in own]), np.int64)
    to = np.cumsum([sum([len(x) for _, x in own]) for _, own in on]) // 8
    first = to - np.diff(to, prepend=0)
    ends = [np.add.reduceat((links & mark != 0).astype(np.int64), first) for mark in (ENDS_A, ENDS_B)]
    groups = np.add.reduceat((links >= ENDS_A + ENDS_B).astype(np.int64), first)
    room = len(by.sizes[0]) * by.width
    keys, times = np.unique(np.repeat(np.arange(len(on)) * room, np.diff(to, prepend=0)) + (links & _PAIR), return_counts=True)
    key_to = np.searchsorted(keys, np.arange(1, len(on) + 1) * room)
    k = 0
    for j, (doc, own) in enumerate(on):
        n_a, n_b, n = int(ends[0][j]), int(ends[1][j]), int(groups[j])
        doc.add([n_a, n_b, n, n_a + n_b - n], b";".join([t for t, _ in own]), keys[k : key_to[j]] - j * room, times[k : key_to[j]])
        k = key_to[j]


def aligned(docs: DataFrame, path_a: str, path_b: str, size: int = SLICE) -> DataFrame:
    """A row for each row of ``docs`` (ALIGNED), with its distinct pairs packed."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [*[pa.int64()] * 6, pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(path_a, path_b)
        documents: list[Document] = []
        work: list[tuple[Document, str]] = []
        held = 0

        def out() -> pa.RecordBatch:
            _align(work, by)
            rows = [d.result(by.width) for d in documents]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc, text = Document(row.as_py(), doc_id.as_py()), text.as_py()
                documents.append(doc)
                for part in _stretches(text, size) if text else ():
                    work.append((doc, part))
                    held += len(part)
                    if held > size:
                        _align(work, by)
                        work, held = [], 0
                if len(documents) >= 512:
                    yield out()
                    documents, work, held = [], [], 0
        if documents:
            yield out()

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, sums: int = SUMS) -> DataFrame:
    """a, b and the corpus-wide number of links n of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0] >> 32), pa.array(part[0] & 0xFFFFFFFF), pa.array(part[1])], ["a", "b", "n"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                if packed:
                    a, b, n = unpack(packed)
                    held.append((a << 32 | b, n))
                    size += len(n)
                if size > 2 * sums:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > sums:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(_summed(held))

    return rows.select("pairs").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = stored(aligned(docs, path_a, path_b), "op13-rows")
    counts = stored(pair_counts(rows), "op13-counts")
    # a row for each id of B's vocabulary at most
    best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    counts = stored(counts.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "op13-best")

    least, total = 0, 0
    for power, pairs in sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power")).count().collect()), reverse=True):
        total += pairs
        if total > hot:
            least = 2 ** (power + 1)
            break
    found = counts.where(F.col("n") >= least).toArrow()
    key = found.column("a").to_numpy() << 32 | found.column("b").to_numpy()
    order = np.argsort(key)
    known = docs.sparkSession.sparkContext.broadcast((key[order], found.column("n").to_numpy()[order], found.column("best").to_numpy()[order]))
    told = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    form = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs binary"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n_of, best_of = known.value
        for batch in batches:
            sums: list[tuple] = []
            for packed in batch.column("pairs").to_pylist():
                if not packed:
                    sums.append((0, 0, None))
                    continue
                a, b, n = unpack(packed)
                pair = a << 32 | b
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                cold = ~hit
                sums.append((int(n[hit][best_of[at[hit]]].sum()), int((n[hit] * n_of[at[hit]]).sum()), pack(a[cold], b[cold], n[cold]) if cold.any() else None))
            columns = zip(*sums, strict=True) if sums else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True))], [*told, "n_best", "count_sum", "pairs"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b, n = unpack(packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row)), pa.array(a), pa.array(b), pa.array(n)], ["row", "a", "b", "times"])

    done = rows.mapInArrow(add_up, form)
    if least:
        done = stored(done, "op13-sums")
        cold = done.where("pairs is not null").select("row", "pairs").mapInArrow(spread, "row long, a long, b long, times long")
        rare = cold.join(counts.where(F.col("n") < least), ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        zero = F.lit(0).cast("long")
        done = done.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", zero), "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)})
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
