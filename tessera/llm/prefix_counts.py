"""Operator 11: exact token counts of every prefix, kept as a table that answers questions without encoding again.

A dynamic programme over the bytes of each piece of a text (``byte_bpe``) gives
the last token and the number of tokens of each of its prefixes. Pieces follow
each other independently, so the counts of a text's prefixes are sums. ``index``
keeps what each byte adds, in blocks of about BLOCK characters with the count
before each, so that a question reads one block however long the text is:
``tokens_at`` gives the tokens of the first n bytes, ``longest_within`` the
longest prefix within a budget.

The count at n bytes is that of the text cut there: of white space before a word
the last character belongs to the word, but to the white space when the text ends
there, and special strings are text until they are complete. A position within a
character counts as the character's start. Counts can fall from one prefix to the
next (a longer text can have a longer last token), so ``longest_within`` looks for
the last prefix that fits, not the first that doesn't.

Defined cases: null and empty texts have one empty block and no tokens; repeated
rows, and rows that share a doc_id, are counted and answered each; rows without
doc_id are counted, and no question finds them; extra columns are ignored; an
empty table gives an empty result. Very long texts are worked through in blocks;
only a run of one kind of characters (letters, digits, signs, blanks) is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import INSIDE, ByteBpe, loaded, split, stretches, values
from tessera.llm.common import free_names

LIMIT = 512
#: Characters of a block, bytes of blocks that pass on together, and texts whose pieces are learnt together.
BLOCK, OUT_BYTES, TEXTS = 1 << 16, 1 << 22, 512
INDEX = "row long, doc_id long, block int, first long, n_bytes long, before long, n_tokens long, low long, last boolean, deltas binary"
_blanks = regex.compile(r"\s{2,}(?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _plain(text: str, bpe: ByteBpe, pieces: list[str] | None = None) -> np.ndarray:
    """Deltas of the bytes of a text without special strings."""
    out = np.frombuffer(b"".join(map(bpe.known.__getitem__, split(text, bpe.pre) if pieces is None else pieces)), "<i2")
    ascii_, at, at_byte = text.isascii(), 0, 0
    for m in _blanks.finditer(text):
        run, end = m[0], m.end()
        # cut after the run, all of it is one piece; else its last character is a piece of its own or begins the next
        off = bpe.total(run) - bpe.total(run[:-1]) - bpe.total(run[-1])
        if off:
            at_byte += end - at if ascii_ else len(text[at:end].encode())
            at = end
            if not out.flags.writeable:
                out = out.copy()
            out[at_byte - 1] += off
            out[at_byte + np.argmax(out[at_byte:] != INSIDE)] -= off
    return out


def _simple(text: str, bpe: ByteBpe, size: int) -> bool:
    return 0 < len(text) <= size and not (bpe.special and bpe.special.search(text))


def _blocks(text: str, bpe: ByteBpe, size: int) -> Iterator[np.ndarray]:
    """Deltas of the bytes of a text, in blocks of ``size`` or more."""
    held, n = [], 0
    for part in _parts(text, bpe, size):
        held.append(part)
        n += len(part)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _parts(text: str, bpe: ByteBpe, size: int) -> Iterator[np.ndarray]:
    """Deltas of the bytes of a text, up to each special string and stretch by stretch."""
    found = bpe.special.finditer(text) if bpe.special else ()
    at = 0
    for m in found:
        before = list(stretches(text[at : m.start()], size))
        for part in before[:-1]:
            yield _plain(part, bpe)
        tail = before[-1] if before else ""
        both = _plain(tail + m[0], bpe).copy()
        both[-1] += int(values(_plain(tail, bpe)).sum()) + 1 - int(values(both).sum())
        yield both
        at = m.end()
    for part in stretches(text[at:] if at else text, size):
        yield _plain(part, bpe)


def index(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each block of each text (INDEX): its first byte and number of bytes, the tokens before it and with it, the least count
    of a prefix that ends in it, whether it is the text's last, and what each of its bytes adds (16-bit numbers)."""
    path = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = pc.fill_null(part.column(2), "").to_pylist()
                pieces = [split(t, bpe.pre) if _simple(t, bpe, block) else None for t in texts]
                bpe.known.learn(set().union(*filter(None, pieces)))
                for row, doc_id, text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, pieces, strict=True):
                    first = before = no = 0
                    open_ = (row, doc_id, 0, 0, 0, 0, 0, 0), b""
                    for deltas in _blocks(text, bpe, block) if own is None else (_plain(text, bpe, own),):
                        if no:
                            rows.append((*open_[0], False, open_[1]))
                        reached = before + np.cumsum(values(deltas))
                        open_ = (row, doc_id, no, first, len(deltas), before, int(reached[-1]), int(reached.min()) if no else 0), deltas.tobytes()
                        first, before, no, held = first + len(deltas), int(reached[-1]), no + 1, held + 2 * len(deltas)
                        if held > OUT_BYTES and rows:
                            yield out()
                            rows, held = [], 0
                    rows.append((*open_[0], True, open_[1]))
            if rows:
                yield out()
                rows, held = [], 0

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def report(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text: its last block says it."""
    return blocks.where("last").select("doc_id", (F.col("first") + F.col("n_bytes")).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def tokens_at(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (doc_id, n_bytes) with ``row`` and ``tokens``: the tokens of the text's first n_bytes bytes. Beyond the text's end the whole text counts; negative numbers count as 0; an unknown doc_id gives null."""
    row, tokens = free_names(questions, "row", "tokens")
    of = blocks.select(F.col("doc_id").alias("_of"), *[F.col(c).alias(f"_{c}") for c in ("row", "first", "n_bytes", "before", "last", "deltas")])
    n = F.greatest(F.col("n_bytes").cast("long"), F.lit(0))
    within = (F.col("_first") <= n) & ((n < F.col("_first") + F.col("_n_bytes")) | F.col("_last"))
    joined = questions.join(of, (F.col("doc_id") == F.col("_of")) & within, "left")
    upto = F.least(n - F.col("_first"), F.col("_n_bytes"))
    return joined.select(*[F.col(f"`{c}`") for c in questions.columns], F.col("_row").alias(row), (F.col("_before") + _sum_to("_deltas", upto)).alias(tokens))


def _sum_to(deltas: str, n) -> F.Column:
    @F.arrow_udf("long")
    def total(data: pa.Array, upto: pa.Array) -> pa.Array:
        return pa.array([None if d is None or k is None else int(values(d)[:k].sum()) for d, k in zip(data.to_pylist(), upto.to_pylist(), strict=True)], pa.int64())

    return total(F.col(deltas), n)


def longest_within(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (doc_id, budget) with ``row`` and ``bytes``: the length of the text's longest prefix of at most ``budget`` tokens that ends with a character. Budgets below 0 and unknown doc_ids give null."""
    row, found, no = free_names(questions, "row", "bytes", "_no")
    asked = questions.withColumn(no, F.monotonically_increasing_id())
    of = blocks.select(F.col("doc_id").alias("_of"), *[F.col(c).alias(f"_{c}") for c in ("row", "block", "first", "before", "low", "deltas")])
    joined = asked.join(of, (F.col("doc_id") == F.col("_of")) & (F.col("_low") <= F.col("budget")) & (F.col("budget") >= 0), "left")
    latest = joined.withColumn("_k", F.row_number().over(Window.partitionBy(no, "_row").orderBy(F.desc("_block")))).where("_k = 1")

    @F.arrow_udf("long")
    def last(data: pa.Array, room: pa.Array) -> pa.Array:
        out = []
        for d, k in zip(data.to_pylist(), room.to_pylist(), strict=True):
            if d is None or k is None:
                out.append(None)
                continue
            fits = np.flatnonzero((np.cumsum(values(d)) <= k) & (np.frombuffer(d, "<i2") != INSIDE))
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pa.array(out, pa.int64())

    return latest.select(*[F.col(f"`{c}`") for c in questions.columns], F.col("_row").alias(row), (F.col("_first") + last(F.col("_deltas"), F.col("budget") - F.col("_before"))).alias(found))
