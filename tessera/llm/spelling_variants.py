"""Operator 12: words one edit apart, by merging the subtrees of a trie.

The words form a trie. Each node's heavy child is the one with most words below;
a word meets fewer than log2(words) light edges on its way. The trie is never held:
a node is a hash of its prefix, the sizes of subtrees are sums by node and next
character, and a word learns from the heavy children of its nodes where its light
edges are. At each of these the word's subtree is merged, small to large, into

* the heavy sibling, with the first character replaced by the heavy one,
* the node itself, with the first character skipped,
* the heavy sibling, with the heavy character put before (a word that ends at the
  node goes this way too),
* the light siblings, with the first character open: members of an open node differ
  there alone, so their number is that of characters, and sums need no pairs.

Where a merged end coincides with a word, the two are one edit apart. Two words part
at one node, so each pair is found there and once. (A skipped or added character
that equals the next one would part them deeper, and is left to that node.) Two
prefixes of one hash would share the choice of a heavy child, which changes the
work and no result.

A word's form is its near word of largest count, if that is FACTOR times its own at
least. Counts rise along forms, so following them ends; it is done by doubling.

Defined cases: null and empty texts have no words; runs of rows without doc_id are
taken unchanged; repeated rows, and rows that share a doc_id, count each; extra
columns are ignored; an empty table gives an empty result. Long texts are read in
stretches, and long words cost their length for each light edge.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import mix
from tessera.llm.common import release, stored, text_or_empty

#: Code points of a word and its occurrences at least; how much larger a form's count must be.
LETTERS, OCCURRENCES, FACTOR = 5, 3, 2
#: One of so many runs of a document loses a character.
THINNED = 97
#: Words that a task counts before it passes them on, and characters of a text that are read at once.
WORDS, STRETCH = 1 << 19, 1 << 20
#: The next character of a word at its end.
END = -1
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_run = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")
_other = re.compile("[^a-zÀ-ÿ]")


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of LETTERS letters or more, stretch by stretch; A-Z in lower case."""
    low, at = text.encode().lower().decode(), 0
    while at < len(low):
        gap = _other.search(low, at + STRETCH) if at + STRETCH < len(low) else None
        to = gap.start() if gap else len(low)
        yield _run.findall(low, at, to)
        at = to


def word_counts(docs: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """word and n: the runs of all texts with their occurrences, after the thinning by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter = Counter()
                for part in _runs(text.as_py()):
                    own.update(part)
                if not doc_id.is_valid:
                    held.update(own)
                    continue
                before = zlib.crc32(b"%d:" % doc_id.as_py())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), before)
                    if h % THINNED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) > WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "word string, n long")
    return counted.where(F.length("word") >= LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def nodes(words: DataFrame) -> DataFrame:
    """A row for each node on the way of each word: the word's id, how deep the node is, its key and the next character (END at the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                texts = part.column(1).to_pylist()
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
                first = np.cumsum(size) - size
                deep = np.arange(len(code)) - np.repeat(first, size)
                power = np.multiply.accumulate(np.full(int(size.max()), _STEP, np.uint64))
                sums = np.concatenate([[_U(0)], np.cumsum(mix(code + _STEP) * power[deep], dtype=np.uint64)])
                # a row for each character and one for the end
                word = np.repeat(np.arange(len(texts)), size + 1)
                deep = np.arange(len(word)) - np.repeat(first + np.arange(len(texts)), size + 1)
                place = first[word] + deep
                key = mix(sums[place] - sums[first[word]] + deep.astype(np.uint64))
                after = np.where(deep < size[word], np.append(code, 0)[place].astype(np.int64), END)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(word)), pa.array(deep.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(after.astype(np.int32))], ["id", "deep", "key", "after"])

    return words.select("id", "word").mapInArrow(run, "id long, deep int, key long, after int")


def light_edges(words: DataFrame) -> DataFrame:
    """id, and the depths of the word's light edges with the heavy character of each node there."""
    steps = nodes(words)
    below = steps.groupBy("key", "after").agg(F.count("*").alias("size"))
    largest = F.max(F.when(F.col("after") != END, F.struct("size", (-F.col("after")).alias("after"))))
    # stored, so that both sides of the join come from plain shuffles, whose hot keys (the nodes near the root) Spark can split
    heavy = stored(below.groupBy("key").agg(largest.alias("most"), F.count("*").alias("ways")).where("ways > 1").select("key", (-F.col("most.after")).alias("heavy")), "op12-heavy")
    light = steps.join(heavy, "key").where("after <> heavy")
    return light.groupBy("id").agg(F.collect_list("deep").alias("deep"), F.collect_list("heavy").alias("heavy"))


def merged(words: DataFrame) -> DataFrame:
    """word, n and the end where a light subtree's merging puts it: a string of letters (``open`` false), or one with an open character."""
    edges = light_edges(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                place, ends, opens = [], [], []
                for k, (word, deep, heavy) in enumerate(zip(*(part.column(c).to_pylist() for c in ("word", "deep", "heavy")), strict=True)):
                    for i, h in zip(deep, heavy, strict=True):
                        head, tail, other = word[:i], word[i + 1 :], chr(h)
                        found = [head + other + word[i:]]
                        if i < len(word):
                            opens.append((k, f"{head}*{tail}"))
                            found.append(head + other + tail)
                            if tail[:1] != word[i]:
                                found.append(head + tail)
                        ends += found
                        place += [k] * len(found)
                from_ = pa.array([*place, *(k for k, _ in opens)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("word").take(from_), part.column("n").take(from_), pa.array([*ends, *(x for _, x in opens)], pa.string()), pa.array([False] * len(ends) + [True] * len(opens))], ["word", "n", "end", "open"])

    return words.join(edges, "id").select("word", "n", "deep", "heavy").mapInArrow(run, "word string, n long, end string, open boolean")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and its near word of largest count (``best``: minus the count, the word). ``words`` has id, word and n, each word once."""
    ends = stored(merged(words), "op12-ends")
    closed = ends.where(f"not open and length(end) >= {LETTERS}").select("end", F.col("word").alias("other"), F.col("n").alias("n_other"))
    pairs = closed.join(words.select(F.col("word").alias("end"), "n"), "end")
    of = lambda word, n: F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))
    both = F.explode(F.array(F.struct(F.col("end").alias("word"), of("other", "n_other").alias("best")), F.struct(F.col("other").alias("word"), of("end", "n").alias("best"))))
    one = F.lit(1).cast("long")
    linked = pairs.select(both.alias("x")).select("x.word", one.alias("n_near"), "x.best")
    # an open node has a member for each character at most
    members = ends.where("open").groupBy("end").agg(F.sort_array(F.collect_list(of("word", "n"))).alias("all")).where("size(all) > 1")
    first, second = F.col("all")[0], F.col("all")[1]
    siblings = members.select(F.explode("all").alias("own"), first.alias("first"), second.alias("second"), (F.size("all") - 1).cast("long").alias("n_near"))
    told = siblings.select("own.word", "n_near", F.when(F.col("own.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return linked.unionByName(told).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root: where following ``forms`` (word, form; each word once, no cycles) ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "op12-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "op12-roots")
        done = after.where("moved").isEmpty()
        release(now)
        if done:
            return after.select("word", "root")
        now = after


def variants(docs: DataFrame, occurrences: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs``."""
    words = stored(word_counts(docs, occurrences).withColumn("id", F.monotonically_increasing_id()), "op12-words")
    near = words.join(near_words(words), "word", "left")
    best_n = -F.col("best.minus")
    fits = best_n >= factor * F.col("n")
    told = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, best_n).alias("form_n")), "op12-forms")
    release(words)
    roots = last_forms(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
