"""Operator 3: personal data by rules and by bootstrapped contextual patterns.

Rules find the base spans. Their distinct values are seed entities of weight one,
and the one or two words before a span, back to the span before it at most, are
lexical patterns. Spark scores the bipartite graph of patterns and values round by
round. A pattern's confidence in a kind is the weight of the distinct values of that
kind that follow it, over the weight of all known values, half the rest, and one. A
pattern is trusted from CONFIDENCE and SEEDS distinct known values on. Identifier-like
strings that no rule takes and that follow a trusted pattern are discovered, and are
seeds of the following rounds, lighter by DECAY a round, so that what is far from the
rules soon convinces no pattern. Rounds end when nothing new is found; a limit on
them, where one is given, warns when it is met before. Unknown identifiers after trusted patterns become spans of the pattern's kind.

Offsets are code points, ends exclusive. Defined cases: null texts are empty and
stay null in ``redact``; repeated rows get equal results each; spans of two
kinds may overlap, and ``redact`` replaces what overlaps once, under the kind
that starts first; extra columns are carried by ``redact`` and else ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, release, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted from this confidence and this many distinct known values on.
CONFIDENCE = 0.6
SEEDS = 5
DECAY = 0.8

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?[0-9][0-9A-Za-z._/()-]*+(?:[\x20-][0-9(][0-9().-]*+)*+")
_SPOKEN_AT = re.compile(r"\x20?[(\[]at[)\]]\x20?", re.I)
_SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++", re.I)
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @, so local parts are looked for backwards from it, which stays linear in long words."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def spoken(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a bracketed "at", looked for from it in both directions."""
    free = 0
    for m in _SPOKEN_AT.finditer(text):
        start = m.start()
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _SPOKEN_DOMAIN.match(text, m.end()) if free <= start < m.start() else None
        if domain:
            yield start, domain.end()
            free = domain.end()


def unknown_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings of seven digits or more, and spoken addresses, that overlap no base span."""
    found = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and len(_NOT_DIGIT.sub("", m[0])) >= 7]
    found += spoken(text)
    taken = sorted((a, b) for _, a, b in base)
    out, k = [], 0
    for a, b in sorted(found):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and y > a for x, y in taken[k : k + 4]):
            out.append((a, b))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[list[str]]:
    """The patterns before each span: one word, and two words, that no other span lies behind. Each character is looked at once, however long words are."""
    ends = sorted(b for _, _, b in spans)
    out = []
    for _, start, _ in spans:
        k = bisect_right(ends, start)
        before = text[ends[k - 1] if k else 0 : start].lower().rsplit(None, 2)[-2:]
        out.append([" ".join(before[-n:]) for n in (1, 2) if len(before) >= n])
    return out


_MENTION = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and its base (kind 0 to 3) and unknown (kind -1) mentions, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = []
                for text in part.column(3).to_pylist():
                    base = base_spans(text)
                    both = base + [(-1, a, b) for a, b in unknown_spans(text, base)]
                    found.append([{"kind": k, "start": a, "end": b, "value": text[a:b].lower(), "patterns": p} for (k, a, b), p in zip(both, contexts(text, both), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, _MENTION)], ["doc_id", "h1", "h2", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, found array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>")


def trusted_patterns(found: DataFrame, rounds: int | None = None, confidence: float = CONFIDENCE, seeds: int = SEEDS, decay: float = DECAY) -> DataFrame:
    """pattern, kind and confidence of the patterns that are trusted at last, scored over the pattern-instance graph of a mentions table."""
    each = found.select(F.explode("found").alias("m")).select(F.col("m.kind").alias("kind"), F.xxhash64("m.value").alias("value"), F.explode("m.patterns").alias("pattern"))
    edges = stored(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "op3-edges")
    known = stored(edges.where("kind >= 0").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("weight", F.lit(1.0)), "op3-known")
    size = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")), "op3-sizes")
    pairs = edges.select("pattern", "value")
    for round_ in count(1):
        own = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.sum("weight").alias("own"), F.count("*").alias("seeds"))
        tallied = stored(own, "op3-tallied")
        every = tallied.groupBy("pattern").agg(F.sum("own").alias("every"))
        scored = tallied.join(every, "pattern").join(size, "pattern").withColumn("confidence", 2 * F.col("own") / (F.col("every") + F.col("n") + 2))
        patterns = stored(scored.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern", "kind", "confidence"), "op3-patterns")
        best = pairs.join(patterns, "pattern").join(known.select("value"), "value", "left_anti").groupBy("value").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
        new = stored(best.select("value", (-F.col("best.col2")).alias("kind"), F.lit(decay**round_).alias("weight")), "op3-new")
        release(tallied)
        if new.isEmpty():
            return patterns
        if round_ == rounds:
            warnings.warn(f"identifiers are still found in round {rounds}, the last one allowed", stacklevel=2)
            return patterns
        known = stored(known.unionByName(new), "op3-known")


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """h1, h2 and the added spans of each text that has any."""
    unknown = found.select("h1", "h2", F.explode("found").alias("m")).where("m.kind < 0").select("h1", "h2", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.explode("m.patterns").alias("pattern"))
    best = unknown.join(patterns, "pattern").groupBy("h1", "h2", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
    span = F.struct((-F.col("best.col2")).alias("kind"), "start", "end")
    return best.groupBy("h1", "h2").agg(F.collect_list(span).alias("added"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, added spans): both stored."""
    found = stored(mentions(docs), "op3-mentions")
    return found, stored(discovered(found, trusted_patterns(found)), "op3-added")


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(found: DataFrame, added: DataFrame) -> DataFrame:
    """The counts and digest of the base spans of every row, and all its spans."""
    base = F.transform(F.filter("found", lambda m: m["kind"] >= 0), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rows = found.join(added, ["h1", "h2"], "left").select("doc_id", base.alias("base"), "added")

    def count(k: int):
        return F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return rows.select("doc_id", *map(count, range(4)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; all rows and columns stay."""
    _, added = find(docs)
    text = text_or_empty()
    at, names = docs.columns.index("text"), docs.columns
    h1, h2, extra = free_names(docs, "h1", "h2", "added")
    keyed = docs.select(*names, F.xxhash64(text).alias(h1), F.xxhash64(F.lit(1), text).alias(h2))
    more = added.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.transform("added", lambda s: F.array(s["kind"], s["start"], s["end"])).alias(extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [None if t is None else cut(t, base_spans(t) + [tuple(s) for s in extra or ()]) for t, extra in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, part.column(at).type), *part.columns[at + 1 : len(names)]], names)

    joined = keyed.join(more, [h1, h2], "left").select(*names, extra)
    return joined.mapInArrow(run, docs.schema)


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, free = [], 0
    runs: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([k, a, b])
    for k, a, b in runs:
        out += [text[free:a], f"<{KINDS[k].upper()}>"]
        free = b
    return "".join([*out, text[free:]]) if runs else text
