"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling_variants
from tessera.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string"


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_counts(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def told(df):
    assert sorted(df.columns) == ["form", "form_n", "n", "n_near", "root", "word"]
    return Counter(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaaa", "x" * 400, "x" * 401, "Straße", "straÿe", "÷×÷×÷"]
    words = list(base)
    for w in base:
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("abcÀé")
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]]))
    rows = [(None, "null doc null doc " + " ".join(words[:9] * 3)), (0, None), (1, ""), (2, " 1234 \n")]
    for i in range(3, 60):
        rows.append((i, rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(1, 90)))))
    return [*rows, rows[9], (9, "another text of nine " + " ".join(words[:40]))]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("word", "n", "id", "key", "deep", "heavy", "end", "open", "form", "root", "best"):
        df = df.withColumn(name, F.lit("clash"))
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_variants(docs, rows):
    want = Counter(plain_variants(rows))
    assert told(spelling_variants.variants(docs)) == want
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] > 3 for r in want)


def test_nothing(spark):
    for given in ([], [(1, None), (2, "few words")]):
        assert spelling_variants.variants(spark.createDataFrame(given, SCHEMA)).count() == 0


def test_stretches_and_flushes(docs, rows, monkeypatch):
    monkeypatch.setattr(spelling_variants, "STRETCH", 7)
    parts = Counter(w for _, t in rows for part in spelling_variants._runs(t or "") for w in part)
    monkeypatch.undo()
    assert parts == Counter(w for _, t in rows for part in spelling_variants._runs(t or "") for w in part)


def test_light_edges_are_few(spark):
    """Each word meets fewer light edges than the logarithm of the number of words, and its end."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(5, 7))) for _ in range(900)} | {"a" * k for k in range(5, 60)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    for r in spelling_variants.light_edges(df).collect():
        word = words[r["id"]]
        assert sum(d < len(word) for d in r["deep"]) <= 10
        for d, h in zip(r["deep"], r["heavy"], strict=True):
            below = Counter(w[d : d + 1] for w in words if w.startswith(word[:d]))
            del below[""]
            assert below[chr(h)] == max(below.values()) and word[d : d + 1] != chr(h)


def test_long_chains(spark):
    """Forms lead over many steps to the last."""
    n = {"abcde" + "f" * k: 3 * 2**k for k in range(11)}
    text = " ".join(" ".join([w] * k) for w, k in n.items())
    found = {r["word"]: r for r in spelling_variants.variants(spark.createDataFrame([(None, text)], SCHEMA)).collect()}
    last = "abcde" + "f" * 10
    assert {r["root"] for r in found.values()} == {last} and found[last]["form"] is None and found["abcde"]["form"] == "abcdef"


def test_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = Counter(db.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({ORACLE_SQL['op12_spelling_variants']})").fetchall())
    assert told(QUERIES["op12_spelling_variants"](spark, sf)) == want
