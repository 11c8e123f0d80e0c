"""Token counts of prefixes and alignment of tokenizers against the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, prefix_counts, token_alignment

SCHEMA = "doc_id long, text string"
PARTS = ["a", "th", "e", "ing", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "'x", "1", "234", "!", "...", "é", "ß", "é", "中", "😀", " ", "　", "<|endoftext|>", "<|endof", "<s>", "\x1c", "\x85", "\x00", "====", "ÃÂ", "՘", " "]


def random_texts(n, seed, longest=14, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(paths):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(paths[0])


@pytest.fixture(scope="module")
def texts():
    long_ = " ".join(random_texts(900, 5))
    return [None, "", " ", "a", "Hello  world, it's 'reading' time", long_, "x" * 3000, "0123456789" * 200, *random_texts(60, 2), "twice the same", "twice the same", "a▁b", "\n\n  indented\n\n\n"]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    """Stored, with a row without doc_id, a repeated doc_id and columns whose names the operators use inside."""
    rows = [*enumerate(texts), (3, "another text of three"), (None, "no id here"), (4, texts[4])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "block", "first", "n_bytes", "before", "low", "last", "deltas", "pairs", "a", "b", "n", "n_a", "best", "most", "times"):
        df = df.withColumn(name, F.lit("clash"))
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df.repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return spark.createDataFrame([], SCHEMA)


def counted(text, bpe, size):
    deltas = np.concatenate([*prefix_counts._blocks(text, bpe, size), np.zeros(0, "<i2")])
    return deltas, np.cumsum(byte_bpe.values(deltas))


def test_tokens_of_pieces(paths, library):
    bpe = byte_bpe.loaded(paths[0])
    words = [w for t in random_texts(200, 1, 8, ["th", "e", "ing", "er", "q", "aaa", "é", "ÃÂ", "=", "re"]) for w in (t, " " + t)]
    for w in words:
        want = [i for p in byte_bpe.split(w) for i in library.encode(p, add_special_tokens=False).ids]
        assert [i for p in byte_bpe.split(w) for i in bpe.encode(p.encode())] == want


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_every_prefix(paths, library, size):
    bpe = byte_bpe.loaded(paths[0])
    for text in random_texts(250, 7 + size):
        deltas, reached = counted(text, bpe, size)
        assert len(deltas) == len(text.encode())
        at = 0
        for i, c in enumerate(text):
            at += len(c.encode())
            assert reached[at - 1] == len(library.encode(text[: i + 1], add_special_tokens=False).ids), text[: i + 1]
        ends = set(np.cumsum([len(c.encode()) for c in text]) - 1)
        assert all((d != byte_bpe.INSIDE) == (i in ends) for i, d in enumerate(deltas))


def test_characters_of_all_planes(paths, library):
    """The split agrees with the library's for every character, known to this Python or not."""
    bpe = byte_bpe.loaded(paths[0])
    for at in range(0, 0x110000, 4096):
        text = "".join(f"\na{chr(c)}1{chr(c)}!{chr(c)} " for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000)
        assert byte_bpe.split(text, bpe.pre) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_pieces_learnt_together_or_apart(paths):
    bpe = byte_bpe.loaded(paths[0])
    pieces = {p for t in random_texts(300, 11) for p in byte_bpe.split(t)}
    known = byte_bpe.Pieces(bpe)
    known.learn(pieces)
    assert all(known[p] == byte_bpe.Pieces(bpe)[p] for p in pieces)


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("block", [50, 1 << 16])
def test_counts(docs, none, library, texts, block):
    index = prefix_counts.index(docs, block=block)
    want = Counter()
    for i, t in [*enumerate(texts), (3, "another text of three"), (None, "no id here"), (4, texts[4])]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, prefix_counts.report(index).collect())) == want
    assert prefix_counts.report(prefix_counts.index(none)).count() == 0
    assert (index.where("doc_id = 5").count() > 50) == (block == 50)


def test_questions(spark, docs, library, texts):
    index = prefix_counts.index(docs, block=40)
    tokens = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    asked = [(i, rng.randint(0, len((t or "").encode()) + 2), rng.randint(0, 12)) for i, t in enumerate(texts) if i not in (3, 4)] + [(5, 999, 40), (5, 10**6, 10**6), (6, -4, -1), (10**6, 3, 3)]
    questions = spark.createDataFrame(asked, "doc_id long, n_bytes long, budget long").withColumn("row", F.lit("clash"))
    for r in prefix_counts.tokens_at(index, questions).collect():
        if r["doc_id"] == 10**6:
            assert r["tokens"] is None
        else:
            raw = (texts[r["doc_id"]] or "").encode()[: max(0, r["n_bytes"])]
            assert r["tokens"] == tokens(raw.decode(errors="ignore"))
    found = prefix_counts.longest_within(index, questions).collect()
    assert len(found) == len(asked)
    for r in found:
        if r["doc_id"] == 10**6 or r["budget"] < 0:
            assert r["bytes"] is None
        else:
            text = texts[r["doc_id"]] or ""
            if len(text) > 400:
                cut = text.encode()[: r["bytes"]].decode()
                assert tokens(cut) <= r["budget"] and (cut == text or tokens(text[: len(cut) + 1]) > r["budget"])
            else:
                assert r["bytes"] == max(len(text[:k].encode()) for k in range(len(text) + 1) if tokens(text[:k]) <= r["budget"])
    two = prefix_counts.tokens_at(index, spark.createDataFrame([(3, 100), (4, 100)], "doc_id long, n_bytes long")).collect()
    assert Counter((r["doc_id"], r["tokens"]) for r in two) == Counter([(3, tokens("a")), (3, tokens("another text of three")), (4, tokens(texts[4])), (4, tokens(texts[4]))])


def plain_alignment(texts, paths):
    """Rows of operator 13 from the libraries' own encodings of whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    back = {c: x for c, x in byte_bpe.byte_of_char().items()}
    rows, all_links = [], []
    for i, text in texts:
        bytes_a, bytes_b = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append([i, 0, 0, 0, 0, ""])
            all_links.append([])
            continue
        groups, links, x, y, to_a, to_b = [([], [])], [], 0, 0, 0, 0
        while x < len(ids_a):
            links.append((ids_a[x], ids_b[y]))
            end_a, end_b = to_a + len(bytes_a[x]), to_b + len(bytes_b[y])
            if end_a <= end_b:
                groups[-1][0].append(ids_a[x])
            if end_b <= end_a:
                groups[-1][1].append(ids_b[y])
            if end_a <= end_b:
                x, to_a = x + 1, end_a
            if end_b <= end_a:
                y, to_b = y + 1, end_b
            if end_a == end_b:
                groups.append(([], []))
        text_ = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups[:-1])
        rows.append([i, len(ids_a), len(ids_b), len(groups) - 1, len(links), hashlib.sha256(text_.encode()).hexdigest()])
        all_links.append(links)
    n = Counter(p for links in all_links for p in links)
    most = {}
    for (x, y), k in n.items():
        most[y] = max(k, most.get(y, 0))
    return [(*r[:5], sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), r[5]) for r, links in zip(rows, all_links, strict=True)]


@pytest.mark.parametrize("hot", [0, 40, 1 << 20])
def test_alignment(docs, none, texts, paths, hot):
    rows = [*enumerate(texts), (3, "another text of three"), (None, "no id here"), (4, texts[4])]
    found = token_alignment.align(docs, hot=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter(plain_alignment(rows, paths))
    assert token_alignment.align(none, hot=hot).count() == 0


def test_alignment_of_stretches(docs, paths):
    """A long text in many stretches gives the row that it gives whole."""
    whole = {r["row"]: r for r in token_alignment.aligned(docs, *paths).collect()}
    parts = {r["row"]: r for r in token_alignment.aligned(docs, *paths, size=30).collect()}
    assert whole == parts


def test_packed_pairs_and_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 40, 500))
    a, b, n = key >> 20, key & 0xFFFFF, rng.integers(1, 1 << 31, len(key))
    assert all((x == y).all() for x, y in zip((a, b, n), token_alignment.unpack(token_alignment.pack(a, b, n)), strict=True))
    rows = [(token_alignment.pack(np.array(sorted(x)), np.array(sorted(x)) % 3, np.ones(len(x), int)),) for x in (rng.choice(50, 20, False).tolist() for _ in range(40))]
    df = spark.createDataFrame([*rows, (None,)], "pairs binary")
    assert Counter(map(tuple, token_alignment.pair_counts(df, 30).collect())) == Counter(map(tuple, token_alignment.pair_counts(df).collect()))


def test_alignment_of_a_last_blank(spark, paths, tmp_path):
    """A text that ends with one blank keeps its tokens, beside texts that don't come back too."""
    texts = ["a ", "two words ", "more\nlines of text ", " ", "  ", "a", "a  ", "a\t ", "a▁b ", "a▁ ", "x" * 300 + " ", "中 ", "<|endoftext|> "]
    spark.createDataFrame([*enumerate(texts)], SCHEMA).repartition(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    want = plain_alignment([*enumerate(texts)], paths)
    assert [r[1] > 0 for r in want] == ["▁" not in t for t in texts]
    assert sorted(map(tuple, token_alignment.align(docs).collect())) == sorted(want)
    whole, parts = ({r["row"]: r for r in token_alignment.aligned(docs, *paths, size=n).collect()} for n in (1 << 19, 1))
    assert whole == parts
