"""The classifier's statistics of texts, computed one by one in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality_classifier

CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:!?", b"#*$%&|<>^~=+@\\/_", b"()[]{}\"'`"]


def kind(byte):
    return next((k for k, chars in enumerate(CLASSES) if byte in chars), 9 if byte > 127 else 8)


def plain_statistics(text):
    raw = text.encode()
    n = max(len(raw), 1)
    share = [sum(kind(b) == k for b in raw) / n for k in range(10)]
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    many = max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / many
    spread = math.sqrt(max(sum(x * x for x in lengths) / many - mean**2, 0))
    part = lambda hits: sum(hits) / many
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    lines = raw.count(b"\n") + 1
    return [
        math.log1p(len(raw)), math.log1p(len(words)), *share, mean, spread, part(x <= 3 for x in lengths), part(x >= 12 for x in lengths), part(x == 1 for x in lengths), part(kind(w[-1]) == 6 and len(w) > 1 for w in words), part(kind(w[0]) == 1 for w in words),
        len(set(words)) / math.sqrt(many), max(Counter(words).values(), default=0) / many, (len(windows) - len(set(windows))) / many, math.log1p(len(raw) / lines), math.log1p(lines), sum(a == b for a, b in zip(words, words[1:], strict=False)) / many,
    ]


@pytest.mark.parametrize("seed", range(4))
def test_statistics_like_plain_python(seed):
    rng = random.Random(seed)
    pieces = ["word", "Word", "a", "of", "of", "é", "ß!", "12", "x_", "((", "\n", "\n\n", "\t", "\x0b", "averyverylongword", "--", "\x00", "#tag", "中文"]
    texts = ["", " ", "\n", "one", "a a a a a a a"] + ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = quality_classifier.statistics(data, starts)
    want = np.array([plain_statistics(t) for t in texts])
    assert found.shape == want.shape == (len(texts), quality_classifier.N_STATS)
    np.testing.assert_allclose(found, want, rtol=0, atol=1e-7)
