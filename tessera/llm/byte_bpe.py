"""Byte-level BPE vocabularies: the pieces that a text falls into, and token counts of every prefix of a piece."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import regex

#: Fixed value: the pattern that byte-level pre-tokenizers split texts with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a worker's memory of pieces holds at most (each piece counts 200 more), length of the longest piece that it keeps, and number of token pairs.
CACHE_BYTES, LONGEST, PAIRS = 1 << 28, 64, 1 << 20
NEVER = sys.maxsize
#: In the place of what a byte adds: it doesn't end a character, and adds nothing.
INSIDE = -(1 << 15)

_split = regex.compile(SPLIT)
#: Before these characters a piece ends whatever comes before or after; the second where categories may be unsettled.
_edge, _gap = regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=\S)\s"), regex.compile(r"(?<=\S)\s")
_loaded: dict[str, ByteBpe] = {}


def _unsettled() -> tuple[re.Pattern, re.Pattern]:
    """Characters without a category in Python's tables: libraries of other Unicode versions may know one. Before, a faster pattern: any character from the first of them on."""
    runs, begin = [], None
    for c in range(sys.maxunicode + 2):
        open_ = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if open_ and begin is None:
            begin = c
        elif not open_ and begin is not None:
            runs.append((begin, c - 1))
            begin = None
    return re.compile(f"[\\U{runs[0][0]:08x}-\\U{sys.maxunicode:08x}]"), re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


_late, _odd = _unsettled()


def unsettled(text: str) -> bool:
    return not text.isascii() and bool(_late.search(text) and _odd.search(text))


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split(text: str, pre=None) -> list[str]:
    """The pieces of a text, as the tokenizer's own pre-tokenizer ``pre`` gives them."""
    if pre is not None and unsettled(text):
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
    return _split.findall(text)


def stretches(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters that are split on their own as in the whole text."""
    at = 0
    edges = _gap if len(text) > size and unsettled(text) else _edge
    while at < len(text):
        edge = edges.search(text, at + size) if at + size < len(text) else None
        to = edge.start() if edge else len(text)
        yield text[at:to]
        at = to


class Pieces(dict):
    """Deltas of pieces: bytes of 16-bit numbers, one for each byte of the piece. They are made when first asked for, or many at once by ``learn``."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.held = bpe, 0

    def learn(self, pieces: set[str]) -> None:
        """Remember these pieces. In order of their bytes, each goes on where it parts from the one before."""
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        before, table = b"", ([0], [0])
        for piece in sorted(p for p in pieces if len(p) <= LONGEST and p not in self):
            raw = piece.encode()
            same = len(os.path.commonprefix((before, raw)))
            for column in table:
                del column[same + 1 :]
            self.bpe.extend(raw, *table)
            self[piece] = self.bpe.deltas(piece, table[0])
            self.held += 200 + 3 * len(raw)
            before = raw

    def __missing__(self, piece: str) -> bytes:
        return self.bpe.deltas(piece, self.bpe.counts(piece.encode())[0])


def definition(path: str) -> dict:
    """What a ``tokenizers`` file holds, if it is plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, pre = held["model"], held.get("pre_tokenizer") or {}
    odd = held.get("normalizer") or held.get("post_processor") or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    return held


def raw_tokens(model: dict) -> dict[str, bytes]:
    """The bytes of each token."""
    to_byte = byte_of_char()
    return {token: bytes(map(to_byte.__getitem__, token)) for token in model["vocab"]}


class ByteBpe:
    """Tokens, merges and added tokens of a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        held = definition(path)
        model, added = held["model"], held.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take in what stands beside them")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        raw = raw_tokens(model)
        self.bytes = {i: raw[token] for token, i in model["vocab"].items()}
        n = max(self.bytes) + 1
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            z = model["vocab"][x + y]
            pair = model["vocab"][x], model["vocab"][y]
            self.rank.setdefault(pair, r)
            if self.born[z] < 0:
                self.born[z], (self.left[z], self.right[z]) = r, pair
        # only tokens that their own bytes are encoded as can end a prefix
        sound = [False] * n
        for i in sorted(self.bytes, key=lambda i: self.born[i]):
            if self.born[i] < 0:
                sound[i] = len(self.bytes[i]) == 1
            else:
                a, b = self.left[i], self.right[i]
                sound[i] = sound[a] and sound[b] and self.seam(a, b) == self.born[i]
        self.ids = {b: i for i, b in self.bytes.items() if sound[i]}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError(f"{path} lacks tokens of single bytes")
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {e: sorted(s | {1}, reverse=True) for e, s in ends.items()}
        self.pairs: dict[int, bool] = {}
        self.known = Pieces(self)

    def seam(self, x: int, y: int) -> int:
        """The first merge that would join the two tokens across the seam between them, NEVER if none would. Merges run by rank, the
        leftmost of a rank first; a token at the seam lives from the merge that makes it to the merge that takes it in."""
        first, taken = NEVER, NEVER
        while True:
            v, also = y, NEVER
            while True:
                r = self.rank.get((x, v))
                if r is not None and r < first and self.born[x] < r < taken and self.born[v] < r <= also:
                    first = r
                if self.born[v] < 0:
                    break
                also, v = self.born[v], self.left[v]
            if self.born[x] < 0:
                return first
            taken, x = self.born[x], self.right[x]

    def _stay(self, x: int, y: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        stay = self.pairs[x << 32 | y] = self.seam(x, y) == NEVER
        return stay

    def extend(self, piece: bytes, count: list[int] | array, last: list[int] | array) -> None:
        """Go on with the tables of a piece: (tokens of each prefix, last token of each), from the empty prefix on.

        A sequence of tokens is the encoding of its bytes if each two neighbours are, so a prefix ends with the one token that stays
        apart from the last token of the prefix before it, and has one token more than that prefix."""
        ids, lengths, short, pairs = self.ids, self.lengths, (1,), self.pairs
        for p in range(len(count), len(piece) + 1):
            for size in lengths.get(piece[max(0, p - 2) : p], short):
                q = p - size
                if q >= 0:
                    t = ids.get(piece[q:p])
                    if t is not None and (not q or (stay := pairs.get(last[q] << 32 | t)) or stay is None and self._stay(last[q], t)):
                        count.append(count[q] + 1)
                        last.append(t)
                        break

    def counts(self, piece: bytes) -> tuple[array, array]:
        """The tables of a piece."""
        count, last = array("i", [0]), array("i", [0])
        self.extend(piece, count, last)
        return count, last

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of a piece, read from the end of the table."""
        _, last = self.counts(piece)
        out, p = [], len(piece)
        while p:
            out.append(last[p])
            p -= len(self.bytes[last[p]])
        return out[::-1]

    def deltas(self, piece: str, count: list[int] | array) -> bytes:
        """What each byte of a piece adds to the tokens of the text up to it. Within a character nothing is added before its last byte; of
        contractions, "'r" alone would be two pieces."""
        if piece.isascii():
            if piece in ("'re", "'ve", "'ll"):
                count = [0, 1, 2, count[3]]
            return array("h", map(sub, count[1:], count)).tobytes()
        out, p = array("h"), 0
        for c in piece:
            size = len(c.encode())
            out.extend([INSIDE] * (size - 1))
            out.append(count[p + size] - count[p])
            p += size
        return out.tobytes()

    def total(self, piece: str) -> int:
        return int(values(self.known[piece]).sum())


def values(deltas: bytes | np.ndarray) -> np.ndarray:
    """What each byte adds, as numbers."""
    out = np.frombuffer(deltas, "<i2")
    return np.where(out == INSIDE, 0, out).astype(np.int64)


def loaded(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
