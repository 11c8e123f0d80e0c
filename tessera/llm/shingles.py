"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tessera.llm.bytetext import LOWER, mix, words

WIDTH = 5
_U = np.uint64
_PLACE = np.random.default_rng(99).integers(1, 2**63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and hash. A-Z count as a-z; fewer than WIDTH words are one shingle."""
    n = len(starts) - 1
    row, _, _, code = words(LOWER[data], starts)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=n)
    at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(row) >= WIDTH:
        m = len(row) - WIDTH + 1
        inside = row[WIDTH - 1 :] == row[:m]
        h = np.zeros(m, np.uint64)
        for k in range(WIDTH):
            h += code[k : m + k] * _PLACE[k]
        at, h = row[:m][inside], h[inside]
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        first = np.searchsorted(row, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(WIDTH - 1):
            more = count[few] > k
            short[more] += code[first[more] + k] * _PLACE[k]
        at, h = np.concatenate([at, few]), np.concatenate([h, short + count[few].astype(np.uint64) * _U(0xD6E8FEB86659FD93)])
    h = mix(h)
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return at[fresh], h[fresh]
