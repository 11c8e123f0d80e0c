"""Whole Arrow batches of texts as flat byte arrays, so that numpy handles all documents of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are handled together; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19
#: Longer slices (a single long document each) are worked through in blocks of about this size.
BLOCK_BYTES = 1 << 20

_U = np.uint64
BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts) for runs of rows with about SLICE_BYTES of text; starts has one entry more than rows. Null texts are empty."""
    whole = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    if len(whole) == 0:
        return
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(whole):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def owner(starts: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after, 64-bit hash) of each word; ASCII white space and document ends part words. Blocks end at white space, so memory follows the block and the number of words, not the bytes of a long document."""
    if len(data) <= 2 * BLOCK_BYTES:
        return _words(data, starts)
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK_BYTES)
        while to < len(data) and not SPACE[data[to]]:
            gap = np.flatnonzero(SPACE[data[to : to + BLOCK_BYTES]])
            to = min(len(data), to + (int(gap[0]) if len(gap) else BLOCK_BYTES))
        row, first, after, code = _words(data[at:to], np.clip(starts, at, to) - at)
        parts.append((row, first + at, after + at, code))
        at = to
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = starts[(starts > 0) & (starts < len(data))]
    first[edge] = solid[edge]
    at = np.flatnonzero(first)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    kept = np.flatnonzero(solid)
    begin = np.searchsorted(kept, at)
    length = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, length)
    power = np.multiply.accumulate(np.full(int(length.max()), _STEP, np.uint64))
    code = mix(np.add.reduceat(BYTE_CODE[data[kept]] * power[place], begin) + length.astype(np.uint64))
    return np.searchsorted(starts, at, "right") - 1, at, at + length, code


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n) if len(rows) else np.zeros(n)
