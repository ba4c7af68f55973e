"""Vectorised work on the bytes of many texts at once, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd base: its powers have inverses modulo 2**64, so a word's hash is a difference of prefix sums.
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Texts are taken in slices of at most so many bytes (or one text), which bounds a task's memory.
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(base), np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = powers(BASE, size), powers(BASE_INVERSE, size)
        return self.up, self.down


_POWERS = Powers()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is an empty text."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    buf = col.buffers()[2]
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES):
    """Parts of ``batch`` whose texts hold at most ``limit`` bytes, or one text."""
    sizes = batch.column(batch.schema.get_field_index(col)).cast(pa.large_string()).fill_null("")
    _, offsets = text_buffer(sizes)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each maximal run of bytes in ``is_word`` (256 booleans) within one text."""
    flags = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = flags[1:] != flags[:-1]
    if len(data):
        edge[0], edge[-1] = flags[0], flags[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    inside = cuts[flags[cuts] & flags[cuts - 1]] if len(cuts) else cuts
    bounds = np.flatnonzero(edge)
    if len(inside):  # a text ends and the next begins in the same run
        inside = np.unique(inside)
        bounds = np.sort(np.concatenate([bounds, inside, inside]), kind="stable")
    start, end = bounds[0::2], bounds[1::2]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, independent of its place."""
    up, down = _POWERS.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Lower-cases A-Z in bytes; UTF-8 continuation and lead bytes stay.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Words without blanks, and words of digits, letters and all beyond ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
