"""Kernels over UTF-8 bytes in numpy, many texts at once: slices of a column, words, hashes of words and of runs of words.

A word is a run of bytes outside space and 0x09-0x0D, ``[^\\x20\\x09-\\x0D]+``. All separators are
ASCII, so splitting bytes is the same as splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call takes. A longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection in which every bit of x reaches every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class Hasher:
    """Two of these with other seeds are independent 64-bit hashes of words and of runs of words."""

    def __init__(self, seed: int) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.table = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        odd = [int(x) << 3 | 3 for x in draw.integers(1 << 50, 1 << 60, 2)]
        self.of_bytes, self.of_words = Powers(odd[0]), Powers(odd[1])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each word data[starts[i]:ends[i]]."""
        up, down = self.of_bytes.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """A hash for each run of n words; len(words) - n + 1 of them, or none."""
        if len(words) < n:
            return np.empty(0, dtype=np.uint64)
        up, down = self.of_words.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])

    def spans(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for each run words[begin[i]:end[i]]."""
        up, down = self.of_words.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    return runs_of(~_SEPARATOR[data])


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each run of places where flags hold."""
    inside = np.zeros(len(flags) + 2, dtype=np.int8)
    inside[1:-1] = flags
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about limit bytes.

    Between two texts stands a byte 0x20, so that no word crosses from one to the next; offsets has
    the first byte of each text, and one more beyond the last separator. Null is the empty text.
    """
    kind = pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        end = min(end, n)
        sizes = np.diff(at[first : end + 1])
        offsets = np.zeros(end - first + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=offsets[1:])
        data = np.full(int(offsets[-1]), 0x20, dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[offsets[1:] - 1] = False
        data[keep] = raw[at[first] : at[end]]
        yield first, end, data, offsets
        first = end
