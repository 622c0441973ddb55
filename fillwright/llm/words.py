"""Words and word sequences of an Arrow text column, as numpy arrays.

A worker sees a text column as one byte buffer. Words are cut and hashed over
that buffer with array operations, so the cost is a few nanoseconds a byte
and no Python string is made. Chunks bound the memory of a worker, whatever
the size of the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once.
CHUNK_BYTES = 1 << 20
# Bytes hashed at once; a single longer word is hashed alone.
HASH_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4D  # odd, as every base must be


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (splitmix64's finalizer)."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_UPPER = np.arange(256)
_UPPER[65:91] += 32
_LOWERED_VALUES = _BYTE_VALUES[_UPPER]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true inside the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# What parts words: white space of ASCII, or all of ASCII but letters and digits.
WHITE_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALPHANUMERIC = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _power_cache.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for value in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, value, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        held = (both[0], both[1])
        if size <= 4 * HASH_BYTES:
            _power_cache[base] = held
    return held[0][:n], held[1][:n]


class Words:
    """The words of every row of a text column (null: no words).

    ``start`` and ``end`` are byte places of each word in ``data``; the words
    of row ``i`` are ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool = False):
        text = column.cast(pa.large_string()).fill_null("")
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        _, places, data = text.buffers()
        offsets = np.frombuffer(places, np.int64)[text.offset : text.offset + len(text) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.rows = len(text)
        self.lower = lower
        inside = ~separators[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)  # a row begins here
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)

    def left(self) -> np.ndarray:
        """For each word, the words of its row from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes."""
        table = _LOWERED_VALUES if self.lower else _BYTE_VALUES
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, low + HASH_BYTES, "right")))
            high = self.end[upto - 1]
            power, inverse = _powers(int(high - low), _BASE)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[self.data[low:high]] * power, out=sums[1:])
            s, e = self.start[at:upto] - low, self.end[at:upto] - low
            out[at:upto] = (sums[e] - sums[s]) * inverse[s]
            at = upto
        return mix(out)

    def words(self, low: int, high: int) -> list[bytes]:
        """Words ``low`` to ``high`` as bytes."""
        data = self.data[self.start[low] : self.end[high - 1]].tobytes() if high > low else b""
        base = self.start[low] if high > low else 0
        return [data[s - base : e - base] for s, e in zip(self.start[low:high], self.end[low:high], strict=True)]


class Sequences:
    """Hashes of runs of consecutive word hashes, of any length and place."""

    def __init__(self, hashes: np.ndarray, second: bool = False):
        values = mix(hashes ^ np.uint64(_SECOND)) if second else hashes
        self.n = len(values)
        power, self.inverse = _powers(self.n + 1, _SECOND)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * power[: self.n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The run of ``length`` words at every place that has so many after it."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: self.n - length + 1])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    text = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return values.view(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of ``starts[i]`` to ``starts[i] + counts[i]``, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)
