"""Vectorised word splitting and hashing over Arrow string columns.

All documents of a slab are handled as one byte buffer: a 256-entry table says
which bytes belong to words, so boundaries, hashes and shingles are numpy
expressions and no Python code runs per word. Word hashes are 64-bit; two
different words of one corpus share one with probability about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words are runs of anything but ASCII white space (0x20, 0x09-0x0D).
BLANK = np.ones(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII digits, small ASCII letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SLAB_BYTES = 1 << 21
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (each input bit reaches each output bit)."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


class Slab:
    """Consecutive rows with their words.

    rows: first and past-the-last row in the column; bounds: word index of each
    row's first word, plus the number of words; start, end: byte offsets in data.
    """

    __slots__ = ("bounds", "data", "end", "first", "offsets", "start", "stop")

    def __init__(self, first, stop, data, offsets, start, end, bounds):
        self.first, self.stop, self.data, self.offsets, self.start, self.end, self.bounds = first, stop, data, offsets, start, end, bounds

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = self.data
        lanes = np.ndarray((n + 1,), "<u8", buffer=padded, strides=(1,))
        length = self.end - self.start
        h = length.astype(np.uint64) * _M1
        h = mix(h ^ (lanes[self.start] & _MASK[np.minimum(length, 8)]))
        more, at = np.flatnonzero(length > 8), 8
        while more.size and at < 64:
            x = lanes[self.start[more] + at] & _MASK[np.minimum(length[more] - at, 8)]
            h[more] = mix((h[more] * _M1) ^ x)
            at += 8
            more = more[length[more] > at]
        for i in more:
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), 7)
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slabs(column: pa.Array, is_word: np.ndarray, lower: bool = False, slab_bytes: int = SLAB_BYTES) -> Iterator[Slab]:
    """The column in slabs of whole rows of about slab_bytes (a longer row is a slab of its own)."""
    offsets, data = string_parts(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slab_bytes, "right")) - 1)
        part, at = data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        if lower:
            part = LOWER[part]
        inside = is_word[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = at[(at > 0) & (at < len(part))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Slab(first, stop, part, at, start, end, np.searchsorted(start, at))
        first = stop


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries (len - n + 1 of them), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power if out is None else mix(out[: len(h) - have - size + 1] * _M1 + power[have : have + len(h) - have - size + 1] * _M3 + np.uint64(size))
            have += size
        if have == n:
            return mix(out + np.uint64(n))
        power = mix(power[:-size] * _M1 + power[size:] * _M2 + np.uint64(size))
        size *= 2


def shingle_sets(slab: Slab, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; fewer words are one shingle, no words none."""
    h, out = slab.hashes(), []
    w = windows(h, n)
    for a, b in zip(slab.bounds[:-1], slab.bounds[1:]):
        if b - a >= n:
            s = np.sort(w[a : b - n + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(windows(h[a:b], int(b - a)) if b > a else h[:0])
    return out


def set_node(s: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of hashes."""
    x = xxhash.xxh64_intdigest(s.tobytes(), len(s))
    return x - (1 << 64) if x >= 1 << 63 else x
