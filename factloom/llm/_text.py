"""Vectorised word splitting and hashing over Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C55)


def _class(keep) -> np.ndarray:
    """Byte -> the byte a word has for it, 0 between words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        out[b] = keep(b)
    return out


def _alnum(b: int) -> int:
    if 65 <= b <= 90:
        return b + 32
    return b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0


#: Words of digits, letters and non-ASCII bytes, A-Z lower-cased.
ALNUM = _class(_alnum)
#: Words between ASCII white space, A-Z lower-cased.
LOWER_TOKENS = _class(lambda b: 0 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b or 1)
#: Words between ASCII white space, as written.
RAW_TOKENS = _class(lambda b: 0 if b in (32, 9, 10, 11, 12, 13) else b or 1)

#: For bytes.translate().split(): the words of ALNUM.
ALNUM_SPLIT = bytes(int(b) or 32 for b in ALNUM)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``most`` bytes, or of one longer row."""
    data, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a run of rows. start, end: places in the bytes; row: index of the row; hash: 64 bits."""

    __slots__ = ("bounds", "end", "hash", "row", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        parts, lo, n = [], 0, len(data)
        while lo < n:  # very long rows: cut between words, so that memory stays bounded
            hi = min(n, lo + 2 * SLICE_BYTES)
            while hi < n and table[data[hi]]:
                hi += 1
            parts.append(self._part(data[lo:hi], lo, offsets, table))
            lo = hi
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = join(0, np.int64), join(1, np.int64), join(2, U64)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        #: Words of row i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.start, offsets)

    @staticmethod
    def _part(data: np.ndarray, at: int, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mapped = table[data]
        word = mapped != 0
        cut = offsets[(offsets > at) & (offsets < at + len(data))] - at
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[cut] = False
        after[cut - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        if not len(start):
            return start, end, np.zeros(0, U64)
        long = end - start
        first = np.cumsum(long) - long
        place = np.arange(int(long.sum())) - np.repeat(first, long)
        powers = np.full(int(long.max()), _BASE, U64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=U64)
        total = np.add.reduceat(_BYTE[mapped[word]] * powers[place], first)
        return start + at, end + at, mix(total + long.astype(U64))


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of n consecutive words of a row; a row of fewer words, but not none, has one of all of them."""
    h, count = words.hash, np.diff(words.bounds)
    total = np.zeros(len(h), U64)
    left = words.bounds[1:][words.row] - np.arange(len(h))  # words from here to the end of the row
    for k in range(n):
        ahead = np.zeros_like(h)
        ahead[: len(h) - k] = h[k:]
        ahead[left <= k] = 0
        total += ahead * U64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
    place = np.arange(len(h)) - words.bounds[:-1][words.row]
    keep = (left >= n) | ((place == 0) & (count[words.row] < n))
    return words.row[keep], mix(total[keep])
