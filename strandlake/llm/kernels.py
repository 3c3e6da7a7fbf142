"""Vectorised text kernels over Arrow string columns.

Every kernel works on one flat byte buffer with document offsets. Tokens are runs of bytes of
one class; as all class limits are ASCII, byte runs and code-point runs are the same in UTF-8.
Hashes are polynomials with random byte values modulo 2**64, taken from prefix sums, so the
hash of a short span costs two look-ups. Long regular sequences can cancel in such polynomials
whatever their base (those of Thue and Morse do), so a longer span is hashed piece by piece, CHUNK
values each, and the pieces are mixed one into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; longer single texts form a slice of their own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but space and \t \n \v \f \r.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MASK = (1 << 64) - 1


@cache
def _seeded(lane: int) -> tuple[np.ndarray, int, int, int, int]:
    rng = np.random.default_rng(1_000_003 + lane)
    p, q = (int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
    values = rng.integers(1, (1 << 64) - 1, 256, dtype=np.uint64)
    return values, p, pow(p, -1, 1 << 64), q, pow(q, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= SLICE_BYTES + 4096:
            _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Values that one polynomial covers; regular sequences of so many lose at most 21 of 64 bits.
CHUNK = 64


class Spans:
    """Hashes of spans of a sequence of 64-bit values: spans(starts, ends)."""

    def __init__(self, values: np.ndarray, base: int, inverse: int):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = inverse

    def piece(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * powers(self.inverse, len(self.sums))[starts])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        long = np.flatnonzero(ends - starts > CHUNK)
        if not len(long):
            return self.piece(starts, ends)
        h = self.piece(starts, np.minimum(ends, starts + CHUNK))
        at, end = starts[long] + CHUNK, ends[long]
        while len(long):
            stop = np.minimum(at + CHUNK, end)
            h[long] = mix(h[long] * np.uint64(0x9FB21C651E98DF25) + self.piece(at, stop))
            more = stop < end
            long, at, end = long[more], stop[more], end[more]
        return h


def byte_spans(buf: np.ndarray, lane: int = 0) -> Spans:
    values, p, p_inv, _, _ = _seeded(lane)
    return Spans(values[buf], p, p_inv)


class Tokens:
    """Words of a slice: starts, ends (bytes), first[d]..first[d+1] the words of document d."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool):
        self.buf = buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        n = len(buf)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word_bytes[buf]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        edge = inside[1:] != inside[:-1]
        self.starts = np.flatnonzero(inside[1:] & (edge | cut))
        self.ends = np.flatnonzero(inside[:-1] & (edge | cut))
        self.first = np.searchsorted(self.starts, offsets)
        self._values: dict[int, np.ndarray] = {}
        self._spans: dict[int, Spans] = {}

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        if lane not in self._values:
            self._values[lane] = byte_spans(self.buf, lane)(self.starts, self.ends)
        return self._values[lane]

    def spans(self, lane: int = 0) -> Spans:
        if lane not in self._spans:
            _, _, _, q, q_inv = _seeded(lane)
            self._spans[lane] = Spans(self.hashes(lane), q, q_inv)
        return self._spans[lane]

    def windows(self, k: int) -> np.ndarray:
        """First words of all windows of k words that lie in one document."""
        if len(self) < k:
            return np.zeros(0, np.int64)
        ok = np.ones(len(self), bool)
        for d in range(k - 1):  # the last k-1 words of each document start none
            last = self.first[1:] - 1 - d
            ok[last[last >= self.first[:-1]]] = False
        return np.flatnonzero(ok)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, and where each begins and ends there."""
        size = self.ends - self.starts
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        out[ranges(begin, size)] = self.buf[ranges(self.starts, size)]
        return out.tobytes(), begin, begin + size

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def string_column(column) -> pa.Array:
    """One string array without nulls (a null text is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets, which begin at 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `limit` bytes."""
    if not len(column):
        return
    buf, offsets = flat(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. for each (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with these keys: whether a row is the first of its key, and how many rows its key has."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group]
    first, count = np.empty(n, bool), np.empty(n, np.int64)
    first[order], count[order] = new, size
    return first, count


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)
