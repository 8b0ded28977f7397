"""Vectorised work on the bytes of Arrow string columns: words, 64-bit hashes, shingles.

A batch is cut into slices of about SLICE bytes (a longer text is a slice of its own), so memory
depends on the longest text and not on the batch. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U = np.uint64
#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words for licence scans: ASCII letters and digits, and all of non-ASCII.
WORDISH = np.zeros(256, bool)
WORDISH[0x30:0x3A] = WORDISH[0x41:0x5B] = WORDISH[0x61:0x7B] = True
WORDISH[0x80:] = True


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each row and the end) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows."""
    raw, off = string_bytes(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: Spans are hashed as polynomials in BASE modulo the Mersenne prime P. BASE was drawn at random once (hashes that are put out
#: must not change between runs), so two given strings of at most n bytes collide with a chance of n / P, about n * 4e-19.
P = U((1 << 61) - 1)
BASE = 0x1A3F_5C97_E20B_D64D % ((1 << 61) - 1)
#: Powers are kept for as many bytes; longer texts go on from block to block. So many bytes are worked on at a time.
BLOCK = 1 << 19
STEP = 1 << 15
_VALUE = np.arange(1, 257, dtype=U)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = (x & P) + (x >> U(61))
    np.subtract(x, P, out=x, where=x >= P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, of numbers below 2**61."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    mid = a1 * b0 + a0 * b1
    return reduced(U(2) * a1 * b1 + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + reduced(a0 * b0))


def _run(base: int, size: int) -> np.ndarray:
    out = np.ones(size, U)
    n = 1
    while n < size:
        out[n : 2 * n] = times(out[:n], np.full(1, pow(base, n, int(P)), U))
        n *= 2
    return out


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper 30 and lower 31 bits of BASE ** i, and BASE ** -i, for i below BLOCK."""
    p = _run(BASE, BLOCK)
    return p >> U(31), p & U((1 << 31) - 1), _run(pow(BASE, -1, int(P)), BLOCK)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """S with S[i] the sum, modulo P, of byte values times base powers before i; spans are hashed by span_hash."""
    high, low, _ = powers()
    s = np.zeros(len(raw) + 1, U)
    for at in range(0, len(raw), STEP):
        begin = at % BLOCK
        if not begin:
            sum_high = sum_low = U(0)
            before, scale = s[at], np.full(1, pow(BASE, at, int(P)), U)
        x = _VALUE[raw[at : at + STEP]]
        n = len(x)
        a = x * high[begin : begin + n]
        np.cumsum(a, out=a)
        a += sum_high  # below 2**57
        x *= low[begin : begin + n]
        np.cumsum(x, out=x)
        x += sum_low  # below 2**58
        sum_high, sum_low = a[-1], x[-1]
        x += a >> U(30)
        a &= U((1 << 30) - 1)
        a <<= U(31)
        x += a
        x = reduced(x)
        s[at + 1 : at + n + 1] = reduced(times(x, scale) + before) if at >= BLOCK else x
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), alike wherever they stand."""
    back = powers()[2]
    x = times(reduced(s[end] + (P - s[start])), back[start & (BLOCK - 1)])
    if len(s) > BLOCK:
        blocks = np.array([pow(BASE, -i * BLOCK, int(P)) for i in range(len(s) // BLOCK + 1)], U)
        x = times(x, blocks[start // BLOCK])
    return mix(x)


def gram_hash(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 24 bytes from each place on. They pick and sort out candidates only; equal ones are compared."""
    words = np.ndarray((len(raw) - 7,), np.dtype("<u8"), np.ascontiguousarray(raw), strides=(1,))
    n = len(raw) - 23
    h = words[:n] * U(0x9E3779B97F4A7C15)
    h += words[8 : n + 8] * U(0xD6E8FEB86659FD93)
    h += words[16 : n + 16] * U(0xC2B2AE3D27D4EB4F)
    return mix(h)


class Known:
    """Rows of numbers by 64-bit key, in two sorted levels: new keys go to the small one, and from a quarter of the large one's
    size on it is merged into that, so that a key is moved a few times and not with every addition."""

    LEAST = 1 << 15

    def __init__(self, columns: int):
        none = np.zeros(0, U), np.zeros((0, columns), np.int64)
        self.levels = [none, none]

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.levels)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, row) of each key."""
        told = np.zeros((len(keys), self.levels[0][1].shape[1]), np.int64)
        known = np.zeros(len(keys), bool)
        for mine, rows in self.levels:
            if len(mine):
                at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
                hit = np.flatnonzero(mine[at] == keys)
                known[hit] = True
                told[hit] = rows[at[hit]]
        return known, told

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """New keys, none of them known."""
        small = self._merged(self.levels[1], (keys, rows))
        if len(small[0]) > max(self.LEAST, len(self.levels[0][0]) // 4):
            self.levels = [self._merged(self.levels[0], small), (keys[:0], rows[:0])]
        else:
            self.levels[1] = small

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]


class Growing:
    """Numbers that are added to at the end; the room doubles when it is full."""

    def __init__(self, kind: type):
        self.room, self.size = np.empty(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            wider = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            wider[: self.size] = self.values
            self.room = wider
        self.room[self.size : end] = more
        self.size = end


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(size)
    out = np.ones(ends[-1] if len(ends) else 0, np.int64)
    some = size > 0
    begin, size, ends = begin[some], size[some], ends[some]
    if len(begin):
        out[0] = begin[0]
        out[ends[:-1]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
        np.cumsum(out, out=out)
    return out


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends, and for each row its first run's number (and the end)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order (repeats included), and each row's first one.

    A row with 1 to k-1 words has its whole sequence as its one shingle; a row without words has none.
    """
    n, count = len(words), np.diff(first)
    full = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        full = mix(full ^ words[j : j + len(full)] ^ U(j + 1))
    each = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(at[-1], U)
    rows = np.repeat(np.arange(len(count)), each)
    place = first[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows])
    long = (count >= k)[rows]
    out[long] = full[place[long]]
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = np.zeros(1, U)
        for j in range(count[r]):
            h = mix(h ^ words[first[r] + j] ^ U(j + 1))
        out[at[r]] = mix(h ^ U(0xABCD + count[r]))[0]
    return out, at


def words_of(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends, and first word of each row; words are runs of bytes other than ASCII white space."""
    starts, ends, first = spans(~SPACE[raw], off)
    s = prefix_hash(LOWER[raw] if lower else raw)
    return span_hash(s, starts, ends), starts, ends, first


def lean(run):
    """A task's function that hands memory back to the system when it ends: workers stay for later stages of other shapes."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def framed(docs, keep_columns: list[str], text: str, run, result: str):
    """docs' keep_columns and `result` columns (a schema), by run over batches of the columns k0, k1, ... and the text last.

    Kept columns go by position, so any names will do; one that has the name of a result gets "_in" after its own.
    """
    from pyspark.sql.types import StructType

    told = [f.name for f in StructType.fromDDL(result).fields]
    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep_columns)], docs[text].alias("text"))
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep_columns))
    taken = {n.lower() for n in told}
    names = [c + "_in" if c.lower() in taken else c for c in keep_columns]
    return picked.mapInArrow(lean(run), kinds + result).toDF(*names, *told)
