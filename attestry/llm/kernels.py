"""Vectorised text kernels: word and n-gram hashes over the bytes of Arrow batches.

Hashes of byte ranges come from one prefix sum of b[i] * B**i modulo 2**64, so
a word, a line or an n-gram costs a few array operations, never a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_lut() -> np.ndarray:
    """ASCII letters in lower case and digits stay, bytes of other scripts stay,
    ASCII blanks and signs become 0, which separates words."""
    lut = np.arange(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        lut[i] = ord(c.lower()) if c.isalnum() else 0
    return lut


def blank_lut() -> np.ndarray:
    """Only ASCII blanks separate; all else stays as it is."""
    lut = np.arange(256, dtype=np.uint8)
    lut[[0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
    return lut


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets from 0; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
    n = len(arr)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Else a worker, which serves many tasks, keeps what its largest batch took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str, target: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about target bytes of text each, and at most so many
    rows; a document is never cut."""
    at = batch.schema.get_field_index(column)
    _, offs = bytes_of(batch.column(at))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offs, offs[lo] + target, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


class Kernel:
    """Power tables, grown as needed and kept for the partition."""

    def __init__(self) -> None:
        self.pw = np.ones(1, U)
        self.ipw = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.pw) < n:
            n = max(n, 1 << 16)
            for name, base in (("pw", BASE), ("ipw", INVERSE)):
                x = np.full(n, base, U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))

    def prefix(self, b: np.ndarray) -> np.ndarray:
        self.grow(len(b) + 1)
        c = np.zeros(len(b) + 1, U)
        np.cumsum((b.astype(U) + U(1)) * self.pw[: len(b)], out=c[1:])
        return c

    def ranges(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, equal for equal bytes wherever they stand."""
        return mix((c[ends] - c[starts]) * self.ipw[starts] + (ends - starts).astype(U) * U(STEP))

    def words(self, text: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word, and the n + 1 offsets of documents in
        words. Each CJK or Hangul character is a word of its own."""
        b = lut[text]
        w = b != 0
        st = w.copy()
        st[1:] &= ~w[:-1]
        d = offs[:-1][offs[:-1] < len(b)]
        st[d] = w[d]
        if len(b) and int(b.max()) >= 0xE3:
            lead = (b >= 0xE3) & (b <= 0xED)
            st |= lead
            after = np.flatnonzero(lead) + 3
            after = after[after < len(b)]
            st[after] |= w[after]
        e = w.copy()
        e[:-1] &= ~w[1:] | st[1:]
        starts, ends = np.flatnonzero(st), np.flatnonzero(e) + 1
        h = self.ranges(self.prefix(b), starts, ends)
        return h, starts, ends, np.searchsorted(starts, offs)

    def lines(self, text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As words, for lines: end is after the line feed; an empty text has none."""
        end = text == 10
        last = offs[1:][np.diff(offs) > 0] - 1
        end[last] = True
        ends = np.flatnonzero(end) + 1
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        content = ends - (text[ends - 1] == 10) if len(ends) else ends
        return self.ranges(self.prefix(text), starts, content), starts, ends, np.searchsorted(starts, offs)


def owners(wo: np.ndarray) -> np.ndarray:
    """Of each word, the number of its document."""
    return np.repeat(np.arange(len(wo) - 1), np.diff(wo))


def ngrams(h: np.ndarray, wo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one document."""
    g = np.zeros(len(h), U)
    for j in range(n):
        g = g * U(STEP)
        if j < len(h):
            g[: len(h) - j] += h[j:]
    ok = np.arange(len(h)) + n <= np.repeat(wo[1:], np.diff(wo))
    return mix(g), ok
