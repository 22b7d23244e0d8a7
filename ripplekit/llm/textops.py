"""Vectorised text primitives over Arrow string columns: words, lines, rolling hashes, shingles.

All functions work on blocks of whole texts laid end to end as UTF-8 bytes; nothing crosses a text's end.
Hashes are 64-bit: a random value per byte, polynomials over them modulo two primes below 2^31, and a final mix. (Modulo
a power of two, words with a recursive structure collide whatever the base and the values are.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(salt << 20)) * _U(BASE))


class _Prime:
    """Arithmetic modulo 2^31 - c on arrays below 2^62, with powers of a base and of its inverse."""

    def __init__(self, c: int, salt: int):
        self.c, self.p = c, (1 << 31) - c
        self.byte = self.mod(seeds(256, salt) >> _U(2))
        self.base = int(seeds(1, salt + 1)[0] >> _U(2)) % self.p | 1
        self.tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def mod(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            high = x >> _U(31)
            if self.c > 1:
                high *= _U(self.c)
            x = x & _U(0x7FFFFFFF)
            x += high
        np.subtract(x, _U(self.p), out=x, where=x >= _U(self.p))
        return x

    def powers(self, n: int):
        """base^i and base^-i for i < n."""
        if len(self.tables[0]) < n:
            size = max(n, 1 << 16)
            out = []
            for b in (self.base, pow(self.base, -1, self.p)):
                t = np.ones(size, np.uint64)
                k = 1
                while k < size:
                    m = min(k, size - k)
                    t[k:k + m] = self.mod(t[:m] * _U(pow(b, k, self.p)))
                    k += m
                out.append(t)
            self.tables = tuple(out)
        return self.tables


_PRIMES = (_Prime(1, 7), _Prime(19, 9))


class Rolling:
    """Hashes of any byte ranges of a block."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        self.sums = []
        for m in _PRIMES:
            up, down = m.powers(n + 1)
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(m.mod((m.byte[_LOWER] if lower else m.byte)[data] * up[:n]), out=h[1:])
            self.sums.append((m, h, down))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (m.mod(m.mod(h[end] - h[start]) * down[start]) for m, h, down in self.sums)
        return mix(mix(a << _U(31) | b) + (end - start).astype(np.uint64))


def blocks(col, max_bytes: int = 1 << 19):
    """(first row, bytes, offsets) of consecutive whole texts, about ``max_bytes`` at once (the arrays made of them take 8
    bytes for each and should stay in a core's cache); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        j = min(j, n, i + 60_000)
        yield i, data[off[i]:off[j]], (off[i:j + 1] - off[i]).astype(np.int64)
        i = j


def _cut(off: np.ndarray, n: int) -> np.ndarray:
    at = np.zeros(n + 1, bool)
    at[off] = True
    return at


def words(data: np.ndarray, off: np.ndarray):
    """Start, end and text number of every maximal run of bytes other than space and \\t..\\r."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    cut = _cut(off, n)
    start = inside[:n].copy()
    start[1:] &= ~inside[:n - 1] | cut[1:n] if n else False
    s = np.flatnonzero(start)
    last = inside[:n] & (~inside[1:] | cut[1:])
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def count_where(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def first_bytes(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of every code point."""
    return (data & 0xC0) != 0x80


def windows(doc: np.ndarray, wh: np.ndarray, k: int):
    """Index of the first word and hash of every k-word window inside one text."""
    m = len(wh) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:m] == doc[k - 1:])
    h = np.zeros(len(at), np.uint64)
    for j, c in enumerate(seeds(k, 11)):
        h += wh[at + j] * (c | _U(1))
    return at, mix(h)


def shingles(doc: np.ndarray, wh: np.ndarray, n_docs: int, k: int = 5):
    """(text number, hash) of all k-word shingles; a text of 1..k-1 words has its whole sequence as one."""
    at, h = windows(doc, wh, k)
    per = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    short = np.flatnonzero((per > 0) & (per < k))
    d = doc[at]
    if len(short):
        first = np.searchsorted(doc, short)
        x = np.zeros(len(short), np.uint64)
        for j, c in enumerate(seeds(k, 11)):
            more = j < per[short]
            x[more] += wh[first[more] + j] * (c | _U(1))
        d = np.concatenate([d, short])
        h = np.concatenate([h, mix(x + per[short].astype(np.uint64) * _U(0xD6E8FEB86659FD93))])
    return d, h


def by_doc(doc: np.ndarray, h: np.ndarray):
    """Order (text number, hash)."""
    o = np.argsort(h, kind="stable")
    return o[np.argsort(doc[o].astype(np.uint16), kind="stable")]


def distinct(doc: np.ndarray, h: np.ndarray):
    """Distinct (text number, hash), ordered."""
    o = by_doc(doc, h)
    doc, h = doc[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5, lower: bool = True):
    """Distinct shingles of every text of a block: (text number, hash) ordered."""
    s, e, doc = words(data, off)
    return distinct(*shingles(doc, Rolling(data, lower).of(s, e), len(off) - 1, k))
