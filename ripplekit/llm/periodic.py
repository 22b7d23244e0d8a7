"""Periodic runs of words: longest common extensions by difference covers drive a harmonic grid.

Texts are laid end to end as word ids (exact: a dictionary of the block's words), each between separators that occur
once, so that nothing extends across texts. ``Extensions`` answers how many words two places have in common: only
suffixes whose place modulo R * R lies in a difference cover are sorted (a few words at a time, then by doubling over
the sample), a pair of places compares words until both lie in the sample (fewer than R * R words), and the rest is
the least common prefix between two ranks, from a sparse table.

A run of period q has at least 4 q words, so one of any 3 q consecutive places starts a pair of equal words q apart
inside it. The grid tries every q at the places 0, 3 q, 6 q, ... of each text (n log n / 3 places in all) and extends
equal pairs both ways. A stretch that several periods find keeps the smallest: two periods of one stretch of that
length imply the smaller divides it, and it then is maximal for both.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text. Repeated rows have
equal results; extra columns are ignored; an empty table gives an empty result. A text is worked on whole in one
task, however long: about 60 bytes for each word of a block, of which short texts fill one of 2 MB together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import columns_of

R = 8
LEAST, REPEATS = 6, 4
POINTS = 1 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def cover(r: int) -> np.ndarray:
    """Marks 2 r - 1 residues modulo r * r; every residue is a difference of two of them."""
    at = np.zeros(r * r, bool)
    at[:r] = True
    at[::r] = True
    return at


class _Least:
    """Least value of any range, by a sparse table."""

    def __init__(self, values: np.ndarray):
        rows = [values]
        width = 1
        while 2 * width <= len(values):
            low = rows[-1].copy()
            np.minimum(low[:-width], low[width:], out=low[:-width])
            rows.append(low)
            width *= 2
        self.table = np.stack(rows)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values lo..hi, ends included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, lo], self.table[level, hi + 1 - (1 << level)])


class Extensions:
    """Common extensions of any two places of a sequence whose last id occurs once."""

    def __init__(self, ids: np.ndarray, r: int = R):
        self.v = v = r * r
        marks = cover(r)
        self.slot = np.cumsum(marks) - 1  # number of a residue within the cover
        self.per = int(marks.sum())
        where = np.flatnonzero(marks)
        # a place of the cover whose partner at each difference is in the cover too
        self.meet = np.zeros(v, np.int64)
        self.meet[(where[None, :] - where[:, None]) % v] = np.broadcast_to(where[:, None], (len(where), len(where)))
        self.ids = np.concatenate([ids, np.zeros(v + 2, ids.dtype)])
        n = len(ids)
        places = (np.arange(0, n, v)[:, None] + where[None, :]).ravel()
        self.places = places[places < n]
        self._sort()

    def _index(self, place: np.ndarray) -> np.ndarray:
        return place // self.v * self.per + self.slot[place % self.v]

    def _sort(self) -> None:
        m = len(self.places)
        unknown = np.iinfo(np.int32).max
        common = np.full(m, unknown, np.int32)  # with the suffix one rank before
        order = np.arange(m)
        group = np.zeros(m, np.int64)  # first rank of the suffixes still equal to that at a rank
        self.rank = np.zeros(m, np.int64)
        common[0] = 0
        depth = 0
        ranks = np.arange(m)
        while len(ranks):
            place = self.places[order[ranks]] + depth
            if depth < self.v:  # the next two words
                first = self.ids[place].astype(np.uint64)
                key = first << np.uint64(32) | self.ids[place + 1].astype(np.uint64)
            else:  # as many words again, by the ranks so far
                key = self.rank[self._index(place)].astype(np.uint64)
            by = np.lexsort((key, group[ranks]))
            order[ranks] = order[ranks][by]
            key = key[by]
            parted = np.flatnonzero((group[ranks][1:] == group[ranks][:-1]) & (key[1:] != key[:-1])) + 1
            if len(parted):
                a, b = key[parted - 1], key[parted]
                if depth < self.v:
                    more = ((a >> np.uint64(32)) == (b >> np.uint64(32))).astype(np.int64)
                else:
                    more = _Least(common).of(a.astype(np.int64) + 1, b.astype(np.int64))
                common[ranks[parted]] = depth + more
            starts = np.where(common != unknown, np.arange(m), 0)
            group = np.maximum.accumulate(starts)
            self.rank[order] = group
            alone = (common != unknown) & np.append(common[1:] != unknown, True)
            ranks = np.flatnonzero(~alone)
            depth = min(depth + 2, self.v) if depth < self.v else depth * 2
        self.least = _Least(common)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from the places a and b (different) on."""
        out = np.zeros(len(a), np.int64)
        steps = (self.meet[(b - a) % self.v] - a) % self.v
        live = np.arange(len(a))
        for t in range(self.v):
            due = steps[live] == t
            if due.any():
                x = live[due]
                p, q = self.rank[self._index(a[x] + t)], self.rank[self._index(b[x] + t)]
                out[x] = t + self.least.of(np.minimum(p, q) + 1, np.maximum(p, q))
                live = live[~due]
            same = self.ids[a[live] + t] == self.ids[b[live] + t]
            out[live[~same]] = t
            live = live[same]
            if not len(live):
                break
        return out


def _grid(start: np.ndarray, length: np.ndarray):
    """(place, period) of the harmonic grid, about POINTS at once."""
    most = length // REPEATS
    most[length < LEAST] = 0
    text = np.repeat(np.arange(len(start)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (REPEATS - 1) * period
    count = -(-(length[text] - period) // step)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POINTS, "right")))
        c = count[lo:hi]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(start[text[lo:hi]], c) + k * np.repeat(step[lo:hi], c), np.repeat(period[lo:hi], c)
        lo = hi


def _smallest(begin: np.ndarray, end: np.ndarray, period: np.ndarray):
    """One row for each stretch, with its smallest period, by begin, then period."""
    o = np.lexsort((period, end, begin))
    begin, end, period = begin[o], end[o], period[o]
    new = np.ones(len(o), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[new], end[new], period[new]
    o = np.lexsort((period, begin))
    return begin[o], end[o], period[o]


def runs(ids: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Begin, end (exclusive) and smallest period of every run; texts are ids[start:start + length], each between ids
    that occur once."""
    n = len(ids)
    after, before = Extensions(ids), Extensions(ids[::-1])
    found = [(np.zeros(0, np.int64),) * 3]
    for i, q in _grid(start, length):
        equal = ids[i] == ids[i + q]
        i, q = i[equal], q[equal]
        end = i + q + after.of(i, i + q)
        begin = i - before.of(n - i, n - i - q)
        long = end - begin >= np.maximum(LEAST, REPEATS * q)
        found.append(_smallest(begin[long], end[long], q[long]))
    return _smallest(*map(np.concatenate, zip(*found)))


def _tail(doc_id, n: int) -> tuple[int, int]:
    """Where a text's rewritten tail begins and its period; (n, 1) if it has none."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return n, 1
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _block(ids_col, data: np.ndarray, off: np.ndarray, tails: bool):
    """Number of words, runs and collapsed text of every text of a block."""
    s, e, doc = T.words(data, off)
    texts = len(off) - 1
    size = np.bincount(doc, minlength=texts) if len(doc) else np.zeros(texts, np.int64)
    first = np.cumsum(size) - size
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    letters = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    ends = np.zeros(len(s) + 1, np.int32)
    np.cumsum(e - s, out=ends[1:])
    words = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(letters))
    source = np.arange(len(s))
    if tails:
        for d, doc_id in enumerate(ids_col.to_pylist()):
            a, p = _tail(doc_id, int(size[d]))
            if a < size[d]:
                source[first[d] + a:first[d] + size[d]] = first[d] + a + np.arange(size[d] - a) % p
    known = words.dictionary_encode()
    # separators: one before each text and one after the last
    place = np.arange(len(s)) + doc + 1
    ids = np.empty(len(s) + texts + 1, np.int64)
    ids[first + np.arange(texts)] = len(known.dictionary) + np.arange(texts)
    ids[-1] = len(known.dictionary) + texts
    ids[place] = known.indices.to_numpy(zero_copy_only=False)[source] if len(s) else 0
    begin, end, period = runs(ids, first + np.arange(texts) + 1, size.copy())
    owner = np.searchsorted(first + np.arange(texts), begin, "right") - 1
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, np.minimum(begin + period, end), 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[place] == 0
    left = words.take(pa.array(source[kept]))
    lists = np.zeros(texts + 1, np.int32)
    np.cumsum(np.bincount(doc[kept], minlength=texts) if len(s) else np.zeros(texts, np.int64), out=lists[1:])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(lists), left), " ")
    bounds = np.zeros(texts + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=texts), out=bounds[1:])
    struct = pa.StructArray.from_arrays([pa.array(x) for x in (begin - first[owner] - owner - 1, end - begin, period)],
                                        ["start", "length", "period"])
    return pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), struct).cast(_RUNS), collapsed


def _searched(tails: bool):
    def run(batches):
        for b in batches:
            for lo, data, off in T.blocks(b.column(1)):
                ids_col = b.column(0).slice(lo, len(off) - 1)
                yield pa.RecordBatch.from_arrays([ids_col, *_block(ids_col, data, off, tails)],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text: without the words
    that a run repeats. With ``tails`` some texts' tails are first rewritten periodically, as ``_tail`` says (a text
    with a null id keeps its words)."""
    return (columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_searched(tails), "doc_id long, n_words long, "
                        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"))
