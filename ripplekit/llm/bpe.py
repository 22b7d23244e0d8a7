"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The parts of a pre-token are a linked list. Every adjacent pair that is in the vocabulary waits in the bucket of
its merge rank; a two-level bitmap of the non-empty buckets gives the next rank by find-first-set, and the bucket
its positions from left to right. A merge updates the two neighbouring pairs; entries that no longer hold their
position's rank are stale and skipped. All new short pre-tokens of a block share one list (with a gap after each)
and one queue: a bucket's leftmost entry of every pre-token is merged in one vector step and the other entries
wait, so each pre-token sees exactly the order it would see alone. A pre-token of more than ``SHORT`` bytes has a
queue of its own with heaps as buckets, O(n log n) however long it is.

Whole texts are cut at every space that follows a character other than white space: no pre-token of the pattern
spans such a place, so the runs are encoded independently, and repeated ones come from a bounded memo table.

Defined results: null or empty text has no ids (and decodes to nothing). Every text has a result, whatever its
characters, as all 256 bytes are in the vocabulary. Repeated rows and null or repeated ids are rows of their own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, handed_back

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
MEMO = 300_000
BLOCK = 5 << 20
SHORT = 256
# what \s stands for, in Arrow's regular expressions
_WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = _WHITE + " "
_OPEN = rf"^\z|{_WHITE}\z"
_CUT = re.compile(r"(?<=\S) ")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a rank file (base64 token and rank a line) or the JSON of a byte-level BPE."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told.get("added_tokens", ())}
        # the JSON writes bytes as printable characters: 188 stand for themselves, the others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain}
        byte |= {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in plain)}
        return {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def all_runs(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at every space after a character that is not white space (those spaces left out): their runs end to
    end, and where each text's begin (and end)."""
    col = pa.array(texts, pa.large_string())
    split = pc.split_pattern(col, " ")
    broken = np.flatnonzero(np.asarray(pc.match_substring_regex(col, _BREAK)))
    if len(broken):
        apart = pa.array([_CUT.split(texts[i]) for i in broken], split.type)
        order = np.arange(len(texts))
        order[broken] = len(texts) + np.arange(len(broken))
        split = pa.concat_arrays([split, apart]).take(pa.array(order))
    edge = np.append(0, np.cumsum(np.asarray(pc.list_value_length(split)))).astype(np.int64)
    return split.flatten(), edge


class RankQueue:
    """Entries by merge rank: a bucket for each rank, 256-bit words of non-empty buckets and one summary word."""

    def __init__(self, size: int):
        self.top, self.words, self.buckets = 0, [0] * (size // 256 + 1), {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank that is about to get an entry."""
        held = self.buckets.get(rank)
        if held is None:
            held = self.buckets[rank] = []
            self.words[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)
        return held

    def lowest(self) -> int:
        """The lowest rank that has a bucket, by find-first-set."""
        hi = (self.top & -self.top).bit_length() - 1
        word = self.words[hi]
        return hi << 8 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list:
        """Remove and return a bucket."""
        self.words[rank >> 8] &= ~(1 << (rank & 255))
        if not self.words[rank >> 8]:
            self.top &= ~(1 << (rank >> 8))
        return self.buckets.pop(rank)


class Merger:
    """Ids of pre-tokens by the vocabulary's ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.one = np.zeros(256, np.int64)
        self.two = np.full(65536, -1, np.int64)
        left, right, made = [], [], []
        get = ranks.get
        for token, r in ranks.items():
            if len(token) == 1:
                self.one[token[0]] = r
            elif len(token) == 2:
                self.two[token[0] << 8 | token[1]] = r
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None:
                    b = get(token[cut:])
                    if b is not None:
                        left.append(a)
                        right.append(b)
                        made.append(r)
        left, right, made = np.array(left), np.array(right), np.array(made)
        # the merges of every token with a right neighbour, and with a left one
        self.with_right = self._by_token(left, right, made)
        self.with_left = self._by_token(right, left, made)

    def _by_token(self, token, other, made):
        o = np.lexsort((other, token))
        return (np.searchsorted(token[o], np.arange(self.size + 1)).tolist(), other[o].astype(np.int32),
                made[o].astype(np.int32))

    @staticmethod
    def _merges(table, token: int, others: np.ndarray) -> np.ndarray:
        """The rank of one token joined with each of the others, -1 where there is none."""
        first, other, made = table
        a, b = first[token], first[token + 1]
        if a == b:
            return np.full(len(others), -1, np.int32)
        at = np.minimum(np.searchsorted(other[a:b], others), b - a - 1) + a
        out = made[at]
        out[other[at] != others] = -1
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Packed ids of one pre-token of any length."""
        get, n = self.ranks.get, len(piece)
        queue = RankQueue(self.size)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        held = [get(piece[i:i + 2], -1) for i in range(n - 1)] + [-1, -1]
        for i in range(n - 1):
            if held[i] >= 0:
                heapq.heappush(queue.bucket(held[i]), i)
        while queue.top:
            rank = queue.lowest()
            bucket = queue.buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.take(rank)
            if held[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            before[min(k, n)] = i
            held[j] = -1
            changed = [(i, get(piece[i:after[k]], -1) if k < n else -1)]
            p = before[i]
            if p >= 0:
                changed.append((p, get(piece[p:k], -1)))
            for x, r in changed:
                held[x] = r
                if r >= 0:
                    heapq.heappush(queue.bucket(r), x)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens."""
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        ends = np.cumsum(size + 1) - 1
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size + 1)
        n = len(data)
        gap = np.zeros(n + 1, bool)
        gap[ends] = True
        part = np.append(self.one[data], 0).astype(np.int32)
        held = np.full(n, -1, np.int32)
        held[:-1] = self.two[data[:-1].astype(np.int32) << 8 | data[1:]]
        held[gap[:n] | gap[1:]] = -1
        held[ends - 1] = -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        gap[n] = True  # stands before the first position and after the last
        before[0] = n
        live = ~gap[:n]
        queue = RankQueue(self.size)

        def push(ranks, at):
            o = np.argsort(ranks, kind="stable")
            ranks, at = ranks[o], at[o]
            edge = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for r, a, b in zip(ranks[edge[:-1]].tolist(), edge, edge[1:]):
                queue.bucket(r).append(at[a:b])

        at = np.flatnonzero(held >= 0).astype(np.int32)
        if len(at):
            push(held[at], at)
        while queue.top:
            rank = queue.lowest()
            bucket = queue.take(rank)
            i = np.concatenate(bucket) if len(bucket) > 1 else bucket[0]
            i = i[held[i] == rank]
            if not len(i):
                continue
            if len(i) > 1:
                i.sort()
                mine = owner[i]
                first = np.ones(len(i), bool)
                first[1:] = mine[1:] != mine[:-1]
                if not first.all():
                    queue.bucket(rank).append(i[~first])
                    i = i[first]
            j = after[i]
            k = after[j]
            after[i] = k
            held[j] = -1
            live[j] = False
            part[i] = rank
            before[k] = i
            p = before[i]
            right = self._merges(self.with_right, rank, part[k])
            right[gap[k]] = -1
            left = self._merges(self.with_left, rank, part[p])
            left[gap[p]] = -1
            held[i] = right
            inner = ~gap[p]
            held[p[inner]] = left[inner]
            r = np.concatenate([right, left])
            x = np.concatenate([i, p])[r >= 0]
            if len(x):
                push(r[r >= 0], x)
        stop = 4 * np.cumsum(live)[ends]
        packed = part[:n][live].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token; one that is a token itself needs no merges."""
        out = [self.ranks.get(x) for x in pieces]
        out = [None if r is None else r.to_bytes(4, "little") for r in out]
        short = [n for n, x in enumerate(pieces) if out[n] is None and len(x) <= SHORT]
        if short:
            for n, ids in zip(short, self.merge_short([pieces[n] for n in short])):
                out[n] = ids
        return [self.merge_long(x) if ids is None else ids for x, ids in zip(pieces, out)]


class Memo:
    """Packed ids by string, end to end in Arrow and numpy arrays, which take a fifth of what objects in a dict do."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self._hold(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _hold(self, keys: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.keys, self.size, self.ids = keys, size, ids
        self.first, self.again = np.cumsum(size) - size, np.zeros(len(size), bool)

    def find(self, strings: pa.Array) -> np.ndarray:
        """The number of each string, -1 where there is none."""
        at = np.asarray(pc.fill_null(pc.index_in(strings, value_set=self.keys), -1)).astype(np.int64)
        self.again[at[at >= 0]] = True
        return at

    def add(self, strings: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        again = np.append(self.again, np.zeros(len(size), bool))
        self._hold(pa.concat_arrays([self.keys, strings]), np.append(self.size, size), np.append(self.ids, ids))
        self.again = again

    def trim(self) -> None:
        """Beyond the limit, what was not found again goes; if that is too little, all does."""
        if len(self.keys) > self.limit:
            keep = self.again if 2 * self.again.sum() <= self.limit else np.zeros(len(self.again), bool)
            self._hold(self.keys.filter(pa.array(keep)), self.size[keep], self.ids[np.repeat(keep, self.size)])


def _stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, end to end."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Encoder:
    """Encodes and decodes whole texts; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memo: int = MEMO):
        self.merger = Merger(ranks)
        self.find = regex.compile(pattern).findall
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.pieces, self.runs = Memo(memo), Memo(memo)

    def _pieces_of(self, runs: pa.Array, heads: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of runs (with the space before them) and heads, end to end, and how many each has."""
        # one search for all runs that end in a character other than white space: they may stand side by side
        apart = pc.match_substring_regex(runs, _OPEN)
        side = runs.filter(pc.invert(apart))
        apart = np.asarray(apart)
        found = pa.array(self.find(" " + " ".join(side.to_pylist())) if len(side) else [], pa.large_string())
        end = np.cumsum(np.asarray(pc.utf8_length(side)) + 1)
        count = np.zeros(len(runs) + len(heads), np.int64)
        count[:len(runs)][~apart] = np.diff(np.searchsorted(np.cumsum(np.asarray(pc.utf8_length(found))), end, "right"), prepend=0)
        others = [self.find(x) for x in [*(" " + r for r in runs.filter(pa.array(apart)).to_pylist()), *heads]]
        where = np.append(np.flatnonzero(apart), np.arange(len(runs), len(count)))
        count[where] = [len(x) for x in others]
        found = pa.concat_arrays([found, pa.array([x for y in others for x in y], pa.large_string())])
        # back into the order of the runs
        by = np.append(np.flatnonzero(~apart), where)
        first = np.empty(len(count), np.int64)
        first[by] = np.cumsum(count[by]) - count[by]
        return found.take(pa.array(_stretches(first, count))), count

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens end to end, and how many each has."""
        told = pieces.dictionary_encode()
        at = self.pieces.find(told.dictionary)
        unknown = np.flatnonzero(at < 0)
        new = told.dictionary.take(pa.array(unknown))
        ids = self.merger.merge(new.cast(pa.large_binary()).to_pylist())
        at[unknown] = len(self.pieces.keys) + np.arange(len(unknown))
        self.pieces.add(new, np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4"))
        at = at[np.asarray(told.indices)]
        size = self.pieces.size[at]
        return self.pieces.ids[_stretches(self.pieces.first[at], size)], size

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text of a block."""
        if not texts:
            return []
        for memo in (self.pieces, self.runs):
            memo.trim()
        # the first run of a text has no space before it; every other one has
        runs, edge = all_runs(texts)
        head = np.zeros(len(runs), bool)
        head[edge[:-1]] = True
        told = runs.filter(pa.array(~head)).dictionary_encode()
        at = self.runs.find(told.dictionary)
        unknown = np.flatnonzero(at < 0)
        new = told.dictionary.take(pa.array(unknown))
        pieces, count = self._pieces_of(new, runs.filter(pa.array(head)).to_pylist())
        ids, size = self._merged(pieces)
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
        size, n = np.diff(upto), len(unknown)
        at[unknown] = len(self.runs.keys) + np.arange(n)
        self.runs.add(new, size[:n], ids[:upto[n]])
        first, long = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
        at = at[np.asarray(told.indices)]
        first[~head], long[~head] = self.runs.first[at], self.runs.size[at]
        first[head], long[head] = upto[n:-1] - upto[n] + len(self.runs.ids), size[n:]
        packed = np.append(self.runs.ids, ids[upto[n]:])[_stretches(first, long)].tobytes()
        stop = 4 * np.append(0, np.cumsum(long))[edge]
        return [packed[a:b] for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]

    def forget(self) -> None:
        """Empties the memos, which else stay in the Python worker when its task has ended."""
        for memo in (self.pieces, self.runs):
            memo.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ENCODERS: dict = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def text_blocks(texts):
    """(first row, texts) of consecutive rows of an Arrow column, about BLOCK bytes at once; null counts as empty."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK)))
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        lo = hi


def _encoded(path: str, pattern: str):
    def run(batches):
        enc = encoder(path, pattern)
        try:
            for b in batches:
                for lo, texts in text_blocks(b.column(1)):
                    ids = pa.array(enc.encode_all(texts), pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), ids], names=["doc_id", "ids"])
        finally:
            enc.forget()
    return handed_back(run)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and packed ids of every row."""
    return (columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_encoded(path, pattern), "doc_id long, ids binary"))


def _decoded(path: str, pattern: str):
    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                text = [enc.decode(x) if x else b"" for x in part.column(1).to_pylist()]
                if text:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.binary())],
                                                     names=["doc_id", "ids", "decoded"])
    return run


def decode(df: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids and the decoded bytes of rows from ``encode``."""
    return df.select("doc_id", "ids").mapInArrow(_decoded(path, pattern), "doc_id long, ids binary, decoded binary")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
