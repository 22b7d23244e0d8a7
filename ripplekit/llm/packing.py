"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents become the ids that the ``tokenizers`` library gives with a byte-level BPE file and without adding special
tokens, followed by ``END``: a text is cut at the file's added tokens, which have ids of their own, and what lies
between goes through the encoder of bpe.py. A document longer than a sequence is cut into pieces of the sequence length,
of which the first may be shorter. How the pieces share sequences depends on their lengths only, so the driver plans with
the histogram of lengths (at most ``capacity`` rows): first, sets that provably dominate every other choice for
their largest piece are fixed for all its copies; the shrunken instance is packed by best-fit decreasing over
classes of equal bins. The plan is a list of rank intervals for each length; the pieces get their rank within
their length from block counts and look up sequence and offset, in one pass over all pieces.

Defined results: null or empty text is the single id END. Repeated rows are pieces of their own. Pieces of equal
length are interchangeable; ties are ordered by id and piece. Null ids are kept. Extra columns are ignored; an
empty table gives an empty result. Memory in a task: one Arrow batch
and the encoder's memo.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import columns_of, handed_back, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 1024
END = 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class AddedTokens:
    """The added tokens of a vocabulary file: found in a text before anything else, each is one id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in or look at their surroundings")
        self.ids = {t["content"]: t["id"].to_bytes(4, "little") for t in tokens}
        longest = sorted(self.ids, key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, longest))})").split if longest else lambda t: [t]

    def encode_all(self, enc: bpe.Encoder, texts: list[str]) -> list[bytes]:
        """Packed ids of each text of a block."""
        split = [self.cut(t) if any(x in t for x in self.ids) else [t] for t in texts]  # text, token, text, ..., text
        ids = iter(enc.encode_all([part for parts in split for part in parts[::2]]))
        return [b"".join(self.ids[part] if n % 2 else next(ids) for n, part in enumerate(parts)) for parts in split]


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches):
        added = AddedTokens(path)
        enc, end, width = bpe.encoder(path, public_tokenizers.PATTERN), np.array([END], "<u4").tobytes(), 4 * capacity
        try:
            for b in batches:
                for lo, texts in bpe.text_blocks(b.column(1)):
                    cols = [[], [], [], [], [], []]
                    for doc, ids in zip(b.column(0).slice(lo, len(texts)).to_pylist(), added.encode_all(enc, texts)):
                        ids += end
                        first = len(ids) % width or width
                        at = [0, *range(first, len(ids) + 1, width)]
                        for n, (x, y) in enumerate(zip(at, at[1:])):
                            one = ids[x:y]
                            for c, v in zip(cols, (doc, n, x // 4, (y - x) // 4, zlib.crc32(one), one)):
                                c.append(v)
                    out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        out, names = [*out, pa.array(cols[5], pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(out, names=names)
        finally:
            enc.forget()
    return handed_back(run)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their packed ids if wanted."""
    return (columns_of(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(_cut(path, capacity, with_ids), PIECE_SCHEMA + (", ids binary" if with_ids else "")))


def dominant(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction: fixes dominating sets of at most three pieces; takes them out of ``counts``.

    For the largest piece s and the rest of its bin: alone if nothing else fits; with the largest fitting k if
    that fills the bin, or if no two other pieces fit beside s; with k and the largest a that fits beside both if
    no three other pieces fit and no feasible pair has a smaller member above a.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for s in sorted(counts, reverse=True):
            while counts.get(s):
                found = _dominating(s, counts, capacity)
                if found is None:
                    break
                use = Counter(found)
                times = min(counts[x] // n for x, n in use.items())
                fixed.append((found, times))
                for x, n in use.items():
                    counts[x] -= n * times
                    if not counts[x]:
                        del counts[x]
                changed = True
    return fixed


def _dominating(s: int, counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    others = sorted(x for x in counts if x != s or counts[s] > 1)
    left = {x: counts[x] - (x == s) for x in others}
    rest = capacity - s
    fitting = [x for x in others if x <= rest]
    if not fitting:
        return (s,)
    k = fitting[-1]
    small = []  # the three smallest other pieces
    for x in others:
        small += [x] * min(3, left[x])
        if len(small) >= 3:
            break
    if k == rest or len(small) < 2 or small[0] + small[1] > rest:
        return (s, k)
    if len(small) > 2 and sum(small[:3]) <= rest:
        return None
    beside = [x for x in fitting if x + k <= rest and (x != k or left[k] > 1)]
    if not beside:
        return None
    a = beside[-1]
    # the largest smaller member of any feasible pair of other pieces
    for x in reversed(fitting):
        if 2 * x <= rest and left[x] > 1 or any(y > x and x + y <= rest for y in fitting):
            return (s, k, a) if x <= a else None
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over classes of equal bins."""
    free: list[list] = [[] for _ in range(capacity + 1)]  # by free room: [contents, bins]
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = next((r for r in range(s, capacity + 1) if free[r]), capacity)
            contents, bins = free[room].pop() if free[room] else ((), left)
            each = room // s
            full = min(bins, left // each)
            if full:
                free[room - each * s].append([contents + (s,) * each, full])
            left -= full * each
            bins -= full
            if bins and left and contents == ():
                free[room - left * s].append([(s,) * left, 1])
                left = 0
            elif bins and left < each and left:
                free[room - left * s].append([contents + (s,) * left, 1])
                bins, left = bins - 1, 0
            if bins and contents != ():
                free[room].append([contents, bins])
    return [(c, n) for room in free for c, n in room]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences)."""
    counts = {s: n for s, n in counts.items() if n}
    return dominant(counts, capacity) + best_fit(counts, capacity)


def intervals(patterns) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ascending."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for contents, times in patterns:
        at = 0
        for s in contents:
            out.setdefault(s, []).append((used[s], sequence, at))
            used[s] += times
            at += s
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def _placed(where: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                rows = where[int(s)]
                at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                seq[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
                off[mine] = rows[at, 2]
            n = b.schema.get_field_index("rank")
            names = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != n), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])
    return run


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = df.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(pieces(df, id_col, text_col, path, capacity, with_ids)
                  .withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")), "pack-pieces")
    cells = stored(rows.groupBy("length", "block").agg(F.count("*").alias("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = intervals(plan(counts, capacity))
    base = cells.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (rows.withColumn("place", place).join(base, ["length", "block"])
              .withColumn("rank", (F.col("base") + F.col("place")).cast("long")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_placed(where), schema)
