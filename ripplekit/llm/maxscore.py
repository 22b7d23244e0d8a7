"""Exact top-k search by inner product: MaxScore over sharded postings.

Vectors become integers, floor(SCALE * component). Terms are dimensions: the postings of a dimension are the rows of
a shard whose component there is not 0, and a query term's bound is the largest product it can give in the shard (0
at least). The terms with the smallest bounds whose sum stays below a query's k-th best score so far are
non-essential: a row in none of the other postings can not enter. Essential postings are traversed and summed; the k
best partial sums are completed first, which may raise the threshold; then the non-essential terms, largest bound
first, probe only the rows that can still reach it. Rows that tie with the threshold stay, so ties are whole.

Rows are packed as they are read into shards (at most SHARD rows and CELLS components), stored once. Queries are
dealt by hash to blocks of about QUERY_BLOCK, shards to groups; every block of queries meets every group of shards in
one cell, where shards stream past one at a time and the threshold carries over from shard to shard. A query sends at
most k rows from a group; these are merged by rank. The blocks are the stated query set against all rows: no other
pairs are built, and a cell holds one block and one shard, whatever the size of the table.

Defined results: vectors that are null or hold null or non-finite components take no part. Shorter vectors count as 0
in the missing dimensions (an empty one scores 0 with all). A row with a null id is found as a candidate, after equal
scores with ids, and is no query. Rows that share an id are different rows: each is a query of its own and a candidate
for the other. Extra columns are ignored; an empty table, or one without queries, gives an empty result. Scores that
could leave the range of a long raise an error.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored

SHARD, CELLS = 4096, 1 << 22
QUERY_BLOCK = 4096
_SHARD = "shard long, n int, dims int, ids binary, known binary, width int, data binary"
_QUERY = "shard long, row int, query_id long, data binary"


# --- one query against one shard ---------------------------------------------------------------------------------

class Shard:
    """Integer vectors of consecutive rows with their postings by dimension."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, data: np.ndarray, name: int = -1):
        self.ids, self.known, self.data, self.name = ids, known, data, name
        self.hi, self.lo = data.max(axis=0, initial=0), data.min(axis=0, initial=0)
        self.postings = []
        for d in range(data.shape[1]):
            rows = np.flatnonzero(data[:, d])
            self.postings.append((slice(None) if len(rows) == len(data) else rows, data[rows, d].astype(np.int64)))


class Best:
    """A query and the best rows it has met."""

    def __init__(self, weights: np.ndarray, k: int, own: tuple[int, int] = (-2, 0)):
        self.k, self.own = k, own
        self.terms = np.flatnonzero(weights)
        self.weights = weights[self.terms].astype(np.int64)
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _merged(self, score, ids, known):
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.known, known)))
        first = np.lexsort((ids, ~known, -score))[:self.k]
        return score[first], ids[first], known[first]

    def search(self, shard: Shard) -> None:
        n = len(shard.data)
        inside = self.terms < shard.data.shape[1]
        terms, weights = self.terms[inside], self.weights[inside]
        hi, lo = shard.hi[terms].astype(np.int64), shard.lo[terms].astype(np.int64)
        if np.abs(weights.astype(float)) @ np.maximum(np.abs(hi.astype(float)), np.abs(lo.astype(float))) > 2.0 ** 62:
            raise ValueError("scores could leave the range of a long")
        bound = np.maximum(weights * hi, np.maximum(weights * lo, 0))
        by = np.argsort(-bound, kind="stable")
        terms, weights, bound = terms[by], weights[by], bound[by]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the terms from here on can give
        least = self.score[-1] if len(self.score) == self.k else None
        essential = len(terms) if least is None else int(np.count_nonzero(rest >= least))
        partial, touched = np.zeros(n, np.int64), np.zeros(n, bool)
        if essential > len(terms) or least is None:  # rows in no posting at all may enter
            essential, touched[:] = len(terms), True
        for t, w in zip(terms[:essential], weights[:essential]):
            rows, values = shard.postings[t]
            partial[rows] += w * values
            touched[rows] = True
        if self.own[0] == shard.name:
            touched[self.own[1]] = False
        rows = np.flatnonzero(touched)
        if least is not None and essential < len(terms):
            few = rows[np.argpartition(-partial[rows], self.k)[:self.k]] if len(rows) > self.k else rows
            full = partial[few] + shard.data[np.ix_(few, terms[essential:])].astype(np.int64) @ weights[essential:]
            least = self._merged(full, shard.ids[few], shard.known[few])[0][-1]
            for j in range(essential, len(terms)):
                rows = rows[partial[rows] + rest[j] >= least]
                if not len(rows):
                    return
                partial[rows] += weights[j] * shard.data[rows, terms[j]].astype(np.int64)
        if least is not None:
            rows = rows[partial[rows] >= least]
        elif len(rows) > 8 * self.k:
            rows = rows[partial[rows] >= np.partition(partial[rows], -self.k)[-self.k]]
        self.score, self.id, self.known = self._merged(partial[rows], shard.ids[rows], shard.known[rows])


# --- shards, queries and cells -----------------------------------------------------------------------------------

def _shard_rows(scale: int):
    def matrix(col: pa.Array):
        """(rows that take part, lengths, components laid end to end) of a list column."""
        flat = col.flatten()
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        owner = np.repeat(np.arange(len(col)), size)
        ok = col.is_valid().to_numpy(zero_copy_only=False).copy()
        ok[owner[~np.isfinite(x)]] = False
        with np.errstate(over="ignore"):
            whole = np.floor(scale * x[ok[owner]])
        if len(whole) and np.abs(whole).max() >= 2.0 ** 62:
            raise ValueError("scores could leave the range of a long")
        return np.flatnonzero(ok), size[ok], whole.astype(np.int64)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            col = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            rows, size, flat = matrix(col)
            ids = b.column(0).take(pa.array(rows))
            begin = np.cumsum(size) - size
            lo = 0
            while lo < len(rows):
                hi = min(len(rows), lo + SHARD)
                while hi - lo > 1 and (hi - lo) * int(size[lo:hi].max()) > CELLS:
                    hi = lo + (hi - lo) // 2
                dims = int(size[lo:hi].max())
                data = np.zeros((hi - lo, dims), np.int64)
                owner = np.repeat(np.arange(hi - lo), size[lo:hi])
                span = slice(begin[lo], begin[lo] + len(owner))
                data[owner, np.arange(span.start, span.stop) - begin[lo:hi][owner]] = flat[span]
                most = max(int(data.max(initial=0)), -int(data.min(initial=0)))
                width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
                own = ids.slice(lo, hi - lo)
                row = ((part << 32) + number, hi - lo, dims,
                       pc.fill_null(own, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                       own.is_valid().to_numpy(zero_copy_only=False).tobytes(), width, data.astype(f"<i{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)
                number, lo = number + 1, hi
    return run


_NAMES = [c.split()[0] for c in _SHARD.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in _SHARD.split(", ")]


def _shard(r, name: int) -> Shard:
    data = np.frombuffer(r["data"], f"<i{r['width']}").reshape(r["n"], r["dims"])
    return Shard(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["known"], bool), data, name)


def _query_rows(every: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, known = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["known"], bool)
                data = np.frombuffer(r["data"], f"<i{r['width']}").reshape(r["n"], r["dims"])
                rows = np.flatnonzero(known & (ids % every == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(ids[rows]),
                     pa.array([v.astype("<i8").tobytes() for v in data[rows]], pa.binary())],
                    names=["shard", "row", "query_id", "data"])
    return run


def _cells(k: int):
    """Rows ordered by (cell, kind, shard): a block's queries, then the shards of a group -> each query's best."""
    def run(rows):
        for _, own in groupby(rows, lambda r: r["cell"]):
            queries = []
            for r in own:
                if r["kind"] == 0:
                    queries.append((r, Best(np.frombuffer(r["data"], "<i8"), k, (r["shard"], r["row"]))))
                elif queries:
                    shard = _shard(r, r["shard"])
                    for _, best in queries:
                        best.search(shard)
            for r, best in queries:
                for score, i, known in zip(best.score.tolist(), best.id.tolist(), best.known.tolist()):
                    yield r["shard"], r["row"], r["query_id"], i if known else None, score
    return run


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    vectors = columns_of(df, vec_id=id_col, vec=vec_col).select(F.col("vec_id").cast("long"), F.col("vec").cast("array<double>"))
    shards = stored(vectors.mapInArrow(_shard_rows(scale), _SHARD), "maxscore-shards")
    queries = stored(shards.mapInArrow(_query_rows(every), _QUERY), "maxscore-queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    groups = max(1, min(shards.count(), -(-2 * parts // blocks)))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("dims", "int"), ("ids", "binary"),
                                                      ("known", "binary"), ("width", "int"))]
    asked = (queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
             .select((F.pmod(F.xxhash64("shard", "row"), F.lit(blocks)) * groups + F.col("g")).alias("cell"),
                     F.lit(0).alias("kind"), "shard", "row", "query_id", *none, "data"))
    met = (shards.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
           .select((F.col("b") * groups + F.pmod(F.xxhash64("shard"), F.lit(groups))).alias("cell"), F.lit(1).alias("kind"),
                   "shard", F.lit(None).cast("int").alias("row"), F.lit(None).cast("long").alias("query_id"),
                   "n", "dims", "ids", "known", "width", "data"))
    cells = asked.union(met).repartition(parts, "cell").sortWithinPartitions("cell", "kind", "shard")
    found = spark.createDataFrame(cells.rdd.mapPartitions(_cells(k)),
                                  "shard long, row int, query_id long, vec_id long, score long", verifySchema=False)
    best = Window.partitionBy("shard", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
