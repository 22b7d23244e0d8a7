"""Deterministic sampling, resampling and fold assignment.

Randomness comes from ``md5(seed | key)``: the same rows are picked on any
cluster layout, in any partitioning, and DuckDB computes the same numbers
(``('0x' || substr(md5(x), 1, 15))::BIGINT``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bits taken from the md5: beyond any row count a modulus may stand for.
HASH_BITS = 60


def hash_int(key: Column, seed) -> Column:
    """60-bit non-negative integer from md5(seed|key)."""
    s = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(s, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_uniform(key: Column, seed) -> Column:
    """Uniform [0, 1) from the hash."""
    return hash_int(key, seed) / F.lit(float(2 ** HASH_BITS))


def hash_fold(key: Column, k: int, seed=0) -> Column:
    """Fold id in 0..k-1."""
    return hash_int(key, seed) % k


def seeded_sample(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """L4: n rows ordered by md5(seed|key) — a top-k, no full sort."""
    return df.withColumn("_h", hash_int(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def seeded_shuffle_rank(key: Column, seed, part=()) -> Column:
    """Permutation rank (1..n) per partition by md5 order."""
    return F.row_number().over(Window.partitionBy(*part).orderBy(hash_int(key, seed), key))


def chronological_split(df: DataFrame, order: str, frac: float, part=()) -> Column:
    """L7: 'train' for the first ``frac`` of rows by ``order`` (per partition)."""
    w = Window.partitionBy(*part).orderBy(order)
    rn = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return F.when(rn <= F.floor(n * frac), "train").otherwise("test")


def contiguous_folds(order: str, k: int, part=()) -> Column:
    """K contiguous folds by time (ntile)."""
    return F.ntile(k).over(Window.partitionBy(*part).orderBy(order)) - 1


def bootstrap_within(df: DataFrame, part: str, order: str, cols, seed) -> DataFrame:
    """Resample ``cols`` with replacement inside each ``part`` group: row i
    takes the values of row src_i = 1 + hash(seed|part|i) mod n, resolved by an
    equi-join on (part, row number) — no group is collected to one task."""
    w = Window.partitionBy(part).orderBy(order)
    base = df.withColumn("_rn", F.row_number().over(w)) \
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(part)))
    base = base.withColumn("_src", hash_int(F.concat_ws("|", F.col(part).cast("string"), F.col("_rn").cast("string")),
                                            seed) % F.col("_n") + 1)
    vals = base.select(F.col(part), F.col("_rn").alias("_src"), *[F.col(c).alias(f"_v_{c}") for c in cols])
    j = base.drop(*cols).join(vals, on=[part, "_src"], how="left")
    return j.select(*[F.col(f"_v_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def resample_global(df: DataFrame, order_cols, cols, seed, replace: bool = True) -> DataFrame:
    """Resample each column of ``cols`` over the whole table (seed + i per
    column, as the reference does).  With replacement: row r takes row
    1 + hash mod n; without: a hash permutation.  Both are equi-joins on a
    global row number computed from a range-partitioned sort (no single task)."""
    ordered = _global_index(df, order_cols)
    n = ordered.count()
    out = ordered
    for i, c in enumerate(cols):
        s = seed + i
        if replace:
            src = hash_int(F.col("_idx"), s) % n + 1
            out = out.withColumn(f"_src{i}", src)
        else:
            perm = _global_index(ordered.select("_idx", hash_int(F.col("_idx"), s).alias("_h")), ["_h", "_idx"], "_pidx")
            out = out.join(perm.select("_idx", F.col("_pidx").alias(f"_src{i}")), "_idx")
        vals = ordered.select(F.col("_idx").alias(f"_src{i}"), F.col(c).alias(f"_v{i}"))
        out = out.drop(c).join(vals, f"_src{i}", "left").withColumnRenamed(f"_v{i}", c).drop(f"_src{i}")
    return out.drop("_idx").select(*df.columns)


def _global_index(df: DataFrame, order_cols, name: str = "_idx") -> DataFrame:
    """1-based global row number in ``order_cols`` order without a single-task
    window.  The range-sorted rows are written once to the shared checkpoint
    folder with (partition, place in it) packed into one id; counts, offsets
    and every later reader see that one table, so tied or re-evaluated rows
    cannot change places.  The broadcast offsets have one row per partition."""
    local_bits = 33  # layout of monotonically_increasing_id
    tagged = materialize(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                           .withColumn("_mid", F.monotonically_increasing_id()), "global-index")
    pid = F.shiftright("_mid", local_bits)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << local_bits) - 1)) + 1
    return tagged.withColumn("_pid", pid).join(F.broadcast(offs), "_pid") \
                 .withColumn(name, F.col("_off") + place).drop("_pid", "_mid", "_off")


def placebo_events(units_weights: DataFrame, ids: DataFrame, start: str, n_days: int, seed, unit: str = "unit",
                   weight: str = "w") -> DataFrame:
    """One placebo event per id: uniform date in [start, start + n_days)
    and a unit drawn with probability ∝ weight (cumulative-weight lookup
    against the unit weight table, one row per unit, broadcast)."""
    w = units_weights.select(unit, weight)
    total = Window.orderBy(unit).rowsBetween(Window.unboundedPreceding, 0)
    cw = w.withColumn("_hi", F.sum(weight).over(total) / F.sum(weight).over(Window.partitionBy())) \
          .withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy(unit)), F.lit(0.0)))
    draws = ids.select(F.col("id").alias("placebo_id"),
                                  hash_uniform(F.col("id"), f"{seed}|u").alias("_u"),
                                  (hash_int(F.col("id"), f"{seed}|d") % n_days).alias("_dd"))
    j = draws.join(F.broadcast(cw), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return j.select("placebo_id", unit, F.date_add(F.to_date(F.lit(start)), F.col("_dd").cast("int")).alias("day"))


def index_within_group(df: DataFrame, group: str, order_cols, name: str = "pos") -> DataFrame:
    """1-based position of each row inside its group in ``order_cols`` order,
    computed from a global range-partitioned index minus the group's first
    index (an aggregate + broadcast-free join).  A hot group is spread over
    many range partitions instead of one window task."""
    g = _global_index(df, [group, *order_cols], "_gidx")
    first = g.groupBy(group).agg(F.min("_gidx").alias("_g0"))
    return g.join(first, group).withColumn(name, F.col("_gidx") - F.col("_g0") + 1).drop("_gidx", "_g0")
