"""Aggregate operators.

Everything is a hash aggregate with map-side partial aggregation; ranked
outputs use a window over the *aggregated* rows, never over raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_ppf


def count_pivot(df: DataFrame, keys, pivot_col: str, values, prefix: str = "") -> DataFrame:
    """A4: count by key × known pivot values (0 when absent)."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(pivot_col) == v, 1).otherwise(0)).cast("long")
                                   .alias(f"{prefix}{v}") for v in values])


def availability(avg_of, threshold: float) -> Column:
    """A5: per-group flag mean > threshold; null mean -> false."""
    return F.coalesce(F.avg(avg_of) > threshold, F.lit(False))


def with_total_row(df: DataFrame, key: str, aggs, label: str = "Total") -> DataFrame:
    """Group rows plus a grand-total row via ROLLUP (one aggregate)."""
    r = df.rollup(key).agg(*aggs, F.grouping_id().alias("_g"))
    return r.withColumn(key, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(key))).drop("_g")


def top_k_shares(df: DataFrame, part, key: str, k: int = 10, buckets: int = 64) -> DataFrame:
    """Value counts, top k per group (ties by key), share of the top-k total.

    Two-level exact top-k: rank inside (group, hash bucket of key) first and
    keep k per bucket, then rank the ≤ k × buckets survivors per group.  The
    group's global top k is contained in the union of the bucket top-ks, and a
    group with millions of distinct keys is never sorted by one task."""
    c = df.groupBy(*part, key).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col(key)]
    c = c.withColumn("_b", F.abs(F.xxhash64(key)) % buckets)
    local = c.withColumn("_r", F.row_number().over(Window.partitionBy(*part, "_b").orderBy(*order))) \
             .where(F.col("_r") <= k).drop("_r", "_b")
    top = local.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))) \
               .where(F.col("rank") <= k)
    return top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*part)))


def with_group_stats(df: DataFrame, part, aggs: dict) -> DataFrame:
    """W13/W14 for groups that may be hot: the group statistic is a hash
    aggregate (map-side combine) joined back on the group key, instead of a
    window that would put a whole group into one task."""
    st = df.groupBy(*part).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(st, on=list(part), how="left")


def masked_weighted_mean(x, w) -> Column:
    """sum(w·x) / sum(w where x is not null) — nulls neither count nor weigh."""
    x = F.col(x) if isinstance(x, str) else x
    w = F.col(w) if isinstance(w, str) else w
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def unpivot(df: DataFrame, ids, cols, var: str = "variable", val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), var, val)


def quotient(a, b) -> Column:
    """a / b as SQL's doubles have it: infinite over 0, NaN for 0 / 0 (Spark's own division raises)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation over the rows that have both; NaN where one of them is constant (Spark's own
    raises there)."""
    sd = [F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) for x, y in ((a, b), (b, a))]
    return quotient(F.covar_pop(a, b), sd[0] * sd[1])


def instrument_screen(df: DataFrame, instruments, treatment: str, outcome: str) -> DataFrame:
    """Per instrument corr(z, w), corr(z, y) and Wald = cov(z,y)/cov(z,w),
    as ONE grouped aggregate over the unpivoted instruments.  A constant column has no correlation (NaN)."""
    long = df.select(treatment, outcome, *instruments) \
             .unpivot([treatment, outcome], list(instruments), "instrument", "z").where(F.col("z").isNotNull())
    return long.groupBy("instrument").agg(
        correlation("z", treatment).alias("corr_treatment"), correlation("z", outcome).alias("corr_outcome"),
        quotient(F.covar_samp("z", outcome), F.covar_samp("z", treatment)).alias("wald"),
        F.count(F.lit(1)).alias("n"))


def corr_pairs(df: DataFrame, cols) -> DataFrame:
    """Pairwise Pearson correlations in one aggregate, long form (a, b, corr)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    st = F.stack(F.lit(len(pairs)), *[x for a, b in pairs for x in (F.lit(a), F.lit(b), F.col(f"`{a}|{b}`"))])
    return row.select(st.alias("a", "b", "corr"))


def effect_summary(df: DataFrame, group, x: str, level: float = 0.95) -> DataFrame:
    """Per group n, mean, t interval, RMSE, MAE of the effect column.
    The t quantiles for every possible n come from a small broadcast table
    computed on the driver (its size is the largest group size, known after
    one tiny aggregate)."""
    stats = df.where(F.col(x).isNotNull()).groupBy(*group).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rmse"), F.avg(F.abs(x)).alias("mae"))
    spark = df.sparkSession
    ns = [r["n"] for r in stats.select("n").distinct().collect()]
    tq = spark.createDataFrame([(int(n), float(t_ppf(0.5 + level / 2, n - 1)) if n > 1 else None) for n in ns],
                               "n long, tq double")
    j = stats.join(F.broadcast(tq), "n", "left")
    half = F.col("tq") * F.col("sd") / F.sqrt(F.col("n"))
    return j.select(*group, "n", "mean", (F.col("mean") - half).alias("ci_lower"),
                    (F.col("mean") + half).alias("ci_upper"), "rmse", "mae")


def confusion(truth, pred) -> list[Column]:
    """Tp, fp, fn, tn, precision, recall, F1 and macro F1 as aggregate columns."""
    t = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred
    tp = F.sum(F.when((t == 1) & (p == 1), 1).otherwise(0))
    fp = F.sum(F.when((t == 0) & (p == 1), 1).otherwise(0))
    fn = F.sum(F.when((t == 1) & (p == 0), 1).otherwise(0))
    tn = F.sum(F.when((t == 0) & (p == 0), 1).otherwise(0))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    f1 = F.try_divide(2 * tp, 2 * tp + fp + fn)
    f1_neg = F.try_divide(2 * tn, 2 * tn + fn + fp)
    return [tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"),
            tn.cast("long").alias("tn"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
            ((F.coalesce(f1, F.lit(0.0)) + F.coalesce(f1_neg, F.lit(0.0))) / 2).alias("macro_f1")]


def all_positive_f1(prevalence) -> Column:
    """F1 of predicting 1 everywhere = 2p / (1 + p)."""
    p = F.col(prevalence) if isinstance(prevalence, str) else prevalence
    return 2 * p / (1 + p)


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds) -> DataFrame:
    """precision/recall/F1 at every threshold — thresholds are generated
    per row (explode of a literal array), then one grouped aggregate."""
    x = df.select(truth, score).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    x = x.withColumn("_p", (F.col(score) >= F.col("threshold")).cast("int"))
    return x.groupBy("threshold").agg(*confusion(truth, "_p"))


def width_bucket(x, lo: float, hi: float, n: int) -> Column:
    """Bucket 1..n for lo <= x < hi, 0 below, n+1 above (SQL width_bucket)."""
    x = F.col(x) if isinstance(x, str) else x
    b = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / n)).cast("long") + 1
    return F.when(x < lo, F.lit(0).cast("long")).when(x >= hi, F.lit(n + 1).cast("long")).otherwise(b)


def week_end_sunday(day) -> Column:
    """A10: weekly bins ending on Sunday, labelled by that Sunday."""
    day = F.col(day) if isinstance(day, str) else day
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def reference_quarter_label(day) -> Column:
    """A10: the reference's quarter label (month // 3) * 3 (values 0, 3, 6, 9, 12)."""
    day = F.col(day) if isinstance(day, str) else day
    return (F.floor(F.month(day) / 3) * 3).cast("int")


def sum_cols(*cols) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) if isinstance(c, str) else c for c in cols])
