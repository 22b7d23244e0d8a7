"""Ranks, quantiles and ranking metrics from counts of distinct values, without a single-task window or per-group buffers
(A11, A22, A35, C37, C41).

A table of (group, value) counts is range-partitioned once and stored; a value's rank is the sum of the partitions before
its own (a few numbers for each group) plus the running sum inside its partition.  A hot group spreads over partitions
like any other rows, and equal values never part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def value_counts(df: DataFrame, group, value: str, label: str | None = None) -> DataFrame:
    """(group, value, n [, pos]): one row for each distinct value; nulls do not count."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(F.col(label).cast("long")).alias("pos")] if label else [])
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(*aggs)


def with_before(counts: DataFrame, group, value: str, sums=("n",)) -> DataFrame:
    """counts with, for each column of ``sums``, ``{c}_before`` (its sum over smaller values of the group) and ``{c}_total``
    (over the whole group)."""
    group = list(group)
    t = materialize(counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "ranks")
    parts = t.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    if group:  # at most one row for each group and partition
        w = Window.partitionBy(*group)
        parts = parts.select(*group, "_part", *[F.sum(f"_s_{c}").over(w).alias(f"{c}_total") for c in sums],
                             *[F.coalesce(F.sum(f"_s_{c}").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias(f"_o_{c}") for c in sums])
    else:  # one row for each partition: added up on the driver
        rows = sorted(parts.collect(), key=lambda r: r["_part"])
        total = {c: sum(r[f"_s_{c}"] for r in rows) for c in sums}
        run, out = dict.fromkeys(sums, 0), []
        for r in rows:
            out.append((r["_part"], *[total[c] for c in sums], *[run[c] for c in sums]))
            run = {c: run[c] + r[f"_s_{c}"] for c in sums}
        schema = ", ".join(["_part int", *[f"{c}_total long" for c in sums], *[f"_o_{c} long" for c in sums]])
        parts = t.sparkSession.createDataFrame(out, schema)
    inside = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = t.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    if group:  # null is a group of its own
        parts = parts.toDF(*[f"_k_{c}" if c in group else "_p" if c == "_part" else c for c in parts.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in group]
        out = out.join(parts, [F.col("_part") == F.col("_p"), *same]).drop("_p", *[f"_k_{c}" for c in group])
    else:
        out = out.join(F.broadcast(parts), "_part")
    return out.withColumns({f"{c}_before": F.col(f"_l_{c}") + F.col(f"_o_{c}") for c in sums}) \
              .drop("_part", *[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def quantiles(df: DataFrame, group, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between order statistics): group and one column for each name of ``probs``."""
    t = with_before(value_counts(df, group, value), group, value)
    aggs = []
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        low, high = F.max(F.when(holds(lo), F.col(value))), F.max(F.when(holds(hi), F.col(value)))
        aggs.append((low + (high - low) * F.max(h - lo)).alias(name))
    return t.groupBy(*group).agg(*aggs)


def auc(df: DataFrame, group, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank; null where a group has one class."""
    t = with_before(value_counts(df, group, score, label), group, score, ("n", "pos"))
    a = t.groupBy(*group).agg(F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2.0)).alias("rs"),
                              F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return a.select(*group, F.try_divide(u, F.col("n1") * (F.col("n") - F.col("n1"))).alias("auc"), F.col("n").cast("long").alias("n"),
                    F.col("n1").cast("long").alias("n_positive"))


def pr_curve(df: DataFrame, group, score: str, label: str) -> DataFrame:
    """One row for each distinct score as threshold (rows at or above it are called positive): tp, fp, fn, precision,
    recall, f1 and ``step``, the recall this threshold adds."""
    t = with_before(value_counts(df, group, score, label), group, score, ("n", "pos"))
    called, tp = F.col("n_total") - F.col("n_before"), F.col("pos_total") - F.col("pos_before")
    return t.select(*group, F.col(score).alias("threshold"), tp.alias("tp"), (called - tp).alias("fp"), F.col("pos_before").alias("fn"),
                    (tp / called).alias("precision"), F.try_divide(tp, F.col("pos_total")).alias("recall"),
                    (2 * tp / (called + F.col("pos_total"))).alias("f1"), F.try_divide(F.col("pos"), F.col("pos_total")).alias("step"))


def average_precision(df: DataFrame, group, score: str, label: str) -> DataFrame:
    """Average precision, and the threshold with the best F1 (ties: the largest threshold)."""
    c = pr_curve(df, group, score, label)
    return c.groupBy(*group).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"),
                                 F.max(F.struct("f1", "threshold", "precision", "recall")).alias("best")) \
            .select(*group, "average_precision", F.col("best.f1").alias("best_f1"), F.col("best.threshold").alias("best_threshold"),
                    F.col("best.precision").alias("best_precision"), F.col("best.recall").alias("best_recall"))
