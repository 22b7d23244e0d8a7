"""Treatment classifiers on series and text."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles
from ..estimators import stacked as K
from ..functions.dates import weekday_name
from ..operators import windows as W
from ..operators.sampling import hash_fold
from ..session import materialize
from ..sources import views as V
from ..sources.tables import dim, table
from .registry import query

FOLDS = 5
SERIES = ["occ_protest", *V.MEDIA_COLS[:2]]


def daily_terms(spark, d):
    """(unit, day, term, n): the words and word pairs of the names of what a unit ships that day (role of the day's
    newspaper text), counted before the join with the units' days."""
    part = table(spark, d, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), r"\s+").alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1),
                                               lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    grams = part.select("p_partkey", F.concat("w", pairs).alias("terms"))
    sup = table(spark, d, "supplier").join(dim(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .select("s_suppkey", F.col("n_name").alias("unit"))
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    sold = (line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("unit", "day", "l_partkey")
            .agg(F.count(F.lit(1)).alias("m")))
    return (sold.join(grams, F.col("l_partkey") == F.col("p_partkey")).select("unit", "day", F.explode("terms").alias("term"), "m")
            .groupBy("unit", "day", "term").agg(F.sum("m").alias("n")))


def classifier_rows(spark, d):
    """Unit-days with label, standardised series (two to four days back, so that no feature knows the label's day or the
    day before), a Friday flag, a time fold and an inner fold."""
    p = V.panel(spark, d).select("unit", "day", *SERIES).repartition("unit")
    p = W.lag_block(p, SERIES, [-4, -3, -2], keep=roles.design_lag)
    xs = [c for c in p.columns if "_lag" in c]
    p = p.dropna(subset=xs).withColumn("friday", (weekday_name("day") == "Friday").cast("double"))
    xs.append("friday")
    st = p.agg(*[f(x).alias(x + s) for x in xs for f, s in ((F.avg, "_m"), (F.stddev_samp, "_s"))],
               F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    days = (st["hi"] - st["lo"]).days + 1 if st["lo"] else 1
    fold = F.floor(F.datediff("day", F.lit(st["lo"])) * FOLDS / F.lit(days)).cast("int")
    scaled = [((F.col(x) - (st[x + "_m"] or 0.0)) / (st[x + "_s"] or 1.0)).alias(x) for x in xs]
    rows = p.select("unit", "day", F.col("occ_protest").alias("label"), fold.alias("fold"),
                    hash_fold(F.concat_ws("|", "unit", F.col("day").cast("string")), 3, 21).alias("inner"), *scaled)
    return rows, xs


def _scores(spark, d):
    rows, xs = classifier_rows(spark, d)
    return K.stacked_scores(materialize(rows, "stacked_rows"), materialize(daily_terms(spark, d), "stacked_terms"), ["unit", "day"],
                            "label", xs, FOLDS, store=lambda t: materialize(t, "stacked_step"))


@query("stacked_classifier")
def stacked_classifier(spark, d):
    """F1 of series, text, combined and stacked features over expanding time folds."""
    return K.fold_metrics(_scores(spark, d), "label")


@query("text_proba")
def text_proba(spark, d):
    """Every later unit-day's cross-predicted probabilities, one column for each set of features."""
    s = _scores(spark, d)
    return s.groupBy("unit", "day", "fold", "label").pivot("features", list(K.SETS)).agg(F.max("score"))
