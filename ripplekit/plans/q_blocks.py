"""Block components (C11), the climatology-controlled timeline (C39) and the gain from instruments."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..estimators import blocks as B
from ..estimators import ml as ML
from ..operators import windows as W
from ..session import materialize
from ..sources import views as V
from .q_models import design
from .registry import query

BLOCKS = {"seasonal": [f"{c}_seasonal" for c in V.INSTR_COLS], "resid": [f"{c}_resid" for c in V.INSTR_COLS]}
BLOCKS["all"] = BLOCKS["seasonal"] + BLOCKS["resid"]


def _filled_instruments(spark, d):
    """Instruments on the spine; days without a value take the last one before (at the start: the first one after)."""
    p = V.spine(spark, d).join(V.instr(spark, d), ["unit", "day"], "left").repartition("unit")
    w = Window.partitionBy("unit").orderBy("day")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return p.select("unit", "day", *[F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)).alias(c) for c in V.INSTR_COLS])


def _components(spark, d):
    p = materialize(W.deseason(_filled_instruments(spark, d), V.INSTR_COLS).dropna(), "blocks")
    return B.block_components(p, BLOCKS)


@query("pca_scores")
def pca_scores(spark, d):
    """C11: component scores of the seasonal, the residual and all parts of the instruments, in their place."""
    return _components(spark, d)[1].select("unit", "day", *[f"pc_{b}_{i}" for b, cs in BLOCKS.items() for i in range(len(cs))])


@query("pca_loadings")
def pca_loadings(spark, d):
    """C11: loadings and variance share of every component, by block."""
    rows = []
    for b, (vector, value, _, _) in _components(spark, d)[0].items():
        for i in range(len(value)):
            rows += [(b, f"pc_{b}_{i}", c, float(vector[j, i]), float(value[i]), float(value[i] / value.sum())) for j, c in enumerate(BLOCKS[b])]
    return spark.createDataFrame(rows, "block string, component string, instrument string, loading double, variance double, share double")


DAYS, MONTHS = range(-14, 15), range(-24, 25)


@query("climatology_timeline")
def climatology_timeline(spark, d):
    """Size of a day's events on the instrument of days -14..14 and months -24..24 around it: alone, and as its
    departure from the unit's mean of that calendar month with that mean as control.  One pass over wide rows."""
    z = "weather_tax"
    p = V.spine(spark, d).join(V.instr(spark, d).select("unit", "day", z), ["unit", "day"], "left") \
        .withColumn("month", F.trunc("day", "month"))
    monthly = p.groupBy("unit", "month").agg(F.avg(z).alias("zm"))
    clim = Window.partitionBy("unit", F.month("month"))
    monthly = monthly.withColumn("cm", F.avg("zm").over(clim))
    months = monthly.select("unit", "month", "cm", *[W.shift(c, -s, "unit", "month").alias(f"{c}_m{s}") for s in MONTHS for c in ("zm", "cm")])
    p = p.join(monthly.select("unit", "month", F.col("cm").alias("cd")), ["unit", "month"]).repartition("unit")
    p = p.select("unit", "day", "month", *[W.shift(c, -s).alias(f"{n}_d{s}") for s in DAYS for n, c in (("zd", z), ("cd", "cd"))])
    y = V.treat(spark, d).select("unit", "day", F.asinh("size_protest").alias("y"))
    j = y.join(p, ["unit", "day"]).join(months, ["unit", "month"])
    models, depart = {}, {}
    for scale, tag, offsets in (("day", "d", DAYS), ("month", "m", MONTHS)):
        for s in offsets:
            zc, cc, a = f"z{tag}_{tag}{s}", f"c{tag}_{tag}{s}", f"a{tag}_{tag}{s}"
            depart[a] = F.col(zc) - F.col(cc)
            models[scale, s, "raw"] = {"weather": zc}
            models[scale, s, "departure"] = {"departure": a, "climatology": cc}
    rows = B.timeline(j.withColumns(depart).drop("unit", "day", "month"), "y", models)
    return spark.createDataFrame(rows, "scale string, shift int, model string, predictor string, beta double, se double, p double, r2 double, n long")


GAIN_FOLDS = 20


@query("instrument_gain")
def instrument_gain(spark, d):
    """Do the instruments help to tell event days?  F1 over expanding time folds with and without them, paired
    one-sided t: balanced logistic regression on 20 folds, random forest on 5."""
    p, xs, _ = design(spark, d, instruments=True, lags=[-2, -1, 0])
    conf = [c for c in xs if c != "occ_protest_lag0"]
    p = p.select("day", F.col("occ_protest_lag0").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in [*conf, *V.INSTR_COLS]]).dropna()
    lo, hi = p.agg(F.min("day"), F.max("day")).first()
    st = p.agg(*[f(c).alias(c + s) for c in [*conf, *V.INSTR_COLS] for f, s in ((F.avg, "_m"), (F.stddev_samp, "_s"))]).first()
    place = F.datediff("day", F.lit(lo)) / F.lit((hi - lo).days + 1 if lo else 1)
    p = materialize(p.select("label", F.floor(place * GAIN_FOLDS).cast("int").alias("fold"), F.floor(place * 5).cast("int").alias("five"),
                             *[((F.col(c) - (st[c + "_m"] or 0.0)) / (st[c + "_s"] or 1.0)).alias(c) for c in [*conf, *V.INSTR_COLS]]), "gain")
    sets = {"confounders": conf, "with_instruments": conf + V.INSTR_COLS}
    f1 = {"logistic": B.logistic_fold_f1(p, "label", sets, GAIN_FOLDS)}
    five = p.withColumn("label", F.col("label").cast("double"))
    f1["random_forest"] = {s: [r["f1"] for r in ML.rf_time_folds(five, "label", cols, "five", 5).orderBy("fold").collect()] for s, cols in sets.items()}
    rows = []
    for model, by in f1.items():
        pairs = [(a, b) for a, b in zip(by["confounders"], by["with_instruments"]) if a is not None and b is not None]
        t, pv, n = B.paired_t([b - a for a, b in pairs])
        mean = lambda i: float(sum(x[i] for x in pairs) / len(pairs)) if pairs else None
        rows.append((model, mean(0), mean(1), t, pv, n))
    return spark.createDataFrame(rows, "model string, f1_confounders double, f1_with_instruments double, t double, p double, n_folds int")
