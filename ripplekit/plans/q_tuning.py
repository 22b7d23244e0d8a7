"""Regression tuning (C30): method x lags x added features x fold from one Gram."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import roles
from ..estimators import shrinkage as S
from ..estimators.gram import collect_gram
from ..estimators.passes import array_sums
from ..functions.dates import WEEKDAYS, holiday_flag, weekday_name
from ..operators import windows as W
from ..operators.reshape import one_hot_drop_first
from ..operators.sampling import hash_fold
from ..session import materialize
from ..sources import views as V
from ..sources.tables import dim
from .registry import query

Y = "media_online_protest"
FOLDS, STEP = 5, 6
LAGS = tuple(range(1, 15, 2))
FEATURES = ((), ("diff",), ("diff", "ewm"))


def tuning_design(spark, d):
    """Panel with every column that some design of the grid uses (lags 0 .. max(LAGS) days back, differences and
    moving means of the outcome), one shuffle on the unit; stored, as two passes read it.  All designs are compared on
    the same rows: those for which the longest one is complete."""
    p = V.panel(spark, d).select("unit", "day", "occ_protest", Y)
    area = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("unit"), F.col("r_name").alias("area"))
    p = p.join(F.broadcast(area), "unit").repartition("unit").withColumn("wd", weekday_name("day"))
    p = p.select("*", *one_hot_drop_first("wd", WEEKDAYS, "weekday"), holiday_flag("day", "area").alias("holiday"))
    p = p.withColumn(f"{Y}_diff", W.diff(Y, 1))
    p = W.ewm_mean(p, Y, 7.0, f"{Y}_ewm")
    lags = list(range(-max(LAGS), 1))
    p = W.lag_block(p, ["occ_protest", Y, f"{Y}_diff", f"{Y}_ewm"], lags, keep=roles.design_lag)
    p = p.withColumn("y", W.cumulative_target(Y, STEP))
    xs = [c for c in p.columns if "_lag" in c] + [f"weekday_{w}" for w in sorted(WEEKDAYS)[1:]] + ["holiday"]
    p = p.withColumn("fold", hash_fold(F.concat_ws("|", "unit", F.col("day").cast("string")), FOLDS, 11))
    p = p.select("fold", F.lit(1.0).alias("const"), *[F.col(c).cast("double").alias(c) for c in [*xs, "y"]]).dropna()
    return materialize(p, "tuning_design"), xs


def design_columns(xs, lags: int, features) -> list[str]:
    """The columns of one design: what has no lag, and lags up to ``lags`` days of the series and wanted features."""
    out = []
    for c in xs:
        name, _, lag = c.partition("_lag")
        feature = name[len(Y) + 1:] if name.startswith(Y + "_") else ""
        if not lag or (-int(lag) <= lags and (not feature or feature in features)):
            out.append(c)
    return out


METHODS = {"ols": lambda mo: (S.least_squares(mo), 0.0, True), "lasso": lambda mo: (*S.lasso_ic(mo), True), "ridge": S.bayesian_ridge}


def tuning_grid(p, xs, lags=LAGS, features=FEATURES, folds: int = FOLDS):
    """Rows method x lags x features x fold: rmse, r2, bias and the penalty from the fold Grams, mae by a second pass that
    scores every design of a row's fold at once."""
    cols = ["const", *xs, "y"]
    at = {c: i for i, c in enumerate(cols)}
    G = {f: m for (f,), (_, _, m) in collect_gram(p, cols, ["fold"]).items()}
    if not G:
        return p.sparkSession.createDataFrame([], GRID_SCHEMA)
    total, yi = sum(G.values()), at["y"]
    rows, betas = [], {}
    for f, held in sorted(G.items()):
        n, sy = held[0, 0], held[0, yi]
        sst = held[yi, yi] - sy * sy / n
        for lag in lags:
            for feats in features:
                use = [at[c] for c in design_columns(xs, lag, feats)]
                mo = S.moments(total - held, use, yi)
                ix = [0, *use]
                for method, fit in METHODS.items():
                    b, penalty, settled = fit(mo)
                    b = mo.with_intercept(b)
                    sse = held[yi, yi] - 2 * b @ held[ix, yi] + b @ held[np.ix_(ix, ix)] @ b
                    full = np.zeros(len(cols) - 1)
                    full[ix] = b
                    betas.setdefault(f, []).append(full)
                    rows.append([method, lag, "+".join(feats), int(f), int(n), float(np.sqrt(max(sse, 0) / n)),
                                 float(1 - sse / sst) if sst > 0 else None, float((b @ held[0, ix] - sy) / n), float(penalty),
                                 int(np.count_nonzero(b[1:])), bool(settled)])
    B = {f: np.array(v).T for f, v in betas.items()}

    def errors(pdf):
        X, y, fold = pdf[cols[:-1]].to_numpy(float), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
        return {str(f): np.abs(X[fold == f] @ B[f] - y[fold == f, None]).sum(axis=0) for f in np.unique(fold)}

    mae = array_sums(p, errors)
    seen = dict.fromkeys(B, 0)
    for r in rows:
        f = r[3]
        r.insert(8, float(mae[str(f)][seen[f]] / r[4]))
        seen[f] += 1
    return p.sparkSession.createDataFrame([tuple(r) for r in rows], GRID_SCHEMA)


GRID_SCHEMA = ("method string, lags int, features string, fold int, n long, rmse double, r2 double, bias double, mae double, "
               "penalty double, n_coefs int, settled boolean")


@query("reg_grid")
def reg_grid(spark, d):
    """Least squares, lasso (information criterion) and Bayesian ridge over 7 lag orders, 3 feature sets and 5 folds."""
    return tuning_grid(*tuning_design(spark, d))


@query("reg_best")
def reg_best(spark, d):
    """Mean and deviation of each metric over the folds; the best setting of each method by smallest |bias|."""
    from pyspark.sql import Window
    g = reg_grid(spark, d)
    a = g.groupBy("method", "lags", "features").agg(
        *[f(c).alias(c + s) for c in ("rmse", "r2", "mae", "bias") for f, s in ((F.avg, ""), (F.stddev_pop, "_std"))])
    w = Window.partitionBy("method").orderBy(F.abs("bias"), "lags", "features")
    return a.withColumn("rank", F.row_number().over(w))
