"""Propensity scores and weighting estimators.

Models are fitted by Newton steps that are one distributed pass each for all
folds (``multi.logistic_newton``); scoring and the weighted means are plain
column expressions and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import quotient
from . import multi as M
from .gram import dot


def _by_fold(fold: str, models: dict, columns) -> Column:
    """The linear predictor of each row under its fold's coefficients (constant first)."""
    out = F.lit(None).cast("double")
    for f, beta in models.items():
        out = F.when(F.col(fold) == f, F.lit(float(beta[0])) + dot(columns, beta[1:])).otherwise(out)
    return out


def cross_fitted_scores(df: DataFrame, label: str, features, fold: str, k: int, c: float = 1.0) -> DataFrame:
    """Each fold scored by a model fitted on the other folds: L2 logistic regression with the objective
    C·Σloss + ½||w||², whose constant is penalised like any coefficient.  Features must be complete."""
    features = list(features)
    d = df.withColumn("fold", F.col(fold).cast("int")).select("fold", *[F.col(x).cast("double").alias(x) for x in [label, *features]])
    fits = M.logistic_newton(d, {label: [label, *features]}, k, c)
    z = _by_fold(fold, {f: fits[label, f][0] for f in range(k)}, features)
    return df.withColumn("propensity", 1 / (1 + F.exp(-z)))


def ipw_att(df: DataFrame, y: str, w: str, e: str, clip: float | None = None) -> DataFrame:
    """C14: ATT = mean(Y | W=1) − Σ ω(1−W)Y / Σ ω(1−W), ω = e/(1−e) (Hájek); NaN
    where no unit is a control."""
    ec = F.col(e)
    if clip is not None:
        ec = F.least(F.greatest(ec, F.lit(clip)), F.lit(1 - clip))
    om = ec / (1 - ec)
    ctl = (1 - F.col(w)) * om
    a = df.agg(F.avg(F.when(F.col(w) == 1, F.col(y))).alias("treated_mean"),
               quotient(F.sum(ctl * F.col(y)), F.sum(ctl)).alias("control_mean"),
               F.sum(F.col(w)).cast("long").alias("n_treated"), F.sum(1 - F.col(w)).cast("long").alias("n_control"))
    return a.withColumn("att", F.col("treated_mean") - F.col("control_mean"))


def aipw(df: DataFrame, y: str, w: str, features, fold: str, k: int) -> DataFrame:
    """Doubly robust ATE/ATT with cross-fitting: outcome models per arm (lasso by information criterion from the
    fold Grams, all arms and folds in one pass) and logistic scores fitted on the other folds."""
    features = list(features)
    d = df.withColumn("fold", F.col(fold).cast("int")).select("fold", *[F.col(x).cast("double").alias(x) for x in [w, y, *features]])
    plan = M.Plan({w: [w, *features]}, {y: (y, 0)}, folds=k)
    models = M.outcome_models(d, plan, [y])
    s = cross_fitted_scores(df, w, features, fold, k)
    for arm in (0, 1):
        s = s.withColumn(f"mu{arm}", _by_fold(fold, {f: models[w, f, arm][:, 0] for f in range(k)}, features))
    e = F.least(F.greatest(F.col("propensity"), F.lit(M.CLIP)), F.lit(1 - M.CLIP))
    psi = F.col("mu1") - F.col("mu0") + F.col(w) * (F.col(y) - F.col("mu1")) / e \
        - (1 - F.col(w)) * (F.col(y) - F.col("mu0")) / (1 - e)
    att_num = F.col(w) * (F.col(y) - F.col("mu0")) - (1 - F.col(w)) * e / (1 - e) * (F.col(y) - F.col("mu0"))
    return s.agg(F.avg(psi).alias("ate"), (F.sum(att_num) / F.sum(F.col(w))).alias("att"),
                 F.stddev_samp(psi).alias("sd_psi"), F.count(F.lit(1)).alias("n"))


def class_weights(label: Column) -> list[Column]:
    """N / (2 · n_class) for classes 0 and 1."""
    n = F.count(F.lit(1))
    n1 = F.sum(label)
    return [F.try_divide(n, 2 * (n - n1)).alias("w0"), F.try_divide(n, 2 * n1).alias("w1")]
