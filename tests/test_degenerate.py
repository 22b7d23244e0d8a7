"""Treatments without variation: at scale every unit is treated every day, so nothing is left to compare."""
import math

import numpy as np
import pytest

from ripplekit.estimators.gram import ridge_from_gram
from ripplekit.estimators.iv import first_stage_f
from ripplekit.estimators.ml import pooled_regressors
from ripplekit.estimators.propensity import ipw_att
from ripplekit.operators.aggregates import corr_pairs, instrument_screen

ROWS = [(1, 2.0, 5.0), (1, 3.0, 1.0), (1, None, 7.0), (1, 7.0, 2.0)]


def test_instrument_screen_constant_treatment(spark):
    r = instrument_screen(spark.createDataFrame(ROWS, "w int, z double, y double"), ["z"], "w", "y").first()
    assert math.isnan(r.corr_treatment) and r.wald == -math.inf and r.n == 3
    z, y = np.array([(a[1], a[2]) for a in ROWS if a[1] is not None]).T
    assert r.corr_outcome == pytest.approx(np.corrcoef(z, y)[0, 1])


def test_corr_pairs_constant_column(spark):
    got = {(r.a, r.b): r["corr"] for r in corr_pairs(spark.createDataFrame(ROWS, "w int, z double, y double"), ["w", "z", "y"]).collect()}
    assert math.isnan(got["w", "z"]) and math.isnan(got["w", "y"])
    z, y = np.array([(a[1], a[2]) for a in ROWS if a[1] is not None]).T
    assert got["z", "y"] == pytest.approx(np.corrcoef(z, y)[0, 1])


def test_first_stage_constant_treatment(spark):
    r = first_stage_f(spark.createDataFrame(ROWS, "w int, z double, y double"), "w", ["z"]).first()
    assert math.isnan(r.f) and r.n == 3


def test_ipw_without_controls(spark):
    r = ipw_att(spark.createDataFrame([(1, 0.5, 2.0), (1, 0.9, 4.0)], "w int, e double, y double"), "y", "w", "e", clip=0.01).first()
    assert r.treated_mean == 3.0 and math.isnan(r.control_mean) and math.isnan(r.att) and (r.n_treated, r.n_control) == (2, 0)


def test_ridge_with_constant_and_repeated_columns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1.0, 300.0]
    y = 4 + x @ [2.0, -0.01] + rng.normal(size=200)
    X = np.column_stack([np.ones(200), x, np.ones(200), x[:, 0]])
    A = np.column_stack([X, y])
    b = ridge_from_gram(A.T @ A)
    full = np.column_stack([np.ones(200), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.allclose(X @ b, full @ want) and b[3] == 0.0 and b[1] == pytest.approx(b[4])
    B = np.column_stack([full, y])
    pen = np.diag([0.0, 10.0, 10.0])
    assert np.allclose(ridge_from_gram(B.T @ B, 10.0), np.linalg.solve(full.T @ full + pen, full.T @ y))
    assert not ridge_from_gram(np.zeros((4, 4))).any()


def test_pooled_regressors_without_training_rows(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "y double, x double, rel double")
    got = pooled_regressors(df, "y", ["x"], F.col("rel") < 0).collect()
    assert sorted((r.model, r.period, r.mse, r.n) for r in got) == [(m, "post", None, 1) for m in ("boosting", "forest", "poisson")]
    assert pooled_regressors(df.where("false"), "y", ["x"], F.col("rel") < 0).collect() == []
