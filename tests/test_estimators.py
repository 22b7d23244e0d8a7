"""Estimators and numeric operators against NumPy / pure-Python closed forms."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplekit.estimators.iv import k_class
from ripplekit.estimators.linear import bh_by, ols
from ripplekit.estimators.solvers import nnls, project_simplex, simplex_ls
from ripplekit.functions.stats import chi2_sf, norm_ppf, t_ppf
from ripplekit.operators import windows as W


def _hc3(X, y):
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    meat = (X * (e ** 2 / (1 - h) ** 2)[:, None]).T @ X
    return b, np.sqrt(np.diag(inv @ meat @ inv))


def test_ols_hc3_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n = 400
    X = rng.normal(size=(n, 2))
    y = 0.5 + X @ np.array([1.0, -2.0]) + rng.normal(size=n) * (1 + np.abs(X[:, 0]))
    g = np.where(np.arange(n) % 3 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x1": X[:, 0], "x2": X[:, 1], "y": y}))
    r = ols(df, "y", ["x1", "x2"]).toPandas()
    b, se = _hc3(np.column_stack([np.ones(n), X]), y)
    assert np.allclose(r["coef"], b, atol=1e-9) and np.allclose(r["se"], se, atol=1e-9)
    rg = ols(df, "y", ["x1", "x2"], group=["g"]).toPandas()
    for gv in ("a", "b"):
        m = g == gv
        b, se = _hc3(np.column_stack([np.ones(m.sum()), X[m]]), y[m])
        sub = rg[rg.g == gv]
        assert np.allclose(sub["coef"], b, atol=1e-9) and np.allclose(sub["se"], se, atol=1e-9)


def test_two_stage_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 2000
    z = rng.normal(size=(n, 2))
    u = rng.normal(size=n)
    w = z @ np.array([1.0, 0.5]) + u + rng.normal(size=n)
    y = 2.0 * w + 3 * u + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "w": w, "z1": z[:, 0], "z2": z[:, 1]}))
    r = k_class(df, "y", ["w"], [], ["z1", "z2"]).toPandas()
    Z = np.column_stack([np.ones(n), z])
    R = np.column_stack([np.ones(n), w])
    P = Z @ np.linalg.solve(Z.T @ Z, Z.T)
    b = np.linalg.solve(R.T @ P @ R, R.T @ P @ y)
    got = r[(r.method == "2sls")].set_index("predictor")["coef"]
    assert np.allclose([got["const"], got["w"]], b, atol=1e-8)
    # over-identified LIML has kappa >= 1
    assert (r[r.method == "liml"]["kappa"] >= 1 - 1e-9).all()


def test_nnls_kkt():
    rng = np.random.default_rng(3)
    A = rng.normal(size=(40, 8))
    b = rng.normal(size=40)
    x = nnls(A, b)
    g = A.T @ (A @ x - b)
    assert (x >= 0).all()
    assert np.all(g[x > 1e-10] == pytest.approx(0, abs=1e-8))
    assert (g[x <= 1e-10] >= -1e-8).all()


def test_simplex_solver():
    rng = np.random.default_rng(4)
    A = rng.normal(size=(50, 5))
    w_true = np.array([0.2, 0.5, 0.3, 0.0, 0.0])
    w = simplex_ls(A, A @ w_true)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert np.allclose(w, w_true, atol=1e-4)
    assert abs(project_simplex(np.array([3.0, 1.0])).sum() - 1) < 1e-12


def test_distribution_helpers():
    assert t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-7)
    assert chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-7)


def _ewm_ref(x, span):
    a = 2 / (span + 1)
    out, num, den = [], 0.0, 0.0
    for v in x:
        num = v + (1 - a) * num
        den = 1 + (1 - a) * den
        out.append(num / den)
    return np.array(out)


@pytest.mark.parametrize("span", [3, 7, 224])
def test_ewm_exact_over_long_series(spark, span):
    rng = np.random.default_rng(5)
    n = 3000                       # long enough that q^-i would overflow for small spans
    x = rng.integers(0, 2, n).astype(float)
    pdf = pd.DataFrame({"unit": "u", "day": pd.date_range("2000-01-01", periods=n).date, "x": x})
    df = W.ewm_mean(spark.createDataFrame(pdf), "x", span, "e")
    got = df.orderBy("day").select("e").toPandas()["e"].to_numpy()
    assert np.allclose(got, _ewm_ref(x, span), rtol=1e-10, atol=1e-12)


def test_deseason_matches_convolution(spark):
    rng = np.random.default_rng(6)
    n = 300
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"unit": "u", "day": pd.date_range("2000-01-01", periods=n).date, "x": x})
    got = W.deseason(spark.createDataFrame(pdf), ["x"]).orderBy("day").toPandas()["x_seasonal"].to_numpy()
    w = np.array(W.gaussian_weights())
    exp = np.full(n, np.nan)
    for t in range(45, n - 44):
        exp[t] = (x[t - 45:t + 45] * w).sum() / w.sum()
    assert np.allclose(got[45:n - 44], exp[45:n - 44], atol=1e-12)
    assert np.isnan(got[:45].astype(float)).all() and np.isnan(got[n - 44:].astype(float)).all()


def test_cumulative_target_edges(spark):
    pdf = pd.DataFrame({"unit": "u", "day": pd.date_range("2000-01-01", periods=10).date, "y": np.arange(10.0)})
    got = spark.createDataFrame(pdf).select("day", W.cumulative_target("y", 2).alias("c")).orderBy("day").toPandas()["c"]
    exp = pd.Series(np.arange(10.0)).shift(-2).rolling(3).sum()
    assert got.isna().tolist() == exp.isna().tolist()
    assert np.allclose(got.dropna(), exp.dropna())


def test_bh_by(spark):
    p = np.array([0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216])
    df = spark.createDataFrame(pd.DataFrame({"i": range(10), "p": p}))
    got = bh_by(df, "p").orderBy("i").toPandas()["p_bh"].to_numpy()
    m = len(p)
    raw = p * m / np.arange(1, m + 1)
    exp = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert np.allclose(got, exp)
    got_by = bh_by(df, "p", method="by").orderBy("i").toPandas()["p_by"].to_numpy()
    c = sum(1 / i for i in range(1, m + 1))
    assert np.allclose(got_by, np.minimum(1, np.minimum.accumulate((raw * c)[::-1])[::-1]))


def test_gmm_and_sargan(spark):
    from ripplekit.estimators.iv import gmm_two_step
    rng = np.random.default_rng(7)
    n = 3000
    z = rng.normal(size=(n, 2))
    u = rng.normal(size=n)
    w = z @ np.array([1.0, 0.7]) + u + rng.normal(size=n)
    y = 1.5 * w + 2 * u + rng.normal(size=n)
    pdf = pd.DataFrame({"y": y, "w": w, "z1": z[:, 0], "z2": z[:, 1]})
    df = spark.createDataFrame(pdf)
    # just identified: GMM = 2SLS = simple IV
    g = gmm_two_step(df, "y", ["w"], [], ["z1"]).toPandas().set_index("predictor")
    iv = np.cov(z[:, 0], y)[0, 1] / np.cov(z[:, 0], w)[0, 1]
    assert g.loc["w", "coef"] == pytest.approx(iv, rel=1e-8)
    # Sargan = n · R² of 2SLS residuals on all instruments
    r = k_class(df, "y", ["w"], [], ["z1", "z2"]).toPandas()
    b = r[(r.method == "2sls")].set_index("predictor")["coef"]
    e = y - b["const"] - b["w"] * w
    Z = np.column_stack([np.ones(n), z])
    fit = Z @ np.linalg.lstsq(Z, e, rcond=None)[0]
    r2 = 1 - ((e - fit) ** 2).sum() / ((e - e.mean()) ** 2).sum()
    sargan = r[r.method == "sargan"]["coef"].iloc[0]
    assert sargan == pytest.approx(n * r2, rel=1e-6, abs=1e-8)



def test_2sls_robust_se(spark):
    rng = np.random.default_rng(11)
    n = 1500
    z = rng.normal(size=(n, 2))
    u = rng.normal(size=n)
    w = z @ np.array([1.0, 0.5]) + u + rng.normal(size=n)
    y = 2.0 * w + 3 * u + rng.normal(size=n) * (1 + np.abs(z[:, 0]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "w": w, "z1": z[:, 0], "z2": z[:, 1]}))
    r = k_class(df, "y", ["w"], [], ["z1", "z2"], robust=True).toPandas()
    Z = np.column_stack([np.ones(n), z])
    R = np.column_stack([np.ones(n), w])
    Q = np.linalg.inv(Z.T @ Z)
    A = np.linalg.inv(R.T @ Z @ Q @ Z.T @ R)
    b = A @ R.T @ Z @ Q @ Z.T @ y
    e = y - R @ b
    H = A @ R.T @ Z @ Q
    cov = H @ ((Z * (e ** 2)[:, None]).T @ Z) @ H.T
    got = r[r.method == "2sls_robust"].set_index("predictor")
    assert np.allclose([got.loc["const", "se"], got.loc["w", "se"]], np.sqrt(np.diag(cov)), rtol=1e-8)
