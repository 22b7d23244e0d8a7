"""The all-methods runner against the single-method estimators and a NumPy replay."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplekit.estimators import multi as M
from ripplekit.estimators import shrinkage as S
from ripplekit.estimators.iv import k_class
from ripplekit.estimators.linear import ols
from ripplekit.estimators.passes import array_sums
from ripplekit.estimators.propensity import aipw, cross_fitted_scores


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(12)
    n = 900
    x = rng.normal(size=(n, 3))
    z = rng.normal(size=(n, 2))
    w = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x[:, 0] - 0.5 * x[:, 1] + z[:, 0])))).astype(float)
    w2 = (rng.random(n) < 0.3).astype(float)
    y = 2.0 * w + x @ [1.0, 1.0, 0.0] + rng.normal(size=n)
    pdf = pd.DataFrame({"w": w, "w2": w2, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "z1": z[:, 0], "z2": z[:, 1], "ya": y,
                        "yb": y ** 2 - w2, "fold": rng.integers(0, 3, n).astype(np.int32), "h": rng.integers(-2 ** 62, 2 ** 62, n)})
    pdf.loc[:40, "ya"] = np.nan
    pdf.loc[860:, "yb"] = np.nan
    pdf.loc[pdf.index % 17 == 0, "z1"] = np.nan
    return pdf


PLAN = M.Plan({"w": ["w", "x1", "x2", "x3"], "w2": ["w", "w2", "x1"]}, {"ya": ("a", 1), "yb": ("b", 7)}, ["z1", "z2"], folds=3, replicates=60)


@pytest.fixture(scope="module")
def result(spark, frame):
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(4)
    return M.run_methods(df, PLAN).toPandas().set_index(["method", "estimand", "treatment", "target"])


def test_runner_equals_the_single_method_estimators(spark, frame, result):
    assert len(result) == 2 * 2 * (3 + 2 + 2) and result.settled.all()
    for t, xs in PLAN.designs.items():
        for y, (target, step) in PLAN.ys.items():
            df = spark.createDataFrame(frame[[*xs, y]].dropna())
            one = ols(df, y, xs).toPandas().set_index("predictor").loc[t]
            got = result.loc[("regression", "coef", t, target)]
            assert (got.coef, got.ci_lower, got.ci_upper, got.n, got.step) == pytest.approx(
                (one.coef, one.ci_lower, one.ci_upper, one.n, step), abs=1e-9)
            df = spark.createDataFrame(frame[[*xs, y, "z1", "z2"]].dropna())
            iv = k_class(df, y, [t], [x for x in xs if x != t], ["z1", "z2"]).toPandas()
            for m, name in (("2sls", "instrumental_variable"), ("liml", "instrumental_variable_liml")):
                one = iv[(iv.method == m) & (iv.predictor == t)].iloc[0]
                got = result.loc[(name, "coef", t, target)]
                assert (got.coef, got.ci_lower, got.ci_upper, got.n) == pytest.approx((one.coef, one.ci_lower, one.ci_upper, one.n), rel=1e-6)


def scores(pdf, t, xs):
    """Cross-fitted scores by plain Newton on the rows."""
    X = np.column_stack([np.ones(len(pdf)), pdf[[x for x in xs if x != t]]])
    e = np.zeros(len(pdf))
    for f in range(3):
        tr = (pdf.fold != f).to_numpy()
        b = np.zeros(X.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-X[tr] @ b))
            b -= np.linalg.solve((X[tr] * (p * (1 - p))[:, None]).T @ X[tr] + np.eye(len(b)), X[tr].T @ (p - pdf[t][tr]) + b)
        e[~tr] = 1 / (1 + np.exp(-X[~tr] @ b))
    return X, np.clip(e, 0.01, 0.99)


def replay_weights(h, b):
    """Poisson(1) draw of replicate b, in Python integers."""
    x = (int(h) + b * 0x9E3779B97F4A7C15) % 2 ** 64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2 ** 64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2 ** 64
    u, k, total = ((x ^ (x >> 31)) >> 11) / 2 ** 53, 0, math.exp(-1)
    while u >= total and k < 17:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k if u < total else 18


def test_weighting_equals_a_numpy_replay(frame, result):
    for t, xs in PLAN.designs.items():
        X, e = scores(frame, t, xs)
        w, whole = frame[t].to_numpy(), frame[["ya", "yb"]].notna().all(axis=1).to_numpy()
        for y, (target, _) in PLAN.ys.items():
            mu = np.zeros((2, len(frame)))
            for f in range(3):
                at = (frame.fold == f).to_numpy()
                for a in (0, 1):
                    tr = ~at & whole & (w == a)
                    G = np.column_stack([X[tr], frame[y][tr]])
                    mo = S.moments(G.T @ G, range(1, X.shape[1]), X.shape[1])
                    mu[a][at] = X[at] @ mo.with_intercept(S.lasso_ic(mo)[0])
            ok = frame[y].notna().to_numpy()
            D = np.array([[1.0] + [replay_weights(h, b) for b in range(1, 61)] for h in frame.h[ok]])
            yy, ww, ee, m0, m1 = frame[y].to_numpy()[ok], w[ok], e[ok], mu[0][ok], mu[1][ok]
            om = ee / (1 - ee) * (1 - ww)
            mean = lambda v, c: (D * (v * c)[:, None]).sum(0) / (D * c[:, None]).sum(0)
            psi = m1 - m0 + ww * (yy - m1) / ee - (1 - ww) * (yy - m0) / (1 - ee)
            want = {("propensity_weighting", "att"): mean(yy, ww) - mean(yy, om),
                    ("propensity_weighting", "ate"): mean(yy, ww / ee) - mean(yy, (1 - ww) / (1 - ee)),
                    ("doubly_robust", "ate"): mean(psi, np.ones(len(yy))),
                    ("doubly_robust", "att"): (D * ((ww - om) * (yy - m0))[:, None]).sum(0) / (D * ww[:, None]).sum(0)}
            for (m, est), v in want.items():
                got = result.loc[(m, est, t, target)]
                assert got.coef == pytest.approx(v[0], abs=1e-7) and got.n == ok.sum()
                assert (got.ci_lower, got.ci_upper) == pytest.approx(tuple(np.quantile(v[1:], [0.025, 0.975])), abs=1e-7)
    att = result.loc[("doubly_robust", "att", "w", "a")]
    assert att.ci_lower < 2.0 < att.ci_upper


def test_scores_and_doubly_robust_mean_of_the_single_method(spark, frame, result):
    df = spark.createDataFrame(frame[["w", "w2", "x1", "x2", "x3", "fold"]])
    fits = M.logistic_newton(df, PLAN.designs, 3)
    assert all(ok for _, ok in fits.values())
    _, e = scores(frame, "w", PLAN.designs["w"])
    got = cross_fitted_scores(df.withColumn("i", F.monotonically_increasing_id()), "w", ["x1", "x2", "x3"], "fold", 3)
    assert np.allclose(np.clip([r.propensity for r in got.orderBy("i").collect()], 0.01, 0.99), e, atol=1e-7)
    assert not any(ok for _, ok in M.logistic_newton(df, {"w": ["w", "x1", "x2"]}, 3, rounds=2).values())
    both = spark.createDataFrame(frame.dropna(subset=["ya", "yb"]).drop(columns=["z1", "z2"]))
    one = aipw(both, "ya", "w", ["x1", "x2", "x3"], "fold", 3).first()
    many = M.run_methods(both, M.Plan(PLAN.designs, PLAN.ys, folds=3, replicates=3), ("doubly_robust",)).toPandas()
    many = many[(many.treatment == "w") & (many.target == "a")].set_index("estimand").coef
    assert (one.ate, one.att) == pytest.approx((many["ate"], many["att"]), abs=1e-8)
    apart = spark.createDataFrame(pd.DataFrame({"w": [0.0, 0, 1, 1], "x1": [-50.0, -40, 40, 60], "fold": [0, 1, 0, 1]}))
    assert all(ok and np.isfinite(b).all() for b, ok in M.logistic_newton(apart, {"w": ["w", "x1"]}, 2).values())


def test_poisson_weights_are_poisson():
    w = M.poisson_weights(np.random.default_rng(0).integers(-2 ** 63, 2 ** 63, 4000), 50)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.05


def test_empty_and_constant_inputs(spark, frame):
    empty = spark.createDataFrame(frame).limit(0)
    assert M.run_methods(empty, PLAN).count() == 0 and array_sums(empty, lambda p: {}) == {}
