"""Lasso path, Bayesian ridge and the tuning grid against closed forms and plain NumPy on the rows."""
import numpy as np
import pandas as pd
import pytest

from ripplekit.estimators import shrinkage as S
from ripplekit.plans import q_tuning as Q


def gram_of(X, y):
    M = np.column_stack([np.ones(len(y)), X, y])
    return S.moments(M.T @ M, range(1, X.shape[1] + 1), X.shape[1] + 1)


@pytest.fixture
def data():
    rng = np.random.default_rng(8)
    X = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 3
    beta = np.r_[2.0, -1.5, np.zeros(8), 0.7, 0.0]
    return X, X @ beta + rng.normal(size=300) + 5


def test_lasso_path_meets_the_optimality_conditions(data):
    X, y = data
    mo = gram_of(X, y)
    path = S.lasso_path(mo)
    Xc, yc = X - X.mean(0), y - y.mean()
    assert path[0][0] == pytest.approx(np.abs(Xc.T @ yc).max()) and path[-1][0] == pytest.approx(0, abs=1e-5)
    assert all(a[0] >= b[0] for a, b in zip(path, path[1:])) and len(path) >= 12
    for penalty, b in path:
        g = Xc.T @ (yc - Xc @ b)
        on = b != 0
        assert np.allclose(g[on], penalty * np.sign(b[on]), atol=1e-5 * path[0][0])
        assert (np.abs(g[~on]) <= penalty + 1e-6 * path[0][0]).all()
    assert np.allclose(path[-1][1], np.linalg.lstsq(Xc, yc, rcond=None)[0], atol=1e-6)


def test_lasso_of_an_orthogonal_design_is_soft_thresholding():
    rng = np.random.default_rng(1)
    Q0, _ = np.linalg.qr(rng.normal(size=(60, 8)) - 0)
    Q0 -= Q0.mean(0)
    Q0, _ = np.linalg.qr(Q0)
    y = Q0 @ np.array([5.0, -4, 3, 2, 1, 0.5, 0, 0]) + 1
    for penalty, b in S.lasso_path(gram_of(Q0, y)):
        c = Q0.T @ (y - y.mean())
        assert np.allclose(b, np.sign(c) * np.maximum(np.abs(c) - penalty, 0), atol=1e-8)


def test_lasso_with_dependent_columns(data):
    X, y = data
    X = np.column_stack([X, X[:, 0] - X[:, 1], np.ones(len(y)), X[:, 2]])
    mo = gram_of(X, y)
    b, _ = S.lasso_ic(mo)
    whole, _ = S.lasso_ic(gram_of(X[:, :12], y))
    assert np.isfinite(b).all() and mo.rss(b) < 1.1 * gram_of(X[:, :12], y).rss(whole)
    assert mo.rss(S.lasso_path(mo)[-1][1]) == pytest.approx(gram_of(X[:, :12], y).rss(S.least_squares(gram_of(X[:, :12], y))), rel=1e-5)


def test_information_criterion_picks_the_smallest(data):
    X, y = data
    mo = gram_of(X, y)
    Xc, yc = X - X.mean(0), y - y.mean()
    s2 = np.sum((yc - Xc @ np.linalg.lstsq(Xc, yc, rcond=None)[0]) ** 2) / (300 - 12 - 1)
    aic = [np.sum((yc - Xc @ b) ** 2) / s2 + 2 * np.sum(b != 0) for _, b in S.lasso_path(mo)]
    b, _ = S.lasso_ic(mo)
    assert np.sum((yc - Xc @ b) ** 2) / s2 + 2 * np.sum(b != 0) == pytest.approx(min(aic))
    sparse, _ = S.lasso_ic(mo, "bic")
    assert np.count_nonzero(sparse) <= np.count_nonzero(b)


def test_bayesian_ridge_is_a_fixed_point_of_the_evidence(data):
    X, y = data
    mo = gram_of(X, y)
    b, ratio, settled = S.bayesian_ridge(mo, tol=1e-12)
    Xc, yc = X - X.mean(0), y - y.mean()
    assert settled and np.allclose(b, np.linalg.solve(Xc.T @ Xc + ratio * np.eye(12), Xc.T @ yc), atol=1e-8)
    g = np.sum(np.linalg.eigvalsh(Xc.T @ Xc) / (np.linalg.eigvalsh(Xc.T @ Xc) + ratio))
    rss = np.sum((yc - Xc @ b) ** 2)
    assert ratio == pytest.approx((g / (b @ b)) * rss / (300 - g), rel=1e-4)
    assert not S.bayesian_ridge(mo, rounds=1)[2]


def test_tuning_grid_equals_numpy_on_the_rows(spark):
    rng = np.random.default_rng(4)
    n, Y = 600, Q.Y
    names = ["occ_protest_lag0", "occ_protest_lag-1", "occ_protest_lag-2", f"{Y}_lag-1", f"{Y}_lag-2", f"{Y}_diff_lag-1",
             f"{Y}_ewm_lag-1", "holiday"]
    X = rng.normal(size=(n, len(names)))
    X[:, 5] = X[:, 3] - X[:, 4]
    y = X @ rng.normal(size=len(names)) + rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=names).assign(y=y, const=1.0, fold=rng.integers(0, 3, n))
    got = Q.tuning_grid(spark.createDataFrame(pdf).repartition(3), names, lags=(1, 2), features=((), ("diff", "ewm")), folds=3).toPandas()
    assert len(got) == 3 * 2 * 2 * 3
    assert Q.design_columns(names, 1, ()) == [names[0], names[1], names[3], "holiday"]
    assert Q.design_columns(names, 2, ("diff", "ewm")) == names
    for r in got.itertuples():
        use = Q.design_columns(names, r.lags, r.features.split("+") if r.features else ())
        tr, te = pdf[pdf.fold != r.fold], pdf[pdf.fold == r.fold]
        mo = gram_of(tr[use].to_numpy(), tr.y.to_numpy())
        b = mo.with_intercept(Q.METHODS[r.method](mo)[0])
        e = b[0] + te[use].to_numpy() @ b[1:] - te.y.to_numpy()
        assert r.n == len(te)
        assert (r.rmse, r.mae, r.bias) == pytest.approx((np.sqrt(np.mean(e ** 2)), np.mean(np.abs(e)), np.mean(e)), abs=1e-6)
        assert r.r2 == pytest.approx(1 - np.sum(e ** 2) / np.sum((te.y - te.y.mean()) ** 2), abs=1e-6)
        if r.method == "ols":
            A = np.column_stack([np.ones(len(tr)), tr[use]])
            assert np.allclose(np.linalg.lstsq(A, tr.y, rcond=None)[0][0] , b[0], atol=1e-6)
    assert Q.tuning_grid(spark.createDataFrame(pdf).limit(0), names).count() == 0
