"""Block components, partial regressions and the paired gain test against NumPy."""
import math

import numpy as np
import pandas as pd
import pytest

from ripplekit.estimators import blocks as B


def test_sweep_is_the_inverse():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(50, 4))
    A = X.T @ X
    S = A
    for k in range(3):
        S = B.sweep(S, k)
    assert np.allclose(-S[:3, :3], np.linalg.inv(A[:3, :3]))
    assert np.allclose(S[:3, 3], np.linalg.solve(A[:3, :3], A[:3, 3]))
    assert S[3, 3] == pytest.approx(A[3, 3] - A[3, :3] @ np.linalg.solve(A[:3, :3], A[:3, 3]))


def test_timeline_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "flat"]).assign(flat=1.0)
    pdf["y"] = pdf.a - 0.5 * pdf.b + rng.normal(size=200) + 4
    pdf.loc[:30, "a"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(3)
    models = {("day", 1): {"x": "b"}, ("day", 2): {"one": "a", "two": "b"}, ("day", 3): {"x": "flat"}, ("day", 4): {"x": "b", "again": "b"}}
    rows = B.timeline(df, "y", models)
    assert [r[:3] for r in rows] == [("day", 1, "x"), ("day", 2, "one"), ("day", 2, "two")]
    for key, cols in list(models.items())[:2]:
        d = pdf[[*cols.values(), "y"]].dropna()
        Z = ((d - d.mean()) / d.std(ddof=0)).to_numpy()
        X, y, n, k = Z[:, :-1], Z[:, -1], len(d), len(cols)
        b = np.linalg.lstsq(X, y, rcond=None)[0]
        rss = np.sum((y - X @ b) ** 2)
        se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss / (n - k - 1))
        for i, r in enumerate(r for r in rows if r[:2] == key):
            assert r[3:5] == pytest.approx((b[i], se[i])) and r[6] == pytest.approx(1 - rss / n) and r[7] == n
            assert 0 <= r[5] <= 1 and (r[5] < 0.05) == (abs(b[i] / se[i]) > 1.98)


def test_block_components(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) * [1, 10, 0.1, 5] + 7
    pdf = pd.DataFrame(X, columns=list("abcd")).assign(e=2.0)
    got, scored = B.block_components(spark.createDataFrame(pdf).repartition(3), {"p": ["a", "b", "c"], "q": ["b", "d", "e"]})
    s = scored.toPandas()
    for block, cols in (("p", ["a", "b", "c"]), ("q", ["b", "d", "e"])):
        vector, value, _, _ = got[block]
        names = [f"pc_{block}_{i}" for i in range(3)]
        C = np.cov(s[names].T, ddof=0)
        assert np.abs(C - np.diag(np.diag(C))).max() < 1e-9 and np.allclose(np.diag(C), value, atol=1e-9)
        assert (vector[np.abs(vector).argmax(axis=0), range(3)] > 0).all() and (np.diff(value) <= 1e-12).all()
        Z = (s[cols] - s[cols].mean()) / s[cols].std(ddof=0).replace(0, 1)
        assert np.allclose(Z.to_numpy() @ vector, s[names], atol=1e-8)
    assert got["q"][1].sum() == pytest.approx(2) and np.allclose(got["q"][0][2, :2], 0)
    assert B.block_components(scored.limit(0), {"p": ["a", "b"]})[0] == {}


def test_paired_gain(spark):
    t, p, n = B.paired_t([0.1, 0.3, 0.2, None, 0.4])
    assert (t, n) == (pytest.approx(0.25 / (math.sqrt(0.05 / 3) / 2)), 4) and p == pytest.approx(0.01515, abs=1e-4)
    assert math.isnan(B.paired_t([0.1])[0]) and math.isnan(B.paired_t([0.1, 0.1])[1]) and B.paired_t([-1, -2, -1.5])[1] > 0.95
    rng = np.random.default_rng(5)
    n = 600
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(2.2 - x - 2 * z))).astype(int)
    pdf = pd.DataFrame({"x": x, "z": z, "y": y, "fold": np.arange(n) // 100})
    sets = {"one": ["x"], "two": ["x", "z"]}
    got = B.logistic_fold_f1(spark.createDataFrame(pdf).repartition(3), "y", sets, 6)
    for s, cols in sets.items():
        for f in range(1, 6):
            tr, te = pdf[pdf.fold < f], pdf[pdf.fold == f]
            X = np.column_stack([np.ones(len(tr)), tr[cols]])
            w = np.where(tr.y == 1, len(tr) / (2 * tr.y.sum()), len(tr) / (2 * (1 - tr.y).sum()))
            b = np.zeros(X.shape[1])
            for _ in range(40):
                q = 1 / (1 + np.exp(-X @ b))
                b -= np.linalg.solve((X * (w * q * (1 - q))[:, None]).T @ X + np.eye(len(b)), X.T @ (w * (q - tr.y)) + b)
            called = np.column_stack([np.ones(len(te)), te[cols]]) @ b >= 0
            tp = (called & (te.y == 1)).sum()
            assert got[s][f - 1] == pytest.approx(2 * tp / (called.sum() + te.y.sum()))
    assert B.paired_t([b - a for a, b in zip(got["one"], got["two"])])[1] < 0.05
    assert B.logistic_fold_f1(spark.createDataFrame(pdf.assign(y=0)), "y", sets, 6) == {"one": [], "two": []}
