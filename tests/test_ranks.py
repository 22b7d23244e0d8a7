"""Distributed ranks against NumPy: quantiles, AUC, precision-recall; hot groups, ties, nulls, one class."""
import numpy as np
import pandas as pd
import pytest

from ripplekit.operators import ranks as R


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    g = rng.choice(["a", "b", None], 3000, p=[0.9, 0.08, 0.02])
    v = np.round(rng.normal(size=3000), 1)
    t = (rng.random(3000) < 1 / (1 + np.exp(-v))).astype(int)
    t[g == "b"] = 1
    return pd.DataFrame({"g": g, "v": v, "t": t})


def groups(frame):
    return [(None if g != g else g, sub) for g, sub in frame.groupby("g", dropna=False)]


def test_quantiles(spark, frame):
    df = spark.createDataFrame([(*r,) for r in frame.astype(object).where(frame.notna(), None).values] + [("a", None, 0), ("z", 2.0, 0)],
                               "g string, v double, t int")
    got = {r.g: r for r in R.quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"a", "b", None, "z"} and got["z"].p10 == got["z"].p99 == 2.0
    for g, sub in groups(frame):
        assert [got[g].p10, got[g].p50, got[g].p99] == pytest.approx(np.quantile(sub.v, [0.1, 0.5, 0.99]))
    whole = R.quantiles(df, [], "v", {"m": 0.37}).first()
    assert whole.m == pytest.approx(np.quantile([*frame.v, 2.0], 0.37))
    assert R.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_auc_and_precision_recall(spark, frame):
    df = spark.createDataFrame([(*r,) for r in frame.astype(object).where(frame.notna(), None).values], "g string, v double, t int")
    auc = {r.g: r for r in R.auc(df, ["g"], "v", "t").collect()}
    ap = {r.g: r for r in R.average_precision(df, ["g"], "v", "t").collect()}
    curve = R.pr_curve(df, ["g"], "v", "t").toPandas()
    for g, sub in groups(frame):
        pos, neg = sub.v[sub.t == 1].to_numpy(), sub.v[sub.t == 0].to_numpy()
        if len(neg) == 0:
            assert auc[g].auc is None and ap[g].average_precision == pytest.approx(1)
            continue
        pairs = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
        assert auc[g].auc == pytest.approx(pairs) and auc[g].n == len(sub) and auc[g].n_positive == len(pos)
        total, before, best = 0.0, 0.0, (0, 0)
        for th in sorted(sub.v.unique(), reverse=True):
            tp, called = (pos >= th).sum(), (sub.v >= th).sum()
            total += (tp / len(pos) - before) * tp / called
            before = tp / len(pos)
            best = max(best, (2 * tp / (called + len(pos)), th))
            own = curve[((curve.g == g) if g else curve.g.isna()) & (curve.threshold == th)].iloc[0]
            assert (own.tp, own.fp, own.fn) == (tp, called - tp, len(pos) - tp)
        assert ap[g].average_precision == pytest.approx(total)
        assert (ap[g].best_f1, ap[g].best_threshold) == pytest.approx(best)
    one = R.auc(df, [], "v", "t").first()
    pos, neg = frame.v[frame.t == 1].to_numpy(), frame.v[frame.t == 0].to_numpy()
    assert one.auc == pytest.approx((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)


def test_no_single_task(spark, frame):
    df = spark.createDataFrame(frame[["v", "t"]])
    plan = R.with_before(R.value_counts(df, [], "v"), [], "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
