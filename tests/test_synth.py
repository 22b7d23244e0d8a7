"""Synthetic control properties on a small hand-made panel."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ripplekit.estimators import synth as SC


def _panel(spark, n_days=80, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2000-01-01", periods=n_days).date
    rows = []
    base = {u: rng.poisson(5, n_days).astype(float) for u in ["a", "b", "c", "d"]}
    # unit "t" is an exact non-negative combination of donors b and c plus 1
    base["t"] = 1.0 + 0.6 * base["b"] + 0.4 * base["c"]
    for u, ys in base.items():
        for i, d in enumerate(days):
            occ = 1 if (u == "t" and i in (40, 60)) else 0
            rows.append((u, d, occ, float(ys[i])))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "day", "occ_protest", "y"]))


def test_perfect_donor_combination_is_recovered(spark):
    p = _panel(spark)
    sc = SC.synthetic_control(p, ["y"], pre=14, post=7, start="2000-01-01").toPandas()
    assert set(sc["event_day"].astype(str)) == {"2000-02-10", "2000-03-01"}
    assert np.allclose(sc["y"], sc["y_synth"], atol=1e-6)
    assert (sc["n_donors"] == 4).all()


def test_scaled_donor_mean_and_grid(spark):
    p = _panel(spark)
    m = SC.scaled_donor_mean(p, "y", 14, 7, start="2000-01-01").toPandas()
    assert len(m) == 2 * 21 and (m["n_donors"] == 4).all()
    g = SC.sc_grid(p, "y", [7, 14], 7, scales=(None, "demean"), start="2000-01-01").toPandas()
    assert set(g["config"]) == {"pre=7|scale=none", "pre=14|scale=none", "pre=7|scale=demean", "pre=14|scale=demean"}
    assert (g["events"] == 2).all()


def test_ar_forecast_exact_on_ar_process(spark):
    from ripplekit.estimators.synth import _ar_path
    y = np.zeros(60)
    y[0] = 1.0
    for t in range(1, 60):
        y[t] = 2.0 + 0.5 * y[t - 1]
    f = _ar_path(y, 40, 1)
    assert np.allclose(f[1:], y[1:], atol=1e-8)


def test_ar_direct_and_exog():
    from ripplekit.estimators.synth import _ar_path
    rng = np.random.default_rng(9)
    x = rng.normal(size=80)
    y = np.zeros(80)
    for t in range(1, 80):
        y[t] = 1.0 + 0.4 * y[t - 1] + 2.0 * x[t]
    f = _ar_path(y, 60, 1, exog=x)
    assert np.allclose(f[1:], y[1:], atol=1e-8)
    d = _ar_path(y, 60, 1, exog=x, direct=True)
    assert np.isfinite(d[60:]).all()


def test_donor_sets(spark):
    p = _panel(spark).withColumns({"x_none": F.lit(False), "x_b": F.col("unit") == "b", "x_all": F.lit(True)})
    e = SC.donor_sets(p, "y", ["none", "b", "all"], 14, 7, scale=None, start="2000-01-01").toPandas()
    one = SC.synthetic_control(p.where("unit <> 'b'"), ["y"], 14, 7, start="2000-01-01").toPandas()
    assert set(e["mode"]) == {"none", "b"} and np.allclose(e[e["mode"] == "none"].effect, 0, atol=1e-6)
    got = e[e["mode"] == "b"].sort_values(["event_day", "rel_day"]).effect.to_numpy()
    want = one.sort_values(["event_day", "rel_day"])
    assert np.allclose(got, want.y - want.y_synth, atol=1e-9) and np.abs(got).max() > 0.1


def test_exclusion_flags(spark):
    from ripplekit.operators.joins import EXCLUSION_MODES, exclusion_flags
    acled = [0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    official = [0, 0, 0, 0, 0, 0, 0, None, 0, 0]
    days = pd.date_range("2000-01-01", periods=10).date
    df = spark.createDataFrame([("u", d, a, o, False) for d, a, o in zip(days, acled, official)], "unit string, day date, a int, o int, r boolean")
    got = exclusion_flags(df, "a", "o", 2, 1, F.col("r")).orderBy("day").collect()
    near = lambda hit: [any(0 <= i + k < 10 and hit[i + k] for k in (-2, -1, 1)) for i in range(10)]
    a, o = [x > 0 for x in acled], [x is None or x > 0 for x in official]
    want = {"none": [False] * 10, "acled": near(a), "official": near(o), "all": near([x or y for x, y in zip(a, o)]), "regions": [False] * 10}
    assert {m: [r[f"x_{m}"] for r in got] for m in EXCLUSION_MODES} == want
