"""Estimators (C1-C43): linear/IV via the Gram pattern, propensity and
weighting, synthetic control, MLlib text and tree models."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import roles
from ..estimators import iv as IV
from ..estimators import linear as LN
from ..estimators import propensity as PS
from ..estimators import synth as SC
from ..functions.dates import WEEKDAYS, holiday_flag, weekday_name
from ..operators import ranks as R
from ..operators import windows as W
from ..operators.aggregates import effect_summary as _effect_summary
from ..operators.reshape import one_hot_drop_first
from ..operators.sampling import bootstrap_within, hash_fold
from ..sources import views as V
from ..sources.tables import dim, table
from .registry import query

LAGS = list(range(-6, 1))
Y = "media_online_protest"


def design(spark, d, targets=(Y,), steps=(7,), cumulative=True, instruments=False, lags=LAGS):
    """Panel -> lagged design matrix keeping (unit, day).  Only columns that
    survive the role rules are computed.  One shuffle on unit for all windows."""
    p = V.panel(spark, d, with_instruments=instruments)
    area = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("unit"), F.col("r_name").alias("area"))
    p = p.join(F.broadcast(area), "unit").repartition("unit")
    p = p.withColumn("wd", weekday_name("day"))
    p = p.select("*", *one_hot_drop_first("wd", WEEKDAYS, "weekday"), holiday_flag("day", "area").alias("holiday"))
    lagged = ["occ_protest", *targets]
    p = W.lag_block(p, lagged, lags, keep=roles.design_lag)
    ys = {}
    for t in targets:
        for s in steps:
            ys[f"y__{t}__{s}"] = W.cumulative_target(t, s) if cumulative else W.lead_target(t, s)
    p = p.withColumns(ys)
    xs = [c for c in p.columns if "_lag" in c] + [f"weekday_{w}" for w in sorted(WEEKDAYS)[1:]] + ["holiday"]
    return p, xs, list(ys)


def _regressions(p, xs, ys):
    """The runner's regression rows for all (target, step) responses: two passes over one held design, no row copied."""
    from ..estimators import multi as M
    named = {y: (y.split("__")[1], int(y.split("__")[2])) for y in ys}
    d = p.select(*[F.col(c).cast("double").alias(c) for c in [*xs, *ys]]).dropna(subset=xs).persist()
    r = M.run_methods(d, M.Plan({"occ_protest_lag0": xs}, named), ("regression",))
    d.unpersist()
    return r.withColumnRenamed("treatment", "predictor").drop("estimand", "settled")


@query("ols_hc3")
def ols_hc3(spark, d):
    p, xs, ys = design(spark, d)
    return LN.ols(p, ys[0], xs)


@query("ols_no_controls")
def ols_no_controls(spark, d):
    p, xs, ys = design(spark, d)
    return LN.ols(p, ys[0], [c for c in xs if c.startswith("occ_")])


@query("effects_all_methods")
def effects_all_methods(spark, d):
    """Least squares with HC3 errors for all targets × steps (every method: ``methods_grid``)."""
    return _regressions(*design(spark, d, targets=("media_online_protest", "media_print_protest"), steps=(0, 1, 7)))


@query("placebo_outcome")
def placebo_outcome(spark, d):
    """Outcome before the event (negative steps) — expected effect ≈ 0."""
    return _regressions(*design(spark, d, steps=(-7, -3, -1), cumulative=False))


@query("placebo_treatment")
def placebo_treatment(spark, d):
    """Treatment resampled within unit (seeded), then the same regression."""
    p = V.panel(spark, d).select("unit", "day", "occ_protest", Y)
    p = bootstrap_within(p, "unit", "day", ["occ_protest"], seed=17).repartition("unit")
    p = p.withColumns({"occ_protest_lag0": F.col("occ_protest"), "y": W.cumulative_target(Y, 7),
                       "media_lag1": W.shift(Y, 1)})
    return LN.ols(p, "y", ["occ_protest_lag0", "media_lag1"])


# C5 -------------------------------------------------------------------------
PVAL_SQL = """
, y AS (SELECT unit, day, occ_protest,
    CASE WHEN COUNT(media_online_protest) OVER f = 8 AND ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) > 7
         THEN SUM(media_online_protest) OVER f END AS y7 FROM panel
    WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
 m AS (SELECT unit, AVG(CASE WHEN occ_protest = 1 THEN y7 END) AS me FROM y GROUP BY unit),
 pv AS (SELECT y.unit, AVG(CASE WHEN y.y7 >= m.me THEN 1.0 ELSE 0.0 END) AS p FROM y JOIN m ON y.unit = m.unit
        WHERE y.occ_protest = 0 AND y.y7 IS NOT NULL GROUP BY y.unit),
 r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS rk, COUNT(*) OVER () AS m FROM pv),
 r2 AS (SELECT *, p * m / rk AS raw_bh, p * m / rk * SUM(1.0 / rk) OVER () AS raw_by FROM r)
SELECT unit, ROUND(p, 9) AS p,
  ROUND(LEAST(1.0, MIN(raw_bh) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_bh,
  ROUND(LEAST(1.0, MIN(raw_by) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS p_by FROM r2"""


@query("bh_by", views=("panel",), sql=PVAL_SQL)
def bh_by(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", Y).repartition("unit")
    p = p.withColumn("y7", W.cumulative_target(Y, 7))
    me = F.avg(F.when(F.col("occ_protest") == 1, F.col("y7"))).over(Window.partitionBy("unit"))
    p = p.withColumn("me", me)
    pv = p.where((F.col("occ_protest") == 0) & F.col("y7").isNotNull()).groupBy("unit").agg(
        F.avg(F.when(F.col("y7") >= F.col("me"), 1.0).otherwise(0.0)).alias("p"))
    # the p-value table has one row per unit: the rank window runs on that small table
    a = LN.bh_by(pv, "p", method="bh")
    b = LN.bh_by(pv, "p", method="by").select("unit", "p_by")
    return a.join(b, "unit").select("unit", F.round("p", 9).alias("p"), F.round("p_bh", 9).alias("p_bh"),
                                    F.round("p_by", 9).alias("p_by"))


# C6-C10 ---------------------------------------------------------------------
@query("first_stage")
def first_stage(spark, d):
    p, xs, ys = design(spark, d, instruments=True, lags=[-1, 0])
    conf = [c for c in xs if not c.startswith("occ_")]
    r = LN.ols(p, "occ_protest_lag0", conf + V.INSTR_COLS, cov="nonrobust")
    r = LN.bh_by(r.where(F.col("predictor") != "const"), "p", method="bh")
    r = LN.bh_by(r, "p", method="by")
    f = IV.first_stage_f(p, "occ_protest_lag0", V.INSTR_COLS).withColumnRenamed("instrument", "predictor") \
        .withColumnRenamed("n", "n_pairs")
    return r.join(f, "predictor", "inner").select("predictor", "coef", "p", "p_bh", "p_by", "f", F.col("n").alias("n_obs"))


@query("wald_binary", views=("panelz",), sql="""
SELECT AVG(CASE WHEN z = 1 THEN y END) AS y1, AVG(CASE WHEN z = 0 THEN y END) AS y0,
  AVG(CASE WHEN z = 1 THEN w END) AS w1, AVG(CASE WHEN z = 0 THEN w END) AS w0, COUNT(*) AS n,
  (AVG(CASE WHEN z = 1 THEN y END) - AVG(CASE WHEN z = 0 THEN y END)) / NULLIF(AVG(CASE WHEN z = 1 THEN w END) - AVG(CASE WHEN z = 0 THEN w END), 0) AS wald
FROM (SELECT CAST(media_online_protest AS DOUBLE) AS y, CAST(occ_protest AS DOUBLE) AS w, CAST(weather_discount > 0.05005 AS INTEGER) AS z
      FROM panelz WHERE weather_discount IS NOT NULL)""")
def wald_binary(spark, d):
    p = V.panel(spark, d, with_instruments=True).where(F.col("weather_discount").isNotNull())
    p = p.withColumns({"yy": F.col(Y).cast("double"), "ww": F.col("occ_protest").cast("double")})
    r = IV.wald_binary(p, "yy", "ww", F.col("weather_discount") > 0.05005)
    return r.select(*[F.round(c, 9).alias(c) if c != "n" else F.col(c) for c in r.columns])


@query("iv_kclass")
def iv_kclass(spark, d):
    p, xs, ys = design(spark, d, instruments=True, lags=[-1, 0])
    exog = [c for c in xs if not c.startswith("occ_")]
    return IV.k_class(p, ys[0], ["occ_protest_lag0"], exog, V.INSTR_COLS, robust=True)


@query("instrument_pca")
def instrument_pca(spark, d):
    """C11: PCA of population-standardised instruments: covariance by one
    aggregate, eigh on the driver, sign fixed (largest |loading| positive)."""
    import numpy as np
    from ..estimators.gram import collect_gram
    p = V.panel(spark, d, with_instruments=True).select(*V.INSTR_COLS).dropna()
    st = p.agg(*[F.avg(c).alias(f"m_{c}") for c in V.INSTR_COLS], *[F.stddev_pop(c).alias(f"s_{c}") for c in V.INSTR_COLS]).first()
    z = p.select(*[((F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"]).alias(c) for c in V.INSTR_COLS])
    (n, _, G), = collect_gram(z, V.INSTR_COLS).values()
    vals, vecs = np.linalg.eigh(G / n)
    order = np.argsort(vals)[::-1]
    rows = []
    for r, i in enumerate(order):
        v = vecs[:, i]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        for c, l in zip(V.INSTR_COLS, v):
            rows.append((f"pc_{r}", c, float(l), float(vals[i])))
    return spark.createDataFrame(rows, "component string, instrument string, loading double, variance double")


# C12-C15, C42 ---------------------------------------------------------------
def _ps_frame(spark, d):
    """Design for the cross-fitted models, written once to the shared
    checkpoint folder: every fold fit and scoring pass reads the table instead
    of recomputing the window block."""
    from ..session import materialize
    p, xs, ys = design(spark, d, lags=list(range(-7, 1)))
    feats = [c for c in xs if c != "occ_protest_lag0"]
    p = p.withColumn("label", F.col("occ_protest_lag0").cast("double")) \
         .withColumn("fold", hash_fold(F.col("day").cast("string"), 5, 1))
    p = materialize(p.select("unit", "day", "label", "fold", *feats, *ys), "ps_design")
    return p, feats, ys


@query("propensity")
def propensity(spark, d):
    p, feats, ys = _ps_frame(spark, d)
    s = PS.cross_fitted_scores(p.select("unit", "day", "label", "fold", *feats).dropna(), "label", feats, "fold", 5)
    return s.select("unit", "day", "fold", "label", "propensity")


@query("ipw_att", views=("panel",), sql="""
, b AS (SELECT unit, day, occ_protest AS w,
    CASE WHEN COUNT(media_online_protest) OVER f = 8 AND ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) > 7
         THEN SUM(media_online_protest) OVER f END AS y,
    LEAST(GREATEST(AVG(occ_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.01), 0.99) AS e
   FROM panel WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
 c AS (SELECT * FROM b WHERE y IS NOT NULL AND e IS NOT NULL)
SELECT ROUND(AVG(CASE WHEN w = 1 THEN y END), 9) AS treated_mean,
  ROUND(SUM((1 - w) * e / (1 - e) * y) / SUM((1 - w) * e / (1 - e)), 9) AS control_mean,
  CAST(SUM(w) AS BIGINT) AS n_treated, CAST(SUM(1 - w) AS BIGINT) AS n_control,
  ROUND(AVG(CASE WHEN w = 1 THEN y END) - SUM((1 - w) * e / (1 - e) * y) / SUM((1 - w) * e / (1 - e)), 9) AS att FROM c""")
def ipw_att(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", Y).repartition("unit")
    p = p.withColumns({"y": W.cumulative_target(Y, 7), "e": W.historic_mean("occ_protest")})
    p = p.where(F.col("y").isNotNull() & F.col("e").isNotNull())
    r = PS.ipw_att(p, "y", "occ_protest", "e", clip=0.01)
    return r.select(*[F.round(c, 9).alias(c) if c in ("treated_mean", "control_mean", "att") else F.col(c)
                      for c in r.columns])


@query("aipw")
def aipw(spark, d):
    p, feats, ys = _ps_frame(spark, d)
    p = p.select("label", "fold", ys[0], *feats).dropna().withColumn("yy", F.col(ys[0]).cast("double"))
    return PS.aipw(p, "yy", "label", feats, "fold", 5)


@query("class_weights", views=("panel",), sql="""
SELECT unit, ROUND(COUNT(*) / NULLIF(2.0 * (COUNT(*) - SUM(occ_protest)), 0), 9) AS w0, ROUND(COUNT(*) / NULLIF(2.0 * SUM(occ_protest), 0), 9) AS w1
FROM panel GROUP BY unit""")
def class_weights(spark, d):
    r = V.panel(spark, d).groupBy("unit").agg(*PS.class_weights(F.col("occ_protest")))
    return r.select("unit", F.round("w0", 9).alias("w0"), F.round("w1", 9).alias("w1"))


@query("simple_line", views=("evall",), sql="""
SELECT source, ROUND(regr_slope(ln(size_post), ln(size_pre)), 9) AS slope, ROUND(regr_intercept(ln(size_post), ln(size_pre)), 9) AS intercept,
  COUNT(*) AS n FROM evall WHERE size_post > 0 AND size_pre > 0 GROUP BY source""")
def simple_line(spark, d):
    e = V.evall(spark, d).where((F.col("size_post") > 0) & (F.col("size_pre") > 0))
    return e.groupBy("source").agg(F.round(F.regr_slope(F.log("size_post"), F.log("size_pre")), 9).alias("slope"),
                                   F.round(F.regr_intercept(F.log("size_post"), F.log("size_pre")), 9).alias("intercept"),
                                   F.count(F.lit(1)).alias("n"))


# C40 ------------------------------------------------------------------------
def _k2_exprs(n, g1, g2):
    """D'Agostino-Pearson K² from n, population skewness g1 and excess kurtosis g2."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    ya = y / alpha
    z1 = delta * F.log(ya + F.sqrt(ya * ya + 1))
    b2 = g2 + 3
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9 * a)
    den = 1 + x * F.sqrt(2 / (a - 4))
    term2 = F.signum(den) * F.pow((1 - 2 / a) / F.abs(den), F.lit(1.0 / 3))
    z2 = (term1 - term2) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return z1, z2, k2, F.exp(-k2 / 2)


def _k2_sql(n, g1, g2):
    y = f"({g1} * sqrt(({n} + 1) * ({n} + 3) / (6.0 * ({n} - 2))))"
    beta2 = f"(3.0 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1 + sqrt(2 * ({beta2} - 1)))"
    delta = f"(1 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2 / ({w2} - 1))"
    ya = f"({y} / {alpha})"
    z1 = f"({delta} * ln({ya} + sqrt({ya} * {ya} + 1)))"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    varb2 = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    x = f"(({g2} + 3 - {e}) / sqrt({varb2}))"
    sb1 = f"(6.0 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))"
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1 + 4.0 / ({sb1} * {sb1}))))"
    den = f"(1 + {x} * sqrt(2 / ({a} - 4)))"
    term2 = f"(sign({den}) * pow((1 - 2 / {a}) / abs({den}), 1.0 / 3))"
    z2 = f"((1 - 2 / (9 * {a}) - {term2}) / sqrt(2 / (9 * {a})))"
    return z1, z2


_Z1, _Z2 = _k2_sql("n", "g1", "g2")
NORMALITY_SQL = f"""
, x AS (SELECT unit, media_online_protest - LAG(media_online_protest) OVER (PARTITION BY unit ORDER BY day) AS x FROM panel),
 m AS (SELECT unit, COUNT(x) AS n, AVG(x) AS mu FROM x GROUP BY unit),
 c AS (SELECT x.unit, m.n, AVG(pow(x.x - m.mu, 2)) AS m2, AVG(pow(x.x - m.mu, 3)) AS m3, AVG(pow(x.x - m.mu, 4)) AS m4
       FROM x JOIN m ON x.unit = m.unit WHERE x.x IS NOT NULL GROUP BY x.unit, m.n),
 g AS (SELECT unit, CAST(n AS DOUBLE) AS n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM c),
 z AS (SELECT unit, n, g1, g2, {_Z1} AS z1, {_Z2} AS z2 FROM g)
SELECT unit, n, ROUND(g1, 6) AS g1, ROUND(g2, 6) AS g2, ROUND(z1, 6) AS z_skew, ROUND(z2, 6) AS z_kurt,
  ROUND(z1 * z1 + z2 * z2, 6) AS k2, ROUND(exp(-(z1 * z1 + z2 * z2) / 2), 9) AS p FROM z"""


@query("normality", views=("panel",), sql=NORMALITY_SQL)
def normality(spark, d):
    """K² normality test of the differenced series per unit; moments by
    one aggregate, the test statistic as column arithmetic (χ²₂ tail = e^(-K²/2))."""
    p = V.panel(spark, d).select("unit", "day", Y).repartition("unit").withColumn("x", W.diff(Y, 1))
    m = p.groupBy("unit").agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"),
                              F.kurtosis("x").alias("g2"))
    z1, z2, k2, pv = _k2_exprs(F.col("n"), F.col("g1"), F.col("g2"))
    return m.select("unit", "n", F.round("g1", 6).alias("g1"), F.round("g2", 6).alias("g2"),
                    F.round(z1, 6).alias("z_skew"), F.round(z2, 6).alias("z_kurt"), F.round(k2, 6).alias("k2"),
                    F.round(pv, 9).alias("p"))


@query("baseline_auc", views=("panel",), sql="""
, s AS (SELECT occ_protest AS t, AVG(occ_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS score
        FROM panel),
 c AS (SELECT t, score FROM s WHERE score IS NOT NULL),
 r AS (SELECT t, (MIN(rk) OVER (PARTITION BY score) + MAX(rk) OVER (PARTITION BY score)) / 2.0 AS ar
       FROM (SELECT t, score, ROW_NUMBER() OVER (ORDER BY score) AS rk FROM c))
SELECT ROUND((SUM(CASE WHEN t = 1 THEN ar END) - SUM(t) * (SUM(t) + 1) / 2.0) / (SUM(t) * SUM(1 - t)), 9) AS auc, COUNT(*) AS n FROM r""")
def baseline_auc(spark, d):
    """AUC of the historic-mean forecast by the rank-sum formula with tie-averaged, distributed ranks."""
    p = V.panel(spark, d).select("unit", "day", "occ_protest").repartition("unit")
    a = R.auc(p.withColumn("score", W.historic_mean("occ_protest")), [], "score", "occ_protest")
    return a.select(F.round("auc", 9).alias("auc"), "n")


# C16-C23 --------------------------------------------------------------------
SC_PRE, SC_POST = 28, 7


@query("synthetic_control")
def synthetic_control(spark, d):
    p = V.panel(spark, d)
    return SC.synthetic_control(p, [Y], SC_PRE, SC_POST, start=V.START)


@query("sc_simplex")
def sc_simplex(spark, d):
    p = V.panel(spark, d)
    return SC.synthetic_control(p, [Y], SC_PRE, SC_POST, start=V.START, method="simplex", scale="demean")


@query("sc_effect_table")
def sc_effect_table(spark, d):
    p = V.panel(spark, d)
    sc = SC.synthetic_control(p, [Y, "media_print_protest"], SC_PRE, SC_POST, start=V.START, scale="demean")
    e = SC.effect_table(sc, cumulative=True)
    s = _effect_summary(e, ["outcome", "rel_day"], "effect")
    return s.withColumn("method", F.lit("synthetic_control"))


@query("scaled_donor_mean", views=("panel",), sql="""
, evs AS (SELECT unit AS ev_unit, day AS event_day FROM panel WHERE occ_protest = 1 AND day - 28 >= DATE '1995-01-01'),
 mem AS (SELECT evs.ev_unit, evs.event_day, p.unit AS series FROM evs JOIN panel p ON p.day = evs.event_day AND p.occ_protest = 0 AND p.unit <> evs.ev_unit
         UNION ALL SELECT ev_unit, event_day, ev_unit FROM evs),
 lg AS (SELECT m.ev_unit, m.event_day, m.series, CAST(g.r AS INTEGER) AS rel_day, p.media_online_protest AS value
        FROM mem m, range(-28, 7) g(r), panel p WHERE p.unit = m.series AND p.day = m.event_day + CAST(g.r AS INTEGER)),
 pd AS (SELECT ev_unit AS unit, event_day, rel_day, MAX(CASE WHEN series = ev_unit THEN value END) AS y,
          AVG(CASE WHEN series <> ev_unit THEN value END) AS donor_mean,
          SUM(CASE WHEN series <> ev_unit THEN 1 ELSE 0 END) AS n_donors FROM lg GROUP BY 1, 2, 3)
SELECT unit, event_day, rel_day, y, ROUND(donor_mean, 9) AS donor_mean, n_donors,
  ROUND(donor_mean * AVG(CASE WHEN rel_day < 0 THEN y END) OVER e / NULLIF(AVG(CASE WHEN rel_day < 0 THEN donor_mean END) OVER e, 0), 9) AS y_synth
FROM pd WHERE n_donors > 0 WINDOW e AS (PARTITION BY unit, event_day)""")
def scaled_donor_mean(spark, d):
    r = SC.scaled_donor_mean(V.panel(spark, d), Y, SC_PRE, SC_POST, start=V.START)
    return r.select("unit", "event_day", F.col("rel_day").cast("int").alias("rel_day"), "y",
                    F.round("donor_mean", 9).alias("donor_mean"), F.col("n_donors").cast("bigint").alias("n_donors"),
                    F.round("y_synth", 9).alias("y_synth"))


@query("donor_pool_size", views=("panel", "nbr"), sql="""
SELECT e.unit, e.day, COUNT(p.unit) AS n_donors,
  COUNT(CASE WHEN NOT EXISTS (SELECT 1 FROM nbr WHERE nbr.unit = e.unit AND nbr.neighbour = p.unit) THEN 1 END) AS n_non_neighbours
FROM panel e JOIN panel p ON e.day = p.day AND p.occ_protest = 0 AND p.unit <> e.unit WHERE e.occ_protest = 1 GROUP BY 1, 2""")
def donor_pool_size(spark, d):
    from ..operators.joins import donor_pool, exclude_neighbours
    p = V.panel(spark, d).select("unit", "day", "occ_protest")
    pool = donor_pool(p.where("occ_protest = 1"), p)
    nn = exclude_neighbours(pool, V.nbr(spark, d)).withColumn("_nn", F.lit(1))
    j = pool.join(nn, ["event_unit", "day", "donor"], "left")
    return j.groupBy(F.col("event_unit").alias("unit"), "day").agg(
        F.count(F.lit(1)).alias("n_donors"), F.count("_nn").alias("n_non_neighbours"))


# C22 / C31 / C45 -----------------------------------------------------------
@query("pre_period_grid")
def pre_period_grid(spark, d):
    return SC.sc_grid(V.panel(spark, d), Y, [7, 14, 28], SC_POST, scales=(None, "demean"), start=V.START)


# C30 ------------------------------------------------------------------------
@query("cv_grid")
def cv_grid(spark, d):
    """Ridge / OLS over 5 folds from ONE grouped Gram: train Gram = total −
    fold Gram; held-out SSE, bias and R² from the fold Gram itself."""
    import math

    import numpy as np
    from ..estimators.gram import collect_gram, ridge_from_gram
    p, xs, ys = design(spark, d)
    p = p.select(*xs, ys[0], "day").dropna().withColumn("const", F.lit(1.0)) \
         .withColumn("fold", hash_fold(F.col("day").cast("string"), 5, 2))
    X = ["const"] + xs
    G = collect_gram(p, X + [ys[0]], ["fold"])
    k = len(X)
    total = sum(m for _, _, m in G.values())
    rows = []
    for alpha in (0.0, 1.0, 10.0, 100.0):
        for (f,), (n, _, mf) in sorted(G.items()):
            beta = ridge_from_gram(total - mf, alpha)
            sse = mf[k, k] - 2 * beta @ mf[:k, k] + beta @ mf[:k, :k] @ beta
            sy, sx = mf[0, k], mf[0, :k]
            sst = mf[k, k] - sy * sy / n
            rows.append((float(alpha), int(f), int(n), math.sqrt(max(sse, 0) / n), float(1 - sse / sst),
                         float((sy - beta @ sx) / n)))
    r = spark.createDataFrame(rows, "alpha double, fold int, n int, rmse double, r2 double, bias double")
    return r.groupBy("alpha").agg(F.avg("rmse").alias("rmse"), F.stddev_pop("rmse").alias("rmse_sd"),
                                  F.avg("r2").alias("r2"), F.avg("bias").alias("bias"),
                                  F.stddev_pop("bias").alias("bias_sd"))


# C3 / C4 / C39 --------------------------------------------------------------
@query("size_gap_wls")
def size_gap_wls(spark, d):
    """Log-ratio of the two size estimates on asinh instruments, weighted."""
    e = V.evall(spark, d).where((F.col("size_post") > 0) & (F.col("size_pre") > 0))
    z = V.instr(spark, d).withColumnRenamed("unit", "region")
    e = e.join(z, ["region", "day"], "left").withColumns({
        "gap": F.log10("size_post") - F.log10("size_pre"), "w": F.log10("size_pre"),
        "z_tax": F.asinh("weather_tax"), "z_disc": F.asinh("weather_discount")})
    return LN.ols(e, "gap", ["z_tax", "z_disc"], weight="w")


@query("ols_placebo_sweep")
def ols_placebo_sweep(spark, d):
    """C4: outcome at day+k on the day's treatment for k = -31..30, one grouped
    Gram for all offsets (offset rows generated by explode, equi-join on day+k)."""
    from ..operators.joins import offset_lookup
    p = V.panel(spark, d).select("unit", "day", "occ_protest", Y)
    o = offset_lookup(p.select("unit", "day"), p, list(range(-31, 31)), Y)
    j = o.join(p.select("unit", "day", "occ_protest"), ["unit", "day"]) \
         .withColumn("yk", F.col(Y).cast("double")).withColumn("occ", F.col("occ_protest").cast("double"))
    r = LN.ols(j, "yk", ["occ"], group=["offset"])
    return r.where(F.col("predictor") == "occ")


@query("shift_timeline")
def shift_timeline(spark, d):
    """Size on standardised instrument at day+s, s = -14..14 (grouped)."""
    from ..operators.joins import offset_lookup
    t = V.treat(spark, d).select("unit", "day", F.asinh("size_protest").alias("y"))
    z = V.instr(spark, d)
    st = z.agg(F.avg("weather_tax").alias("m"), F.stddev_samp("weather_tax").alias("s")).first()
    zs = z.select("unit", "day", ((F.col("weather_tax") - st["m"]) / st["s"]).alias("z"))
    o = offset_lookup(t, zs, list(range(-14, 15)), "z").join(t, ["unit", "day"])
    r = LN.ols(o, "y", ["z"], group=["offset"])
    return r.where(F.col("predictor") == "z")


# C32-C38 --------------------------------------------------------------------
def _labelled_docs(spark, d):
    from ..estimators import ml as _ml  # noqa: F401
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return docs.join(lab, "doc_id").withColumn("fold", hash_fold(F.col("doc_id"), 5, 4))


@query("text_classifier")
def text_classifier(spark, d):
    from ..estimators import ml as M
    return M.cv_classifier(_labelled_docs(spark, d), "text", "label", "fold", 5, "logistic", n=2)


@query("complement_nb")
def complement_nb(spark, d):
    from ..estimators import ml as M
    return M.cv_classifier(_labelled_docs(spark, d), "text", "label", "fold", 5, "complement_nb")


@query("relevance_search")
def relevance_search(spark, d):
    """Model search over text classifiers, macro F1 per model (leave-one-
    fold-out); trees on the same TF-IDF features."""
    from ..estimators import ml as M
    docs = _labelled_docs(spark, d)
    r = M.cv_classifiers(docs, "text", "label", "fold", 5, ("logistic", "complement_nb", "random_forest"))
    return r.groupBy("model").agg(F.avg("macro_f1").alias("macro_f1"), F.avg("f1").alias("f1"),
                                  F.stddev_pop("f1").alias("f1_sd"))


@query("topic_clusters")
def topic_clusters(spark, d):
    from ..estimators import ml as M
    return M.topic_clusters(table(spark, d, "documents").select("doc_id", "text"), "text", k=5, n=2)


@query("doc_vectors")
def doc_vectors(spark, d):
    from ..estimators import ml as M
    e = table(spark, d, "embeddings").withColumn("fold", hash_fold(F.col("vec_id"), 5, 6)) \
        .withColumn("label", (F.col("label") >= 5).cast("double"))   # binary target for the PR curve
    return M.vector_classifier(e, "embedding", "label", "fold", 5)


@query("rf_search")
def rf_search(spark, d):
    from ..estimators import ml as M
    p, xs, ys = design(spark, d, instruments=True, lags=[-2, -1, 0])
    feats = [c for c in xs if c != "occ_protest_lag0"] + V.INSTR_COLS
    n_days = F.datediff(F.to_date(F.lit(V.END)), F.to_date(F.lit(V.START))) + 1
    p = p.withColumn("label", F.col("occ_protest_lag0").cast("double")) \
         .withColumn("tfold", F.floor(F.datediff("day", F.to_date(F.lit(V.START))) * 5 / n_days).cast("int"))
    from ..session import materialize
    p = materialize(p.select("label", "tfold", *feats).fillna(0.0), "rf_design")
    return M.rf_time_folds(p, "label", feats, "tfold", 5)


@query("impute")
def impute(spark, d):
    from ..estimators import ml as M
    p = V.panel(spark, d, with_instruments=True).select("unit", "day", *V.INSTR_COLS)
    out = M.chained_impute(p, V.INSTR_COLS, rounds=1)
    return out.select("unit", "day", *V.INSTR_COLS)
