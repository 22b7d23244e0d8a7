"""Window operators W1-W25 on the dense panel."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import roles
from ..operators import windows as W
from ..operators.joins import event_window
from ..sources import views as V
from .registry import query

WU = "OVER (PARTITION BY unit ORDER BY day)"


def _panel(spark, d, *cols, instruments=False):
    # one shuffle on unit for the whole window block
    p = V.panel(spark, d, with_instruments=instruments).select("unit", "day", *cols)
    return p.repartition("unit")


@query("lags", views=("panel",), sql=f"""
SELECT unit, day, LAG(occ_protest, 2) {WU} AS "occ_protest_lag-2", LAG(occ_protest, 1) {WU} AS "occ_protest_lag-1",
  occ_protest AS occ_protest_lag0, LAG(media_online_protest, 2) {WU} AS "media_online_protest_lag-2",
  LAG(media_online_protest, 1) {WU} AS "media_online_protest_lag-1", LEAD(occ_protest, 1) {WU} AS occ_protest_lag1
FROM panel""")
def lags(spark, d):
    p = _panel(spark, d, "occ_protest", "media_online_protest")
    out = W.lag_block(p, ["occ_protest", "media_online_protest"], [-2, -1, 0, 1], keep=roles.design_lag)
    return out.drop("occ_protest", "media_online_protest", "media_online_protest_lag1")


@query("lead_target", views=("panel",), sql=f"""
SELECT unit, day, LEAD(media_online_protest, 7) {WU} AS y_lead7, LAG(media_online_protest, 3) {WU} AS y_placebo_m3 FROM panel""")
def lead_target(spark, d):
    p = _panel(spark, d, "media_online_protest")
    return p.select("unit", "day", W.lead_target("media_online_protest", 7).alias("y_lead7"),
                    W.lead_target("media_online_protest", -3).alias("y_placebo_m3"))


@query("cum_target", views=("panel",), sql="""
SELECT unit, day, CASE WHEN COUNT(media_print_protest) OVER f = 4 AND ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) > 3
  THEN SUM(media_print_protest) OVER f END AS y_cum3 FROM panel
WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""")
def cum_target(spark, d):
    p = _panel(spark, d, "media_print_protest")
    return p.select("unit", "day", W.cumulative_target("media_print_protest", 3).alias("y_cum3"))


DIFFS = [1, 7, 28, 91, 182, 364]


@query("diffs", views=("panel",), sql="SELECT unit, day, " + ", ".join(
    f"media_online_protest - LAG(media_online_protest, {k}) {WU} AS media_online_protest_diff{k}" for k in DIFFS) + " FROM panel")
def diffs(spark, d):
    p = _panel(spark, d, "media_online_protest")
    return p.select("unit", "day", *[W.diff("media_online_protest", k).alias(f"media_online_protest_diff{k}") for k in DIFFS])


SPANS = [7, 28, 112, 224]


def _ewm_sql(span):
    a = 2.0 / (span + 1)
    lq = math.log(1 - a)
    i = f"(ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) - 1)"
    return (f"ROUND(SUM(occ_protest * exp(-({i.replace('ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day)', 'rn')}) * {lq!r})) "
            f"OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
            f"* exp((rn - 1) * {lq!r}) / ((1 - exp(rn * {lq!r})) / {a!r}), 6) AS occ_protest_ewm{span}")


@query("ewm", views=("panel",), sql="SELECT unit, day, " + ", ".join(_ewm_sql(s) for s in SPANS) +
       " FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) AS rn FROM panel)")
def ewm(spark, d):
    p = _panel(spark, d, "occ_protest")
    for s in SPANS:
        p = W.ewm_mean(p, "occ_protest", s, f"occ_protest_ewm{s}")
    return p.select("unit", "day", *[F.round(f"occ_protest_ewm{s}", 6).alias(f"occ_protest_ewm{s}") for s in SPANS])


_GW = W.gaussian_weights(90, 30.0)


@query("deseason", views=("panelz",), sql=f"""
SELECT unit, day,
  ROUND(CASE WHEN COUNT(weather_tax) OVER f = 90 THEN list_dot_product(list(weather_tax) OVER f, {_GW!r}::DOUBLE[]) / {sum(_GW)!r} END, 6) AS weather_tax_seasonal,
  ROUND(weather_tax - CASE WHEN COUNT(weather_tax) OVER f = 90 THEN list_dot_product(list(weather_tax) OVER f, {_GW!r}::DOUBLE[]) / {sum(_GW)!r} END, 6) AS weather_tax_resid
FROM panelz WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING)""")
def deseason(spark, d):
    p = _panel(spark, d, "weather_tax", instruments=True)
    out = W.deseason(p, ["weather_tax"])
    return out.select("unit", "day", F.round("weather_tax_seasonal", 6).alias("weather_tax_seasonal"),
                      F.round("weather_tax_resid", 6).alias("weather_tax_resid"))


@query("rolling", views=("panel",), sql="""
SELECT unit, day, CASE WHEN COUNT(media_online_protest) OVER f = 7 THEN ROUND(AVG(media_online_protest) OVER f, 9) END AS y_roll7
FROM panel WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling(spark, d):
    p = _panel(spark, d, "media_online_protest")
    return p.select("unit", "day", F.round(W.rolling_mean("media_online_protest", 7), 9).alias("y_roll7"))


@query("centred_rolling", views=("panel",), sql="""
SELECT unit, day,
  CASE WHEN COUNT(media_online_protest) OVER c28 = 28 THEN ROUND(AVG(media_online_protest) OVER c28, 9) END AS y_c28,
  CASE WHEN COUNT(media_online_protest) OVER c7 = 7 THEN ROUND(AVG(media_online_protest) OVER c7 + STDDEV_SAMP(media_online_protest) OVER c7, 6) END AS band_hi7,
  CASE WHEN COUNT(media_online_protest) OVER c7 = 7 THEN ROUND(AVG(media_online_protest) OVER c7 - STDDEV_SAMP(media_online_protest) OVER c7, 6) END AS band_lo7
FROM panel WINDOW c28 AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING),
  c7 AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def centred_rolling(spark, d):
    p = _panel(spark, d, "media_online_protest")
    m7 = W.rolling_mean("media_online_protest", 7, centred=True)
    s7 = W.rolling_std("media_online_protest", 7, centred=True)
    return p.select("unit", "day", F.round(W.rolling_mean("media_online_protest", 28, centred=True), 9).alias("y_c28"),
                    F.round(m7 + s7, 6).alias("band_hi7"), F.round(m7 - s7, 6).alias("band_lo7"))


@query("instrument_shift", views=("panelz",), sql=f"""
SELECT unit, day, LAG(weather_discount, 3) {WU} AS weather_discount_shift3 FROM panelz""")
def instrument_shift(spark, d):
    p = _panel(spark, d, "weather_discount", instruments=True)
    return p.select("unit", "day", W.shift("weather_discount", 3).alias("weather_discount_shift3"))


_EW = """
, e AS (SELECT unit, day FROM panel WHERE occ_protest = 1),
 w AS (SELECT e.unit, e.day AS event_day, CAST(g.r AS INTEGER) AS rel_day, p.media_online_protest AS y
       FROM e, range(-7, 7) g(r), panel p WHERE p.unit = e.unit AND p.day = e.day + CAST(g.r AS INTEGER))"""


def _ew(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", "media_online_protest")
    win = event_window(p.where("occ_protest = 1").select("unit", "day"), p, 7, 7, cols=["media_online_protest"])
    return win.withColumnRenamed("media_online_protest", "y")


@query("cumulative_effect", views=("panel",), sql=_EW + """
SELECT unit, event_day, rel_day, ROUND(SUM(y - pre) OVER (PARTITION BY unit, event_day ORDER BY rel_day
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS cum_effect
FROM (SELECT *, AVG(CASE WHEN rel_day < 0 THEN y END) OVER (PARTITION BY unit, event_day) AS pre FROM w) WHERE rel_day >= 0""")
def cumulative_effect(spark, d):
    w = _ew(spark, d)
    w = w.withColumn("pre", F.avg(F.when(F.col("rel_day") < 0, F.col("y"))).over(Window.partitionBy("unit", "event_day")))
    w = w.where("rel_day >= 0").withColumn("eff", F.col("y") - F.col("pre"))
    return w.select("unit", "event_day", "rel_day",
                    (F.round(W.running_sum("eff", ["unit", "event_day"], "rel_day"), 6) + 0.0).alias("cum_effect"))


@query("prescale", views=("panel",), sql=_EW + """
SELECT unit, event_day, rel_day,
  ROUND(y - AVG(CASE WHEN rel_day < 0 THEN y END) OVER ev, 9) AS y_demean,
  y - MAX(CASE WHEN rel_day = -1 THEN y END) OVER ev AS y_demean_end,
  ROUND(asinh(y), 9) AS y_log,
  y - LAG(y) OVER (PARTITION BY unit, event_day ORDER BY rel_day) AS y_diff
FROM w WINDOW ev AS (PARTITION BY unit, event_day)""")
def prescale(spark, d):
    w = _ew(spark, d)
    ev = Window.partitionBy("unit", "event_day")
    return w.select("unit", "event_day", "rel_day",
                    F.round(F.col("y") - F.avg(F.when(F.col("rel_day") < 0, F.col("y"))).over(ev), 9).alias("y_demean"),
                    (F.col("y") - F.max(F.when(F.col("rel_day") == -1, F.col("y"))).over(ev)).alias("y_demean_end"),
                    F.round(F.asinh("y"), 9).alias("y_log"),
                    (F.col("y") - F.lag("y").over(ev.orderBy("rel_day"))).alias("y_diff"))


@query("zscore", views=("panel",), sql="""
SELECT unit, day,
  ROUND((media_online_protest - AVG(media_online_protest) OVER ()) / STDDEV_SAMP(media_online_protest) OVER (), 9) AS z_global,
  ROUND((media_online_protest - AVG(media_online_protest) OVER u) / STDDEV_POP(media_online_protest) OVER u, 9) AS z_unit_pop
FROM panel WINDOW u AS (PARTITION BY unit)""")
def zscore(spark, d):
    p = _panel(spark, d, "media_online_protest")
    # global moments: one aggregate, two scalars to the driver (no single-partition window)
    r = p.agg(F.avg("media_online_protest").alias("m"), F.stddev_samp("media_online_protest").alias("s")).first()
    return p.select("unit", "day",
                    F.round(F.try_divide(F.col("media_online_protest") - F.lit(r["m"]), F.lit(r["s"])), 9).alias("z_global"),
                    F.round(W.zscore("media_online_protest", ["unit"], sample=False), 9).alias("z_unit_pop"))


@query("minmax", views=("panel",), sql="""
SELECT unit, day, ROUND((media_print_goal - MIN(media_print_goal) OVER u) / NULLIF(MAX(media_print_goal) OVER u - MIN(media_print_goal) OVER u, 0), 9) AS mm
FROM panel WINDOW u AS (PARTITION BY unit)""")
def minmax(spark, d):
    p = _panel(spark, d, "media_print_goal")
    return p.select("unit", "day", F.round(W.minmax("media_print_goal", ["unit"]), 9).alias("mm"))


@query("group_share", views=("panel",), sql="""
SELECT unit, day, ROUND(media_online_protest / SUM(media_online_protest) OVER (PARTITION BY unit), 12) AS share_unit,
  ROUND(media_online_protest / NULLIF(MAX(media_online_protest) OVER (PARTITION BY day), 0), 9) AS ratio_day_max FROM panel""")
def group_share(spark, d):
    p = V.panel(spark, d).select("unit", "day", "media_online_protest")
    return p.select("unit", "day", F.round(W.share_of("media_online_protest", ["unit"]), 12).alias("share_unit"),
                    F.round(W.share_of("media_online_protest", ["day"], how="max"), 9).alias("ratio_day_max"))


@query("group_mean", views=("ev",), sql="""
SELECT event_id, ROUND(AVG(size) OVER g, 6) AS mean_size, ROUND(ln(AVG(size) OVER g), 9) AS log_mean_size
FROM ev WINDOW g AS (PARTITION BY area, location)""")
def group_mean(spark, d):
    from ..operators.aggregates import with_group_stats
    e = with_group_stats(V.ev(spark, d), ["area", "location"], {"_m": F.avg("size")})
    return e.select("event_id", F.round("_m", 6).alias("mean_size"), F.round(F.log("_m"), 9).alias("log_mean_size"))


@query("window_change", views=("panel",), sql="""
SELECT unit, day, CASE WHEN COUNT(media_online_protest) OVER f = 12 THEN ROUND(media_online_protest - AVG(media_online_protest) OVER f, 9) END AS change14
FROM panel WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING)""")
def window_change(spark, d):
    p = _panel(spark, d, "media_online_protest")
    return p.select("unit", "day", F.round(W.change_vs_preceding("media_online_protest", 14, 3), 9).alias("change14"))


@query("logdiff_roundtrip", views=("panel",), sql="""
WITH b AS (SELECT unit, day, media_online_protest AS x,
   ln(1 + media_online_protest) - LAG(ln(1 + media_online_protest)) OVER (PARTITION BY unit ORDER BY day) AS d,
   FIRST_VALUE(media_online_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0,
   LAST_VALUE(media_online_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xe
  FROM panel)
SELECT unit, day, ROUND(d, 6) AS d,
  ROUND(exp(ln(1 + x0) + SUM(COALESCE(d, 0)) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1, 6) AS x_from_start,
  ROUND(exp(ln(1 + xe) - COALESCE(SUM(d) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) - 1, 6) AS x_from_end
FROM b""".replace("WITH b AS", ", b AS"))
def logdiff_roundtrip(spark, d):
    p = _panel(spark, d, "media_online_protest")
    full = Window.partitionBy("unit").orderBy("day").rowsBetween(W.UNB, W.UNF)
    p = p.withColumns({"d": W.logdiff("media_online_protest"),
                       "x0": F.first("media_online_protest").over(full), "xe": F.last("media_online_protest").over(full)})
    return p.select("unit", "day", F.round("d", 6).alias("d"),
                    F.round(W.logdiff_inverse_from_start("d", "x0"), 6).alias("x_from_start"),
                    F.round(W.logdiff_inverse_from_end("d", "xe"), 6).alias("x_from_end"))


@query("relative_days", views=("ev",), sql="""
SELECT event_id, datediff('day', MIN(day) OVER (PARTITION BY unit), day) AS rel_day FROM ev""")
def relative_days(spark, d):
    from ..operators.aggregates import with_group_stats
    e = with_group_stats(V.ev(spark, d), ["unit"], {"_first": F.min("day")})
    return e.select("event_id", F.datediff("day", "_first").cast("long").alias("rel_day"))


@query("baseline_forecast", views=("panel",), sql=f"""
SELECT unit, day, ROUND(AVG(media_online_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS f_mean,
  LAG(media_online_protest, 1) {WU} AS f_naive, LAG(media_online_protest, 7) {WU} AS f_seasonal7 FROM panel""")
def baseline_forecast(spark, d):
    p = _panel(spark, d, "media_online_protest")
    return p.select("unit", "day", F.round(W.historic_mean("media_online_protest"), 9).alias("f_mean"),
                    W.shift("media_online_protest", 1).alias("f_naive"), W.shift("media_online_protest", 7).alias("f_seasonal7"))


@query("interpolate", views=("panel",), sql="""
WITH s AS (SELECT unit, day, CASE WHEN datediff('day', DATE '1995-01-01', day) % 7 = 0 THEN CAST(media_online_protest AS DOUBLE) END AS y,
                  datediff('day', DATE '1995-01-01', day) AS x FROM panel),
 b AS (SELECT *, LAST_VALUE(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER pw AS px, LAST_VALUE(y IGNORE NULLS) OVER pw AS py,
        FIRST_VALUE(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER nw AS nx, FIRST_VALUE(y IGNORE NULLS) OVER nw AS ny
       FROM s WINDOW pw AS (PARTITION BY unit ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     nw AS (PARTITION BY unit ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT unit, day, ROUND(CASE WHEN y IS NOT NULL THEN y WHEN nx = px THEN py ELSE py + (ny - py) * (x - px) / (nx - px) END, 9) AS y_interp FROM b""".replace(
    "WITH s AS", ", s AS"))
def interpolate(spark, d):
    p = _panel(spark, d, "media_online_protest")
    x = F.datediff("day", F.to_date(F.lit("1995-01-01")))
    p = p.withColumn("x", x).withColumn("y", F.when(F.col("x") % 7 == 0, F.col("media_online_protest").cast("double")))
    return p.select("unit", "day", F.round(W.interpolate_linear("y", "x", ["unit"]), 9).alias("y_interp"))


@query("weekday_counts", views=("ev",), sql="SELECT dayname(day) AS weekday, COUNT(*) AS n FROM ev GROUP BY 1")
def weekday_counts(spark, d):
    return V.ev(spark, d).groupBy(F.date_format("day", "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
