"""Rolling-origin back-tests, precision-recall curves and the best threshold from distributed ranks."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..estimators import synth as SC
from ..operators import joins as J
from ..operators import ranks as R
from ..operators import windows as W
from ..sources import views as V
from ..sources.tables import table
from .q_methods import source_panel
from .registry import query

_SCORED = """
, s AS (SELECT unit, year(day) AS origin, occ_protest AS t,
    AVG(occ_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS score,
    AVG(occ_protest) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 84 PRECEDING AND 1 PRECEDING) AS recent FROM panel),
 l AS (SELECT origin, 'historic' AS model, t, score FROM s WHERE score IS NOT NULL
       UNION ALL SELECT origin, 'window84', t, recent FROM s WHERE recent IS NOT NULL)"""
_RANKED = """,
 c AS (SELECT origin, model, score, COUNT(*) AS n, SUM(t) AS pos FROM l GROUP BY 1, 2, 3),
 r AS (SELECT *, SUM(n) OVER w - n AS n_before, SUM(pos) OVER w - pos AS pos_before, SUM(n) OVER g AS n_total, SUM(pos) OVER g AS pos_total
       FROM c WINDOW g AS (PARTITION BY origin, model), w AS (PARTITION BY origin, model ORDER BY score ROWS UNBOUNDED PRECEDING))"""


def one_day_ahead(spark, d):
    """Every unit-day with two forecasts that are made anew for it from the days before: the mean of all of them and of the
    last 84.  (origin = year, model, t, score)"""
    p = V.panel(spark, d).select("unit", "day", "occ_protest").repartition("unit")
    recent = F.avg("occ_protest").over(W._w("unit", "day").rowsBetween(-84, -1))
    p = p.select(F.year("day").alias("origin"), F.col("occ_protest").alias("t"), W.historic_mean("occ_protest").alias("historic"),
                 recent.alias("window84"))
    return p.unpivot(["origin", "t"], ["historic", "window84"], "model", "score").where(F.col("score").isNotNull())


@query("rolling_auc", views=("panel",), sql=_SCORED + _RANKED + """
SELECT origin, model, ROUND((SUM(pos * (n_before + (n + 1) / 2.0)) - SUM(pos) * (SUM(pos) + 1) / 2.0)
  / NULLIF(SUM(pos) * (SUM(n) - SUM(pos)), 0), 9) AS auc, SUM(n)::BIGINT AS n, SUM(pos)::BIGINT AS n_positive FROM r GROUP BY 1, 2""")
def rolling_auc(spark, d):
    """AUC of one-day-ahead forecasts by origin year and model."""
    return R.auc(one_day_ahead(spark, d), ["origin", "model"], "score", "t").withColumn("auc", F.round("auc", 9))


@query("best_f1", views=("panel",), sql=_SCORED + _RANKED + """,
 k AS (SELECT *, pos_total - pos_before AS tp, n_total - n_before AS called FROM r),
 f AS (SELECT origin, model, score, pos / NULLIF(pos_total, 0) * (tp / called) AS part, ROUND(2 * tp / (called + pos_total), 9) AS f1 FROM k)
SELECT origin, model, ROUND(SUM(part), 9) AS average_precision, MAX(f1) AS best_f1 FROM f GROUP BY 1, 2""")
def best_f1(spark, d):
    """Average precision and the best F1 over all thresholds, by origin year and model."""
    a = R.average_precision(one_day_ahead(spark, d), ["origin", "model"], "score", "t")
    return a.select("origin", "model", F.round("average_precision", 9).alias("average_precision"), F.round("best_f1", 9).alias("best_f1"))


@query("pr_curve", sql="""
WITH x AS (SELECT d.lang, l.quality AS t, d.n_chars AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
 c AS (SELECT lang, score, COUNT(*) AS n, SUM(t) AS pos FROM x GROUP BY 1, 2),
 r AS (SELECT *, SUM(n) OVER w - n AS n_before, SUM(pos) OVER w - pos AS pos_before, SUM(n) OVER g AS n_total, SUM(pos) OVER g AS pos_total
       FROM c WINDOW g AS (PARTITION BY lang), w AS (PARTITION BY lang ORDER BY score ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, pos_total - pos_before AS tp, n_total - n_before AS called FROM r)
SELECT lang, score AS threshold, tp::BIGINT AS tp, (called - tp)::BIGINT AS fp, pos_before::BIGINT AS fn, ROUND(tp / called, 9) AS precision,
  ROUND(tp / NULLIF(pos_total, 0), 9) AS recall, ROUND(2 * tp / (called + pos_total), 9) AS f1 FROM k""".replace("WITH x AS", ", x AS"))
def pr_curve(spark, d):
    """Precision and recall at every distinct score, by language (score: length, label: quality)."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    c = R.pr_curve(x, ["lang"], "n_chars", "quality").drop("step")
    return c.select("lang", "threshold", *[F.col(k).cast("long").alias(k) for k in ("tp", "fp", "fn")],
                    *[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


FREE_BEFORE, FREE_AFTER = 3, 2
NO_OFFICIAL = "ASIA"


def _exclusion_panel(spark, d):
    """The panel with each source's event counts and the five exclusion flags.  Stand-in: units of NO_OFFICIAL have no
    official register, their counts are null."""
    from ..sources.tables import dim
    p = V.panel(spark, d).select("unit", "day", "occ_protest", V.MEDIA_COLS[0])
    n = V.evall(spark, d).groupBy(F.col("region").alias("unit"), "day").agg(
        F.count(F.when(F.col("source") == "acled", 1)).alias("acled"), F.count(F.when(F.col("source") == "gpreg", 1)).alias("gpreg"))
    area = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("unit"), (F.col("r_name") == NO_OFFICIAL).alias("unregistered"))
    p = p.join(n, ["unit", "day"], "left").join(F.broadcast(area), "unit").withColumns({
        "acled": F.coalesce("acled", F.lit(0)), "official": F.when(~F.col("unregistered"), F.coalesce("gpreg", F.lit(0)))})
    return J.exclusion_flags(p.repartition("unit"), "acled", "official", FREE_BEFORE, FREE_AFTER, F.col("unregistered"))


@query("contamination_modes", views=("panel", "evall"), sql=f"""
, n AS (SELECT region AS unit, day, SUM(CASE WHEN source = 'acled' THEN 1 ELSE 0 END) AS acled, SUM(CASE WHEN source = 'gpreg' THEN 1 ELSE 0 END) AS gpreg
        FROM evall GROUP BY 1, 2),
 p AS (SELECT panel.unit, panel.day, occ_protest, coalesce(acled, 0) > 0 AS a, r_name = '{NO_OFFICIAL}' AS u,
         CASE WHEN r_name = '{NO_OFFICIAL}' THEN true ELSE coalesce(gpreg, 0) > 0 END AS o
       FROM panel JOIN nation ON n_name = panel.unit JOIN region ON n_regionkey = r_regionkey LEFT JOIN n ON n.unit = panel.unit AND n.day = panel.day),
 x AS (SELECT unit, day, occ_protest, u, coalesce(bool_or(a) OVER b, false) OR coalesce(bool_or(a) OVER f, false) AS xa,
         coalesce(bool_or(o) OVER b, false) OR coalesce(bool_or(o) OVER f, false) AS xo FROM p
       WINDOW b AS (PARTITION BY unit ORDER BY day ROWS BETWEEN {FREE_BEFORE} PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {FREE_AFTER} FOLLOWING))
SELECT m.mode, unit, day FROM x, (VALUES ('none'), ('acled'), ('official'), ('all'), ('regions')) m(mode) WHERE occ_protest = 1
  AND CASE mode WHEN 'none' THEN true WHEN 'acled' THEN NOT xa WHEN 'official' THEN NOT xo WHEN 'all' THEN NOT (xa OR xo) ELSE NOT u END""")
def contamination_modes(spark, d):
    """Event days that are free of other events under each of the five exclusion modes."""
    p = _exclusion_panel(spark, d).where("occ_protest = 1")
    long = p.select("unit", "day", *[F.col(f"x_{m}").alias(m) for m in J.EXCLUSION_MODES]).unpivot(
        ["unit", "day"], list(J.EXCLUSION_MODES), "mode", "excluded")
    return long.where(~F.col("excluded")).select("mode", "unit", "day")


@query("donor_set_bands")
def donor_set_bands(spark, d):
    """Median and quartiles of the cumulative impact by day, under each of the five donor sets."""
    e = SC.donor_sets(_exclusion_panel(spark, d), V.MEDIA_COLS[0], J.EXCLUSION_MODES, 28, 7, start=V.START)
    w = Window.partitionBy("mode", "unit", "event_day").orderBy("rel_day").rowsBetween(Window.unboundedPreceding, 0)
    c = e.where("rel_day >= 0").withColumn("impact", F.sum("effect").over(w))
    q = R.quantiles(c, ["mode", "rel_day"], "impact", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return q.join(c.groupBy("mode", "rel_day").agg(F.count(F.lit(1)).alias("events")), ["mode", "rel_day"])
