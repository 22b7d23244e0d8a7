"""Minimum slice: events -> daily treatment, line counts -> daily outcome,
calendar spine, 7-day cumulative lead, and the first question
"does an event day precede more coverage?" (P1 P5 J6 A1 A3 T1 J1 W3 C2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import cumulative_target
from ..sources import views as V
from .registry import query


@query("daily_treatment", views=("treat",), sql="""
SELECT unit, day, occ_protest, occ_F, occ_O, occ_P, ROUND(size_F, 2) AS size_F, ROUND(size_O, 2) AS size_O,
  ROUND(size_P, 2) AS size_P, ROUND(size_protest, 2) AS size_protest, n_events, notes FROM treat""")
def daily_treatment(spark, d):
    t = V.treat(spark, d)
    return t.withColumns({c: F.round(c, 2) for c in ["size_F", "size_O", "size_P", "size_protest"]})


@query("counts_by_day", views=("media",), sql="SELECT * FROM media")
def counts_by_day(spark, d):
    return V.media_daily(spark, d)


@query("spine_fill", views=("panel",), sql="""
SELECT unit, day, occ_protest, occ_F, occ_O, occ_P, ROUND(size_protest, 2) AS size_protest, n_events,
  media_online_protest, media_online_goal, media_online_not_protest,
  media_print_protest, media_print_goal, media_print_not_protest FROM panel""")
def spine_fill(spark, d):
    p = V.panel(spark, d)
    return p.select("unit", "day", "occ_protest", "occ_F", "occ_O", "occ_P",
                    F.round("size_protest", 2).alias("size_protest"), "n_events", *V.MEDIA_COLS)


EVENT_LIFT_SQL = """
, y AS (
  SELECT unit, day, occ_protest,
    CASE WHEN COUNT(media_online_protest) OVER f = 8
          AND ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) > 7
         THEN SUM(media_online_protest) OVER f END AS y7
  FROM panel
  WINDOW f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT unit,
  SUM(occ_protest) AS event_days,
  SUM(CASE WHEN y7 IS NOT NULL THEN 1 ELSE 0 END) AS n_days,
  ROUND(AVG(CASE WHEN occ_protest = 1 THEN y7 END), 9) AS mean_event,
  ROUND(AVG(CASE WHEN occ_protest = 0 THEN y7 END), 9) AS mean_other,
  ROUND(AVG(CASE WHEN occ_protest = 1 THEN y7 END) - AVG(CASE WHEN occ_protest = 0 THEN y7 END), 9) AS lift
FROM y GROUP BY unit"""


def _event_lift(spark, d, step: int = 7):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", "media_online_protest")
    p = p.withColumn("y7", cumulative_target("media_online_protest", step))
    ev, ot = F.col("occ_protest") == 1, F.col("occ_protest") == 0
    me = F.avg(F.when(ev, F.col("y7")))
    mo = F.avg(F.when(ot, F.col("y7")))
    return p.groupBy("unit").agg(
        F.sum("occ_protest").cast("long").alias("event_days"),
        F.sum(F.when(F.col("y7").isNotNull(), 1).otherwise(0)).cast("long").alias("n_days"),
        F.round(me, 9).alias("mean_event"), F.round(mo, 9).alias("mean_other"),
        F.round(me - mo, 9).alias("lift"))


# The flagship: one shuffle for the daily aggregates, one for the unit windows.
query("event_lift", views=("panel",), sql=EVENT_LIFT_SQL)(_event_lift)
