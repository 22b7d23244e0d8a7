"""Joins J1-J18 on the fixture views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources import views as V
from ..sources.tables import dim, table
from .registry import query


@query("full_outer_series", views=("treat", "media"), sql="""
SELECT unit, day, t.n_events, m.media_online_protest FROM treat t FULL OUTER JOIN media m USING (unit, day)""")
def full_outer_series(spark, d):
    t = V.treat(spark, d).select("unit", "day", "n_events")
    m = V.media_daily(spark, d).select("unit", "day", "media_online_protest")
    return J.align([t, m])


@query("outer_fill", views=("ev", "cnt"), sql="""
SELECT day, COALESCE(a.n_events, 0) AS n_events, COALESCE(b.n_lines, 0) AS n_lines FROM
 (SELECT day, COUNT(*) AS n_events FROM ev GROUP BY day) a FULL OUTER JOIN
 (SELECT day, CAST(SUM(n) AS BIGINT) AS n_lines FROM cnt GROUP BY day) b USING (day)""")
def outer_fill(spark, d):
    a = V.ev(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n_events"))
    b = V.cnt(spark, d).groupBy("day").agg(F.sum("n").alias("n_lines"))
    return J.align([a, b], keys=["day"], fill={"n_events": 0, "n_lines": 0})


@query("composite_join", views=("treat", "media"), sql="""
SELECT t.unit, t.day, t.n_events, m.media_print_goal FROM treat t JOIN media m ON t.unit = m.unit AND t.day = m.day""")
def composite_join(spark, d):
    t = V.treat(spark, d).select("unit", "day", "n_events")
    m = V.media_daily(spark, d).select("unit", "day", "media_print_goal")
    return t.join(m, on=["unit", "day"], how="inner")


@query("semi_sources", sql="""
SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def semi_sources(spark, d):
    return table(spark, d, "documents").select("doc_id", "source") \
        .join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("anti_units", views=("ev",), sql="""
SELECT n_name AS unit FROM nation WHERE n_name NOT IN (SELECT unit FROM ev WHERE year(day) = 1999 AND actor = 'P'
  AND location = 'AUTOMOBILE')""")
def anti_units(spark, d):
    e = V.ev(spark, d).where((F.year("day") == 1999) & (F.col("actor") == "P") & (F.col("location") == "AUTOMOBILE"))
    return V.units(spark, d).join(e.select("unit"), "unit", "left_anti")


@query("dim_lookup", views=("ev",), sql="""
SELECT e.event_id, r.r_name AS region_name, n.n_regionkey AS region_key
FROM ev e LEFT JOIN nation n ON e.unit = n.n_name LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def dim_lookup(spark, d):
    lk = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("unit"), F.col("r_name").alias("region_name"),
                F.col("n_regionkey").alias("region_key"))
    return V.ev(spark, d).select("event_id", "unit").join(F.broadcast(lk), "unit", "left").drop("unit")


@query("donor_pool", views=("panel",), sql="""
SELECT e.unit AS event_unit, e.day, p.unit AS donor FROM panel e JOIN panel p ON e.day = p.day
WHERE e.occ_protest = 1 AND p.occ_protest = 0 AND p.unit <> e.unit""")
def donor_pool(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest")
    return J.donor_pool(p.where("occ_protest = 1"), p)


@query("event_window", views=("panel",), sql="""
SELECT e.unit, e.day AS event_day, g.r AS rel_day, p.day AS win_day, p.media_online_protest
FROM panel e, range(-7, 7) g(r), panel p
WHERE e.occ_protest = 1 AND p.unit = e.unit AND p.day = e.day + CAST(g.r AS INTEGER)""")
def event_window(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", "media_online_protest")
    ev = p.where("occ_protest = 1").select("unit", "day")
    return J.event_window(ev, p, 7, 7, cols=["media_online_protest"])


CONTAM_SQL = """
, e AS (SELECT unit, day FROM panel WHERE occ_protest = 1)
SELECT m.mode, e.unit, e.day FROM e, (VALUES ('none'), ('F'), ('all')) m(mode)
WHERE m.mode = 'none' OR NOT EXISTS (
  SELECT 1 FROM panel q WHERE q.unit = e.unit AND q.day <> e.day AND q.day BETWEEN e.day - 3 AND e.day + 2
   AND ((m.mode = 'F' AND q.occ_F = 1) OR (m.mode = 'all' AND q.occ_protest = 1)))"""


@query("contamination", views=("panel",), sql=CONTAM_SQL)
def contamination(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", "occ_F")
    ev = p.where("occ_protest = 1").select("unit", "day")
    out = ev.withColumn("mode", F.lit("none"))
    for mode, ind in [("F", F.col("occ_F") == 1), ("all", F.col("occ_protest") == 1)]:
        out = out.unionByName(J.exclude_contaminated(ev, p, ind, 3, 2).withColumn("mode", F.lit(mode)))
    return out.select("mode", "unit", "day")


@query("offset_lookup", views=("panel",), sql="""
SELECT e.unit, e.day, g.k AS "offset", p.media_print_protest
FROM (SELECT unit, day FROM panel WHERE occ_protest = 1) e CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) g(k)
LEFT JOIN panel p ON p.unit = e.unit AND p.day = e.day + g.k""")
def offset_lookup(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest", "media_print_protest")
    return J.offset_lookup(p.where("occ_protest = 1"), p, [-2, -1, 0, 1, 2], "media_print_protest")


@query("param_grid", sql="""
SELECT n_name AS unit, s.step, l.lag FROM nation, range(0, 8) s(step), range(-6, 1) l(lag)""")
def param_grid(spark, d):
    # generator-based cartesian product of parameter lists: no join
    u = V.units(spark, d)
    g = u.select("unit", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step")) \
         .select("unit", "step", F.explode(F.sequence(F.lit(-6), F.lit(0))).alias("lag"))
    return g.select("unit", F.col("step").cast("long"), F.col("lag").cast("long"))


@query("climatology", views=("panel",), sql="""
SELECT unit, day, ROUND(AVG(media_online_protest) OVER (PARTITION BY unit, month(day), day(day)
  ORDER BY year(day) RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) AS clim FROM panel""")
def climatology(spark, d):
    p = V.panel(spark, d).select("unit", "day", "media_online_protest")
    return p.select("unit", "day", F.round(J.climatology(p, "media_online_protest"), 9).alias("clim"))


@query("theta_min", views=("cnt",), sql="""
WITH m AS (SELECT unit, date_trunc('month', day) AS mon, CAST(SUM(n) AS BIGINT) AS monthly FROM cnt
           WHERE medium = 'online' GROUP BY 1, 2),
 y AS (SELECT DISTINCT year(mon) AS start_year FROM m)
SELECT m.unit, y.start_year, MIN(m.monthly) AS min_monthly FROM m JOIN y ON year(m.mon) >= y.start_year
GROUP BY 1, 2""".replace("WITH m AS", ", m AS"))
def theta_min(spark, d):
    c = V.cnt(spark, d).where(F.col("medium") == "online")
    m = c.groupBy("unit", F.trunc("day", "month").alias("mon")).agg(F.sum("n").alias("monthly")) \
         .withColumn("year", F.year("mon"))
    return J.min_from_start_year(m, "monthly", "year", ["unit"])


@query("neighbour_exclude", views=("panel", "nbr"), sql="""
SELECT e.unit AS event_unit, e.day, p.unit AS donor FROM panel e JOIN panel p ON e.day = p.day
WHERE e.occ_protest = 1 AND p.occ_protest = 0 AND p.unit <> e.unit
  AND NOT EXISTS (SELECT 1 FROM nbr WHERE nbr.unit = e.unit AND nbr.neighbour = p.unit)""")
def neighbour_exclude(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest")
    pool = J.donor_pool(p.where("occ_protest = 1"), p)
    return J.exclude_neighbours(pool, V.nbr(spark, d))


@query("point_lookup", views=("ev", "instr"), sql="""
SELECT e.event_id, ROUND(i.weather_tax, 9) AS tax_day, ROUND(mm.tax_month, 9) AS tax_month
FROM ev e LEFT JOIN instr i ON e.unit = i.unit AND e.day = i.day
LEFT JOIN (SELECT unit, date_trunc('month', day) AS mon, AVG(weather_tax) AS tax_month FROM instr GROUP BY 1, 2) mm
  ON e.unit = mm.unit AND date_trunc('month', e.day) = mm.mon""")
def point_lookup(spark, d):
    i = V.instr(spark, d)
    mon = i.groupBy("unit", F.trunc("day", "month").alias("mon")).agg(F.avg("weather_tax").alias("tax_month"))
    e = V.ev(spark, d).select("event_id", "unit", "day", F.trunc("day", "month").alias("mon"))
    return (e.join(i.select("unit", "day", "weather_tax"), ["unit", "day"], "left")
             .join(mon, ["unit", "mon"], "left")
             .select("event_id", F.round("weather_tax", 9).alias("tax_day"), F.round("tax_month", 9).alias("tax_month")))


@query("substring_join", sql="""
SELECT page_id, region_name FROM (
  SELECT p.page_id, r.r_name AS region_name,
    ROW_NUMBER() OVER (PARTITION BY p.page_id ORDER BY r.r_regionkey NULLS LAST) AS rn
  FROM pages p LEFT JOIN region r ON strpos(upper(p.html), r.r_name) > 0) WHERE rn = 1""")
def substring_join(spark, d):
    pg = table(spark, d, "pages").select("page_id", F.upper("html").alias("h"))
    r = dim(spark, d, "region").select(F.col("r_name").alias("region_name"), "r_regionkey")
    return J.substring_lookup(pg, "page_id", "h", r, "region_name", "r_regionkey").select("page_id", "region_name")
