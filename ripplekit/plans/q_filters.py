"""Scans, projections and filters."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators.events import add_type_flags, events_of_source
from ..sources import views as V
from ..sources.tables import table
from .registry import query


@query("scan_filter_project", sql="""
SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year,
  strftime(o_orderdate, '%Y-%m') AS month_label, monthname(o_orderdate) AS month_name, o_totalprice AS size
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def scan_filter_project(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") &
                                         (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) &
                                         (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("event_id"), day.alias("day"), F.year(day).alias("year"),
                    F.date_format(day, "yyyy-MM").alias("month_label"),
                    F.date_format(day, "MMMM").alias("month_name"), F.col("o_totalprice").alias("size"))


@query("event_flags", views=("evall",), sql="""
SELECT event_id, type, type IN ('F', 'O') AS moderate, type = 'P' AS radical FROM evall""")
def event_flags(spark, d):
    return add_type_flags(V.evall(spark, d), ["F", "O"], ["P"]).select("event_id", "type", "moderate", "radical")


@query("source_select", views=("evall",), sql="""
SELECT 'acled' AS mode, event_id, ROUND(size_post, 9) AS size FROM evall WHERE source = 'acled'
UNION ALL SELECT 'gpreg', event_id, ROUND(size_pre, 9) FROM evall WHERE source = 'gpreg' AND region IS DISTINCT FROM 'NATION_3'
UNION ALL SELECT 'mean', event_id, ROUND(CASE WHEN size_post IS NULL THEN size_pre ELSE (size_pre + size_post) / 2 END, 9) FROM evall
UNION ALL SELECT 'difference', event_id, ROUND(size_pre, 9) FROM evall WHERE source = 'gpreg' AND size_pre > 0 AND size_post > 0
UNION ALL SELECT 'all', event_id, ROUND(size_pre, 9) FROM evall""")
def source_select(spark, d):
    e = V.evall(spark, d)
    parts = []
    for mode in ["acled", "gpreg", "mean", "difference", "all"]:
        s = events_of_source(e, mode, excluded_region="NATION_3")
        size = "size" if "size" in s.columns else "size_pre"
        parts.append(s.select(F.lit(mode).alias("mode"), "event_id", F.round(size, 9).alias("size")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("cancel_filter", views=("ev",), sql="""
SELECT event_id, unit FROM ev WHERE NOT (
  COALESCE(contains(notes, 'AUTO'), FALSE) OR COALESCE(contains(location, 'AUTO'), FALSE) OR COALESCE(contains(area, 'AUTO'), FALSE)
  OR COALESCE(contains(notes, 'EUROPE'), FALSE) OR COALESCE(contains(location, 'EUROPE'), FALSE) OR COALESCE(contains(area, 'EUROPE'), FALSE))""")
def cancel_filter(spark, d):
    e = V.ev(spark, d)
    return e.where(~P.any_cell_contains(["notes", "location", "area"], ["AUTO", "EUROPE"])).select("event_id", "unit")


@query("marker_filter", views=("evall",), sql="""
SELECT event_id, type FROM (SELECT event_id, type, CASE WHEN type = 'P' THEN 'x' WHEN type = 'O' THEN NULL ELSE 'y' END AS marker FROM evall)
WHERE marker IS DISTINCT FROM 'x'""")
def marker_filter(spark, d):
    e = V.evall(spark, d).withColumn(
        "marker", F.when(F.col("type") == "P", "x").when(F.col("type") == "O", F.lit(None)).otherwise("y"))
    return P.drop_marked(e.select("event_id", "type", "marker"), "marker")


BLOCKED = ["/fr/", "m.", "#top", "?page="]


@query("url_blocklist", sql="SELECT page_id, url FROM pages WHERE NOT (" +
       " OR ".join(f"contains(url, '{b}')" for b in BLOCKED) + ")")
def url_blocklist(spark, d):
    return table(spark, d, "pages").where(P.not_blocked("url", BLOCKED)).select("page_id", "url")


@query("outlier_trim", views=("ev",), sql="""
SELECT event_id, size FROM ev, (SELECT AVG(size) AS m, STDDEV_SAMP(size) AS s FROM ev) st
WHERE size BETWEEN m - s AND m + s""")
def outlier_trim(spark, d):
    return P.remove_outliers(V.ev(spark, d).select("event_id", "size"), "size", 1.0)


@query("clip", views=("ev",), sql="""
SELECT event_id, LEAST(GREATEST(size, 100000.0), 300000.0) AS size_clipped FROM ev""")
def clip(spark, d):
    return V.ev(spark, d).select("event_id", P.clip("size", 100000.0, 300000.0).alias("size_clipped"))


@query("positive_queries", views=("panel",), sql="""
SELECT unit, day, media_online_protest + media_online_not_protest AS media_online_all,
  media_print_protest + media_print_not_protest AS media_print_all, media_online_protest, media_print_protest,
  media_online_goal, media_print_goal FROM panel""")
def positive_queries(spark, d):
    p = V.panel(spark, d).select("unit", "day", *V.MEDIA_COLS)
    return P.total_counts(p, ("online", "print"))


@query("merge_media", views=("panel",), sql="""
SELECT unit, day,
  media_online_protest + media_online_not_protest + media_print_protest + media_print_not_protest AS media_combined_all,
  media_online_protest + media_print_protest AS media_combined_protest,
  media_online_goal + media_print_goal AS media_combined_goal,
  media_online_protest + media_online_not_protest AS media_online_all, media_online_protest, media_online_goal
FROM panel""")
def merge_media(spark, d):
    p = P.total_counts(V.panel(spark, d).select("unit", "day", *V.MEDIA_COLS), ("online", "print"))
    return P.merge_media(p, ("all", "protest", "goal"))


@query("cutover_union", views=("ev", "ev2"), sql="""
SELECT event_id, day, unit, size, 'old' AS source, NULL AS location FROM ev WHERE day < DATE '1998-01-01'
UNION ALL SELECT event_id, day, unit, NULL, 'new', location FROM ev2 WHERE day >= DATE '1998-01-01'""")
def cutover_union(spark, d):
    old = V.ev(spark, d).select("event_id", "day", "unit", "size", F.lit("old").alias("source"))
    new = V.ev(spark, d, "2-HIGH").select("event_id", "day", "unit", F.lit("new").alias("source"), "location")
    return P.cutover(old, new, "1998-01-01")


@query("dropna_rows", views=("evall",), sql="SELECT event_id, size_post FROM evall WHERE size_post IS NOT NULL")
def dropna_rows(spark, d):
    return V.evall(spark, d).select("event_id", "size_post").dropna(subset=["size_post"])


@query("substring_filter", sql="""
SELECT doc_id FROM documents WHERE contains(split_part(text, chr(10), 1), 'Le') OR contains(text, 'protest')""")
def substring_filter(spark, d):
    t = table(spark, d, "documents")
    title = F.substring_index("text", "\n", 1)
    return t.where(title.contains("Le") | F.col("text").contains("protest")).select("doc_id")
