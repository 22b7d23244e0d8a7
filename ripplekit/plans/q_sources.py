"""File sources and sinks (S1-S17): each plan writes a derived table with a
sink into the shared checkpoint folder and reads it back with the matching
reader, so the reader's result can be checked against the source table."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources import files as S
from ..sources import views as V
from ..sources.tables import dim, table
from .registry import query


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "sinks", f"{name}-{uuid.uuid4().hex[:8]}")


EV_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("day", T.DateType()),
                          T.StructField("unit", T.StringType()), T.StructField("actor", T.StringType()),
                          T.StructField("size", T.DoubleType())])


@query("csv_roundtrip", views=("ev",), sql="""
SELECT event_id, day, unit, size FROM ev WHERE day >= DATE '1998-01-01' AND day < DATE '1999-01-01' AND actor <> 'P'""")
def csv_roundtrip(spark, d):
    path = _scratch(spark, "ev_csv")
    S.write_csv(V.ev(spark, d).select("event_id", "day", "unit", "actor", "size"), path, sep=";")
    r = S.read_csv(spark, path, EV_SCHEMA, sep=";")
    return r.where((F.col("day") >= F.to_date(F.lit("1998-01-01"))) & (F.col("day") < F.to_date(F.lit("1999-01-01")))
                   & (F.col("actor") != "P")).select("event_id", "day", "unit", "size")


@query("jsonl_roundtrip", sql="SELECT doc_id, source, n_chars, lang, length(text) AS text_len FROM documents")
def jsonl_roundtrip(spark, d):
    path = _scratch(spark, "docs_jsonl")
    docs = table(spark, d, "documents").select("text", F.struct("doc_id", "source", "n_chars").alias("meta"), "lang")
    S.write_jsonl(docs, path, partition_by=["lang"])
    r = S.read_json(spark, path, S.DOC_META)
    return r.select("meta.*", "lang", F.length("text").alias("text_len"))


CNT_SCHEMA = T.StructType([T.StructField("unit", T.StringType()), T.StructField("day", T.DateType()),
                           T.StructField("n", T.LongType())])


@query("partitioned_scan", views=("cnt",), sql="""
SELECT c.unit, c.day, c.medium, c.dim, c.n FROM cnt c JOIN nation n ON c.unit = n.n_name
  JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE'""")
def partitioned_scan(spark, d):
    path = _scratch(spark, "counts")
    S.write_csv(V.cnt(spark, d), path, partition_by=["medium", "dim"])
    r = S.scan_with_path_keys(spark, os.path.join(path, "*", "*", "*.csv"), CNT_SCHEMA,
                              {"medium": r"/medium=([^/]+)/", "dim": r"/dim=([^/]+)/"})
    meta = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .where(F.col("r_name") == "EUROPE").select(F.col("n_name").alias("unit"))
    return r.join(meta, "unit", "left_semi").select("unit", "day", "medium", "dim", "n")


@query("service_counts", views=("spine", "cnt"), sql="""
SELECT s.unit, s.day, CAST(COALESCE(SUM(c.n), 0) AS BIGINT) AS count FROM spine s
LEFT JOIN cnt c ON s.unit = c.unit AND s.day = c.day AND c.medium = 'online' AND c.dim = 'protest' GROUP BY 1, 2""")
def service_counts(spark, d):
    c = V.cnt(spark, d).where((F.col("medium") == "online") & (F.col("dim") == "protest"))
    # one payload per (unit, year) — bounded by the calendar, like a paged service response
    payload = c.groupBy("unit", F.year("day").alias("y")).agg(F.to_json(F.struct(F.collect_list(F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("n").alias("count"))).alias("counts"))).alias("json"))
    daily = S.service_counts(payload, "json", keys=["unit"])
    from ..operators.spine import fill_on_spine
    return fill_on_spine(V.spine(spark, d), daily, fill={"count": 0}).select("unit", "day", "count")


@query("wire_fields", views=("ev",), sql="""
, w AS (SELECT event_id, CASE WHEN actor = 'P' THEN 'Job Number ' || CAST(event_id AS VARCHAR) ELSE
   notes || chr(10) || strftime(day, '%Y-%m-%d') || chr(10) || location || ' (agency) - ' || area || ' report' || chr(10) || 'Body ' || unit END AS txt FROM ev)
SELECT event_id, split_part(txt, chr(10), 1) AS title, TRY_CAST(split_part(txt, chr(10), 2) AS DATE) AS date,
  trim(regexp_extract(split_part(txt, chr(10), 3), '^([^(\\-]+)', 1)) AS location,
  trim(regexp_extract(split_part(txt, chr(10), 3), '-\\s*(.*)$', 1)) AS summary,
  split_part(txt, chr(10), 4) AS text FROM w WHERE NOT starts_with(txt, 'Job Number')""")
def wire_fields(spark, d):
    e = V.ev(spark, d)
    txt = F.when(F.col("actor") == "P", F.concat(F.lit("Job Number "), F.col("event_id").cast("string"))).otherwise(
        F.concat_ws("\n", "notes", F.date_format("day", "yyyy-MM-dd"),
                    F.concat(F.col("location"), F.lit(" (agency) - "), F.col("area"), F.lit(" report")),
                    F.concat(F.lit("Body "), F.col("unit"))))
    parsed = e.select("event_id", S.wire_fields(txt).alias("w"))
    return parsed.where(F.col("w").isNotNull()).select("event_id", "w.*")


@query("story_rows", views=("evlog",), sql="""
SELECT DISTINCT event_id AS stories_id, 'u' || CAST(user_id AS VARCHAR) AS url, event_type AS title,
  strftime(ts, '%Y-%m-%d') AS publish_date FROM evlog WHERE event_type <> 'error'""")
def story_rows(spark, d):
    e = V.evlog(spark, d)
    item = F.struct(F.col("event_id").alias("stories_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
                    F.col("event_type").alias("title"),
                    F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd")).alias("publish_date"))
    # one page per user and hour (a paged listing, bounded per page)
    pages = e.groupBy("user_id", "day", F.hour("ts").alias("h")).agg(F.to_json(F.collect_list(item)).alias("page"))
    return S.story_rows(pages, "page")


@query("metrics_reload", views=("panel",), sql=__import__("ripplekit.plans.q_core", fromlist=["x"]).EVENT_LIFT_SQL)
def metrics_reload(spark, d):
    from .q_core import _event_lift
    path = os.path.join(ensure_checkpoint_dir(spark), "metrics", "event_lift_" + os.path.basename(d.rstrip("/")))
    return S.stored_or_compute(spark, path, lambda: _event_lift(spark, d))
