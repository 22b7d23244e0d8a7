"""Reshaping, set operations, sorting, sampling, folds."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import NATIONAL_HOLIDAYS, REGIONAL_HOLIDAYS, WEEKDAYS, holiday_flag, weekday_name
from ..operators import reshape as R
from ..operators import sampling as L
from ..operators.spine import front_zero_back_ffill
from ..sources import views as V
from ..sources.tables import table
from .registry import query

NATIONS = [f"NATION_{i}" for i in range(25)]
MD5 = "('0x' || substr(md5({x}), 1, 15))::BIGINT"


def _h(expr):
    return MD5.format(x=expr)


@query("ffill_edges", views=("spine", "instr"), sql="""
, o AS (SELECT unit, day, weather_tax FROM instr WHERE day <= DATE '2001-06-30'),
 j AS (SELECT s.unit, s.day, o.weather_tax, o.day IS NOT NULL AS obs FROM spine s LEFT JOIN o ON s.unit = o.unit AND s.day = o.day),
 k AS (SELECT *, MAX(CASE WHEN obs THEN day END) OVER (PARTITION BY unit) AS last_obs,
   LAST_VALUE(CASE WHEN obs THEN COALESCE(weather_tax, 0) END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY day
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM j)
SELECT unit, day, ROUND(CASE WHEN last_obs IS NOT NULL AND day > last_obs THEN carried ELSE COALESCE(weather_tax, 0) END, 9) AS weather_tax
FROM k""")
def ffill_edges(spark, d):
    obs = V.instr(spark, d).where(F.col("day") <= F.to_date(F.lit("2001-06-30")))
    out = front_zero_back_ffill(V.spine(spark, d), obs, ["weather_tax"])
    return out.select("unit", "day", F.round("weather_tax", 9).alias("weather_tax"))


@query("pivot_unit_day", views=("panel",), sql="SELECT day, " + ", ".join(
    f"CAST(SUM(CASE WHEN unit = '{u}' THEN media_online_protest END) AS BIGINT) AS \"{u}\"" for u in NATIONS) +
    " FROM panel GROUP BY day")
def pivot_unit_day(spark, d):
    # pivot values: the unit dimension (fixed-size table), read once
    units = [r[0] for r in V.units(spark, d).orderBy("unit").collect()]
    return R.pivot_known(V.panel(spark, d), ["day"], "unit", units, "media_online_protest")


@query("unpivot", views=("panel",), sql=" UNION ALL ".join(
    f"SELECT unit, day, '{c}' AS outcome, {c} AS value FROM panel" for c in V.MEDIA_COLS))
def unpivot(spark, d):
    p = V.panel(spark, d).select("unit", "day", *V.MEDIA_COLS)
    return R.to_long(p, ["unit", "day"], V.MEDIA_COLS, "outcome", "value")


_WD = sorted(WEEKDAYS)[1:]


def _hol_sql():
    nat = ", ".join(f"'{x}'" for x in NATIONAL_HOLIDAYS)
    parts = [f"strftime(day, '%m-%d') IN ({nat})"]
    for a, days in REGIONAL_HOLIDAYS.items():
        parts.append(f"(area = '{a}' AND strftime(day, '%m-%d') IN ({', '.join(repr(x) for x in days)}))")
    return "CAST((" + " OR ".join(parts) + ") AS INTEGER)"


@query("one_hot", views=("spine",), sql="SELECT s.unit, s.day, " + ", ".join(
    f"CASE WHEN dayname(s.day) = '{w}' THEN 1 ELSE 0 END AS weekday_{w}" for w in _WD) +
    f", {_hol_sql()} AS holiday FROM (SELECT sp.*, r.r_name AS area FROM spine sp JOIN nation n ON sp.unit = n.n_name "
    "JOIN region r ON n.n_regionkey = r.r_regionkey) s")
def one_hot(spark, d):
    from ..sources.tables import dim
    area = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("unit"), F.col("r_name").alias("area"))
    s = V.spine(spark, d).join(area, "unit").withColumn("wd", weekday_name("day"))
    return s.select("unit", "day", *R.one_hot_drop_first("wd", WEEKDAYS, "weekday"),
                    holiday_flag("day", "area").alias("holiday"))


@query("explode_multi", sql="""
SELECT conv_id, turn, CAST(g.i - 1 AS INTEGER) AS pos, string_split(text, chr(10))[g.i] AS part
FROM conversations, range(1, len(string_split(text, chr(10))) + 1) g(i)""")
def explode_multi(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return R.explode_split(c, "text", "\n")


@query("flatten_struct", views=("evlog",), sql="SELECT event_id, day, user_id, event_type, k FROM evlog")
def flatten_struct(spark, d):
    e = V.evlog(spark, d).select("event_id", F.struct("day", "user_id", "event_type", "k").alias("meta"))
    return R.flatten(e, "meta")


EVT = ["click", "error", "purchase", "signup", "view"]


@query("ragged_to_table", sql="""
WITH u AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 45),
 r AS (SELECT event_type, user_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY user_id) AS pos FROM u)
SELECT pos, """ + ", ".join(f"MAX(CASE WHEN event_type = '{e}' THEN user_id END) AS {e}" for e in EVT) + " FROM r GROUP BY pos")
def ragged_to_table(spark, d):
    u = table(spark, d, "events").where(F.col("value") > 45).select("event_type", "user_id").distinct()
    r = L.index_within_group(u, "event_type", ["user_id"], "pos")
    return R.ragged_to_table(r, "event_type", "pos", "user_id", EVT)


@query("explode_map", sql="""
SELECT doc_id, 'chars' AS term, n_chars AS n FROM documents UNION ALL
SELECT doc_id, 'lines', CAST(len(string_split(text, chr(10))) AS BIGINT) FROM documents""")
def explode_map(spark, d):
    t = table(spark, d, "documents")
    m = F.map_from_arrays(F.array(F.lit("chars"), F.lit("lines")),
                          F.array(F.col("n_chars"), F.size(F.split("text", "\n")).cast("long")))
    return R.explode_map(t.select("doc_id", m.alias("m")), "m", "term", "n")


@query("id_set_ops", sql="""
SELECT 'intersect' AS op, doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0)
UNION ALL SELECT 'except', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'union', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1)""")
def id_set_ops(spark, d):
    lab = table(spark, d, "labels")
    a = lab.where("quality = 1").select("doc_id")
    b0 = lab.where("toxic = 0").select("doc_id")
    b1 = lab.where("toxic = 1").select("doc_id")
    q0 = lab.where("quality = 0").select("doc_id")
    return (a.intersect(b0).select(F.lit("intersect").alias("op"), "doc_id")
            .unionByName(a.subtract(b1).select(F.lit("except").alias("op"), "doc_id"))
            .unionByName(q0.union(b1).distinct().select(F.lit("union").alias("op"), "doc_id")))


@query("topk_days", views=("panel",), sql="""
SELECT day, ROUND((SUM(media_online_protest) + SUM(media_print_protest)) / 2.0, 2) AS mean_media FROM panel
GROUP BY day ORDER BY mean_media DESC, day LIMIT 5""")
def topk_days(spark, d):
    n = V.panel(spark, d).groupBy("day").agg(
        F.round((F.sum("media_online_protest") + F.sum("media_print_protest")) / 2.0, 2).alias("mean_media"))
    return n.orderBy(F.col("mean_media").desc(), "day").limit(5)


@query("dedupe_sort", views=("ev",), sql="SELECT DISTINCT unit, actor, location FROM ev ORDER BY unit, actor, location")
def dedupe_sort(spark, d):
    return V.ev(spark, d).select("unit", "actor", "location").dropDuplicates().orderBy("unit", "actor", "location")


@query("seeded_sample", sql=f"""
SELECT doc_id, source FROM documents ORDER BY {_h("'11|' || CAST(doc_id AS VARCHAR)")}, doc_id LIMIT 50""")
def seeded_sample(spark, d):
    return L.seeded_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 50, 11)


@query("bootstrap_unit", views=("panel",), sql=f"""
, b AS (SELECT unit, day, occ_protest, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) AS rn,
          COUNT(*) OVER (PARTITION BY unit) AS n FROM panel),
 s AS (SELECT *, {_h("'5|' || unit || '|' || CAST(rn AS VARCHAR)")} % n + 1 AS src FROM b)
SELECT s.unit, s.day, v.occ_protest FROM s JOIN b v ON v.unit = s.unit AND v.rn = s.src""")
def bootstrap_unit(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest")
    return L.bootstrap_within(p, "unit", "day", ["occ_protest"], 5)


@query("resample_global", views=("panel",), sql=f"""
, b AS (SELECT unit, day, occ_F, ROW_NUMBER() OVER (ORDER BY day, unit) AS idx, COUNT(*) OVER () AS n FROM panel),
 s AS (SELECT *, {_h("'9|' || CAST(idx AS VARCHAR)")} % n + 1 AS src FROM b)
SELECT s.unit, s.day, v.occ_F FROM s JOIN b v ON v.idx = s.src""")
def resample_global(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_F")
    return L.resample_global(p, ["day", "unit"], ["occ_F"], 9)


@query("kfold", views=("panel",), sql=f"""
SELECT unit, day, {_h("'3|' || CAST(day AS VARCHAR)")} % 5 AS fold FROM panel""")
def kfold(spark, d):
    p = V.panel(spark, d).select("unit", "day")
    return p.withColumn("fold", L.hash_fold(F.col("day").cast("string"), 5, 3))


@query("expanding_folds", views=("panel",), sql="""
, f AS (SELECT CAST(floor(datediff('day', DATE '1995-01-01', day) * 5 / 2405) AS BIGINT) AS fold, occ_protest FROM panel)
SELECT k.k AS fold, COUNT(CASE WHEN f.fold < k.k THEN 1 END) AS n_train, COUNT(CASE WHEN f.fold = k.k THEN 1 END) AS n_test,
  CAST(SUM(CASE WHEN f.fold = k.k THEN occ_protest ELSE 0 END) AS BIGINT) AS events_test
FROM f, (SELECT range AS k FROM range(1, 5)) k GROUP BY k.k""")
def expanding_folds(spark, d):
    n_days = (F.datediff(F.to_date(F.lit(V.END)), F.to_date(F.lit(V.START))) + 1)
    p = V.panel(spark, d).select(F.floor(F.datediff("day", F.to_date(F.lit(V.START))) * 5 / n_days).cast("long").alias("fold"),
                                 "occ_protest")
    # per-fold counts first (one aggregate), then the expanding sums over the 5 fold rows
    c = p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("occ_protest").cast("long").alias("ev"))
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("n_train", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))
    return out.where("fold >= 1").select("fold", "n_train", F.col("n").alias("n_test"), F.col("ev").alias("events_test"))


@query("loso_folds", sql="""
WITH x AS (SELECT d.source, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
 c AS (SELECT source, COUNT(*) AS n, SUM(quality) AS pos FROM x GROUP BY source)
SELECT source AS test_source, CAST(SUM(n) OVER () - n AS BIGINT) AS n_train, n AS n_test, CAST(pos AS BIGINT) AS positives_test FROM c""".replace(
    "WITH x AS", ", x AS"))
def loso_folds(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    c = x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("pos"))
    total = c.agg(F.sum("n")).first()[0]
    return c.select(F.col("source").alias("test_source"), (F.lit(total) - F.col("n")).cast("long").alias("n_train"),
                    F.col("n").alias("n_test"), F.col("pos").alias("positives_test"))


@query("chrono_split", views=("panel",), sql="""
, s AS (SELECT unit, CASE WHEN ROW_NUMBER() OVER (PARTITION BY unit ORDER BY day) <= floor(COUNT(*) OVER (PARTITION BY unit) * 0.8)
   THEN 'train' ELSE 'test' END AS split, occ_protest FROM panel)
SELECT unit, split, COUNT(*) AS n, CAST(SUM(occ_protest) AS BIGINT) AS events FROM s GROUP BY 1, 2""")
def chrono_split(spark, d):
    p = V.panel(spark, d).select("unit", "day", "occ_protest")
    s = p.withColumn("split", L.chronological_split(p, "day", 0.8, ["unit"]))
    return s.groupBy("unit", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("occ_protest").cast("long").alias("events"))


@query("placebo_events", views=("ev",), sql=f"""
, w AS (SELECT unit, COUNT(*) AS c FROM ev GROUP BY unit),
 cw AS (SELECT unit, SUM(c) OVER (ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / SUM(c) OVER () AS hi FROM w),
 cw2 AS (SELECT unit, hi, COALESCE(LAG(hi) OVER (ORDER BY unit), 0.0) AS lo FROM cw),
 dr AS (SELECT event_id AS placebo_id, {_h("'42|u|' || CAST(event_id AS VARCHAR)")} / 1152921504606846976.0 AS u,
          {_h("'42|d|' || CAST(event_id AS VARCHAR)")} % 2405 AS dd FROM ev)
SELECT dr.placebo_id, cw2.unit, CAST(DATE '1995-01-01' + CAST(dr.dd AS INTEGER) AS DATE) AS day FROM dr JOIN cw2 ON dr.u >= cw2.lo AND dr.u < cw2.hi""")
def placebo_events(spark, d):
    e = V.ev(spark, d)
    w = e.groupBy("unit").agg(F.count(F.lit(1)).alias("w"))
    return L.placebo_events(w, e.select(F.col("event_id").alias("id")), V.START, 2405, 42)
