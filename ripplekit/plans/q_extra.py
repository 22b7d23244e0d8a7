"""Remaining inventory items: JSON answers (F13), numeric checks (F21),
mis-decoding (F22), label repair (P17), positional zip (J13), folder union
(S7), indicator matrix (S8), effects by treatment group (C28), synthetic
curves (A37)."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..estimators import linear as LN
from ..estimators import synth as SC
from ..operators import windows as W
from ..operators.sampling import _global_index
from ..sources import files as S
from ..sources import views as V
from ..sources.tables import table
from .q_sources import _scratch
from .registry import query

ANSWER_SCHEMA = ("array<struct<IS_CLIMATE_PROTEST_EVENT: boolean, PAST_OR_FUTURE: string, COUNTRY: string, "
                 "CITY: string, PROTEST_DATE_YEAR: int, PROTEST_DATE_MONTH: string, PROTEST_DATE_DAY: int, "
                 "N_PARTICIPANTS: int>>")


@query("json_answers", views=("ev",), sql="""
SELECT event_id, lower(split_part(location || ' - ' || unit, ' - ', 1)) AS city, day AS date,
  CAST(floor(size / 1000) AS INTEGER) AS n_participants FROM ev
WHERE actor = 'F' AND location IN ('BUILDING', 'MACHINERY')""")
def json_answers(spark, d):
    """parse answer JSON (bad JSON -> no rows), keep objects with the
    flag set, PAST and country DE, first city token, date from parts."""
    e = V.ev(spark, d)
    obj = F.struct(
        (F.col("actor") == "F").alias("IS_CLIMATE_PROTEST_EVENT"),
        F.when(F.col("location").isin("BUILDING", "MACHINERY"), "PAST").otherwise("FUTURE").alias("PAST_OR_FUTURE"),
        F.lit("DE").alias("COUNTRY"), F.concat_ws(" - ", "location", "unit").alias("CITY"),
        F.year("day").alias("PROTEST_DATE_YEAR"), F.date_format("day", "MMMM").alias("PROTEST_DATE_MONTH"),
        F.dayofmonth("day").alias("PROTEST_DATE_DAY"), F.floor(F.col("size") / 1000).cast("int").alias("N_PARTICIPANTS"))
    other = obj.withField("COUNTRY", F.lit("AT"))
    answer = F.when(F.col("actor") == "P", F.lit("I could not find an event.")).otherwise(F.to_json(F.array(obj, other)))
    a = e.select("event_id", answer.alias("answer"))
    parsed = a.select("event_id", F.explode(F.from_json("answer", ANSWER_SCHEMA)).alias("o")) \
              .where(F.col("o").isNotNull())
    keep = parsed.where(F.col("o.IS_CLIMATE_PROTEST_EVENT") & (F.col("o.PAST_OR_FUTURE") == "PAST")
                        & (F.col("o.COUNTRY") == "DE"))
    date = F.try_to_date(F.concat_ws("-", F.col("o.PROTEST_DATE_YEAR").cast("string"), F.col("o.PROTEST_DATE_MONTH"),
                                     F.col("o.PROTEST_DATE_DAY").cast("string")), "yyyy-MMMM-d")
    return keep.select("event_id", F.lower(F.split_part(F.col("o.CITY"), F.lit(" - "), F.lit(1))).alias("city"),
                       date.alias("date"), F.col("o.N_PARTICIPANTS").alias("n_participants"))


@query("numeric_check", sql="""
SELECT lang, COUNT(*) AS words, CAST(SUM(CASE WHEN regexp_matches(w, '^[0-9]+([.][0-9]+)?$') THEN 1 ELSE 0 END) AS BIGINT) AS numeric
FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang""")
def numeric_check(spark, d):
    """which tokens are numbers (plain decimal literals)."""
    w = table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("w"))
    isnum = F.col("w").rlike(r"^[0-9]+([.][0-9]+)?$") & F.col("w").try_cast("double").isNotNull()
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.sum(isnum.cast("int")).cast("long").alias("numeric"))


MIS_WORDS = ["für", "über", "schön", "grün", "straße", "été", "très"]


@query("mis_decoding")
def mis_decoding(spark, d):
    """does the UTF-8 -> Latin-1 mis-decoded form of known words occur?"""
    words = spark.createDataFrame([(w,) for w in MIS_WORDS], "word string") \
        .withColumn("mis", F.decode(F.encode("word", "UTF-8"), "ISO-8859-1"))
    toks = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("tok"))
    cnt = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    a = words.join(cnt.withColumnRenamed("tok", "word").withColumnRenamed("n", "n_ok"), "word", "left")
    b = a.join(cnt.withColumnRenamed("tok", "mis").withColumnRenamed("n", "n_mis"), "mis", "left")
    return b.select("word", "mis", F.coalesce("n_ok", F.lit(0)).alias("n_ok"), F.coalesce("n_mis", F.lit(0)).alias("n_mis"))


@query("label_repair", sql="""
SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 0 WHEN doc_id < 20 AND quality = 0 THEN 1 ELSE quality END AS label FROM labels""")
def label_repair(spark, d):
    """Index-dependent rule (first ids relabelled) and reject -> opposite."""
    lab = table(spark, d, "labels")
    return lab.select("doc_id", F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 0)
                      .when((F.col("doc_id") < 20) & (F.col("quality") == 0), 1).otherwise(F.col("quality")).alias("label"))


@query("positional_zip", sql="""
SELECT a.idx, a.doc_id, b.doc_id AS label_doc_id, b.quality FROM
 (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) AS idx FROM documents) a JOIN
 (SELECT doc_id, quality, ROW_NUMBER() OVER (ORDER BY doc_id) AS idx FROM labels) b ON a.idx = b.idx""")
def positional_zip(spark, d):
    """Two row-aligned tables joined on an explicit position computed
    from a range-partitioned sort (no single-task window)."""
    a = _global_index(table(spark, d, "documents").select("doc_id"), ["doc_id"], "idx")
    b = _global_index(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "idx") \
        .withColumnRenamed("doc_id", "label_doc_id")
    return a.join(b, "idx").select(F.col("idx").cast("long").alias("idx"), "doc_id", "label_doc_id", "quality")


@query("union_files", sql="""
SELECT doc_id, n_chars, NULL AS source, 'en' AS city FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, NULL, source, 'de' FROM documents WHERE lang = 'de'
UNION ALL SELECT doc_id, n_chars, source, 'fr' FROM documents WHERE lang = 'fr'""")
def union_files(spark, d):
    t = table(spark, d, "documents")
    frames = {"en": t.where("lang = 'en'").select("doc_id", "n_chars", F.lit(None).cast("string").alias("Unnamed: 0")),
              "de": t.where("lang = 'de'").select("doc_id", "source"),
              "fr": t.where("lang = 'fr'").select("doc_id", "n_chars", "source")}
    return S.union_files(frames)


@query("indicator_matrix", views=("instr",), sql="""
SELECT indicator, """ + ", ".join(f"MAX(CASE WHEN unit = 'NATION_{i}' THEN v END) AS \"NATION_{i}\"" for i in range(25)) + """
FROM (SELECT 'discount' AS indicator, unit, AVG(weather_discount) AS v FROM instr GROUP BY unit
      UNION ALL SELECT 'tax', unit, AVG(weather_tax) FROM instr GROUP BY unit) GROUP BY indicator""")
def indicator_matrix(spark, d):
    """Single-indicator text files (title line, header, key;region;value)
    written from the data, then read back as an indicator × region matrix."""
    base = _scratch(spark, "indicators")
    i = V.instr(spark, d)
    for name, col in [("discount", "weather_discount"), ("tax", "weather_tax")]:
        rows = i.groupBy("unit").agg(F.avg(col).alias("v"))
        line = F.concat_ws(";", F.lit("k"), "unit", F.col("v").cast("string"))
        # one small file per indicator: title, header, one line per region (bounded by #regions)
        text = rows.agg(F.concat_ws("\n", F.lit(name), F.lit("schluessel;regionaleinheit;wert"),
                                    F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
        text.write.mode("overwrite").text(os.path.join(base, name))
    regions = [r[0] for r in V.units(spark, d).orderBy("unit").collect()]   # 25-row dimension
    return S.indicator_matrix(spark, os.path.join(base, "*"), regions=regions)


@query("effects_by_group")
def effects_by_group(spark, d):
    """Treatments × methods as one grouped Gram pass (treatment = group key)."""
    p = V.panel(spark, d).select("unit", "day", "occ_F", "occ_O", "occ_P", V.MEDIA_COLS[0]).repartition("unit")
    p = p.withColumns({"y": W.cumulative_target(V.MEDIA_COLS[0], 7), "ylag": W.shift(V.MEDIA_COLS[0], 1)})
    long = p.unpivot(["y", "ylag"], ["occ_F", "occ_O", "occ_P"], "treatment", "occ") \
            .withColumn("occ", F.col("occ").cast("double"))
    r = LN.ols(long, "y", ["occ", "ylag"], group=["treatment"])
    return r.where(F.col("predictor") == "occ").withColumn("method", F.lit("regression")) \
            .withColumn("source", F.lit("ev"))


@query("sc_mean_curves")
def sc_mean_curves(spark, d):
    """Mean actual and mean synthetic outcome by relative day."""
    sc = SC.synthetic_control(V.panel(spark, d), [V.MEDIA_COLS[0]], 28, 7, start=V.START, scale="demean")
    return sc.groupBy("outcome", "rel_day").agg(F.avg("y").alias("y"), F.avg("y_synth").alias("y_synth"),
                                                F.count(F.lit(1)).alias("n"))


@query("ar_forecast")
def ar_forecast(spark, d):
    """Per event an AR(7) fitted on the unit's own 28-day pre-window,
    recursive 7-day forecast; effect summary by relative day."""
    sc = SC.synthetic_control(V.panel(spark, d), [V.MEDIA_COLS[0]], 28, 7, start=V.START, method="ar")
    e = sc.withColumn("err", F.col("y") - F.col("y_synth"))
    return e.groupBy("rel_day").agg(F.avg("err").alias("mean_effect"), F.sqrt(F.avg(F.col("err") ** 2)).alias("rmse"),
                                    F.count("err").alias("n"))


@query("sc_logdiff")
def sc_logdiff(spark, d):
    """Synthetic control in log-difference space, back-transformed."""
    sc = SC.synthetic_control(V.panel(spark, d), [V.MEDIA_COLS[0]], 28, 7, start=V.START, scale="logdiff")
    e = sc.withColumn("err", F.col("y") - F.col("y_synth"))
    return e.groupBy("rel_day").agg(F.avg("err").alias("mean_effect"), F.sqrt(F.avg(F.col("err") ** 2)).alias("rmse"),
                                    F.count("err").alias("n"))


@query("gmm_overid")
def gmm_overid(spark, d):
    """Efficient two-step GMM with Hansen J, next to 2SLS + Sargan."""
    from ..estimators import iv as IV
    from .q_models import design
    p, xs, ys = design(spark, d, instruments=True, lags=[-1, 0])
    exog = [c for c in xs if not c.startswith("occ_")]
    return IV.gmm_two_step(p, ys[0], ["occ_protest_lag0"], exog, V.INSTR_COLS)


@query("sc_pooled_regressors")
def sc_pooled_regressors(spark, d):
    """C20: forest / boosting / Poisson regressors pooled over all events on
    donor-summary features, trained on pre-period rows."""
    from ..estimators import ml as M
    r = SC.scaled_donor_mean(V.panel(spark, d), V.MEDIA_COLS[0], 28, 7, start=V.START)
    r = r.select(F.col("y").cast("double").alias("y"), "donor_mean", F.col("n_donors").cast("double").alias("n_donors"),
                 F.col("rel_day").cast("double").alias("rel"), "y_synth").dropna()
    return M.pooled_regressors(r, "y", ["donor_mean", "n_donors", "y_synth"], F.col("rel") < 0)


@query("model_filter_chain")
def model_filter_chain(spark, d):
    """Classifier predictions joined back to the corpus, positives above
    the threshold ordered by score."""
    from ..estimators import ml as M
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return M.model_filter_chain(docs.join(lab, "doc_id"), docs, "text", "label", 0.5)


@query("leaderboard")
def leaderboard(spark, d):
    """Trials table -> strip name prefixes, keep complete trials, sort by
    metric, distinct (over the synthetic-control configuration grid)."""
    g = SC.sc_grid(V.panel(spark, d), V.MEDIA_COLS[0], [7, 14, 28], 7, scales=(None, "demean"), start=V.START)
    t = g.withColumnRenamed("post_rmse", "value").select(
        F.regexp_replace("config", r"^pre=\d+\|", "").alias("scale"),
        F.regexp_extract("config", r"pre=(\d+)", 1).cast("int").alias("pre"), "value", "post_bias")
    return t.where(F.col("value").isNotNull()).distinct().orderBy("value")


@query("column_check", views=("ev", "evall"), sql="""
SELECT source, n_rows, x.name AS "column", x.must AS required, x.n IS NOT NULL AS present, COALESCE(x.n, 0) AS n_filled,
       NOT x.must OR COALESCE(x.n, -1) = n_rows AS ok
FROM (
  SELECT source, n_rows, UNNEST([
    {'name': 'event_id', 'must': TRUE, 'n': event_id}, {'name': 'day', 'must': TRUE, 'n': day},
    {'name': 'unit', 'must': TRUE, 'n': unit}, {'name': 'size', 'must': TRUE, 'n': size},
    {'name': 'notes', 'must': FALSE, 'n': notes}, {'name': 'location', 'must': FALSE, 'n': location}]) AS x
  FROM (
    SELECT 'ev' AS source, COUNT(*) AS n_rows, COUNT(event_id) AS event_id, COUNT(day) AS day, COUNT(unit) AS unit,
           COUNT(size) AS size, COUNT(notes) AS notes, COUNT(location) AS location FROM ev
    UNION ALL SELECT 'evall', COUNT(*), COUNT(event_id), COUNT(day), NULL, NULL, COUNT(notes), COUNT(location) FROM evall
    UNION ALL SELECT 'events', COUNT(*), COUNT(event_id), NULL, NULL, NULL, NULL, NULL FROM events))""")
def column_check(spark, d):
    """Required / optional columns per source: there, and filled in every row?"""
    from ..operators.filters import column_report
    frames = {"ev": V.ev(spark, d), "evall": V.evall(spark, d), "events": table(spark, d, "events")}
    return column_report(frames, ["event_id", "day", "unit", "size"], ["notes", "location"])


@query("min_count_sweep")
def min_count_sweep(spark, d):
    """Minimum-count sensitivity × training length: events whose treated
    pre-period mean is below the minimum are left out; one job for the grid."""
    g = SC.sc_grid(V.panel(spark, d), V.MEDIA_COLS[0], [14, 28], 7, start=V.START, min_counts=[0, 5, 10])
    return g.select(F.regexp_extract("config", r"pre=(\d+)", 1).cast("int").alias("pre"),
                    F.regexp_extract("config", r"min=([0-9.]+)", 1).cast("double").alias("min_count"),
                    "events", "pre_rmse", "post_bias", "post_rmse")


@query("prefix_columns", views=("instr",), sql="""
SELECT unit, day, weather_discount AS covid_weather_discount, weather_tax AS covid_weather_tax FROM instr""")
def prefix_columns(spark, d):
    """Drop a column if present (absent names ignored), prefix the rest."""
    from ..operators.filters import affix, drop_if_present
    i = drop_if_present(V.instr(spark, d), "weather_quantity", "not_there")
    return affix(i, prefix="covid_")


@query("finite_values", views=("ev",), sql="""
SELECT event_id, CASE WHEN isinf(exp(size / 500.0)) OR isnan(exp(size / 500.0)) THEN NULL ELSE ROUND(exp(size / 500.0) / 1e300, 12) END AS ratio FROM ev""")
def finite_values(spark, d):
    """±inf / NaN -> null (exp overflows for the largest sizes)."""
    from ..operators.filters import finite_or_null
    e = V.ev(spark, d)
    return e.select("event_id", F.round(finite_or_null(F.exp(F.col("size") / 500.0)) / 1e300, 12).alias("ratio"))


@query("clean_titles", sql="""
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '[“”„"]', '', 'g'), '^\\)\\s*', '') AS title
FROM pages""")
def clean_titles(spark, d):
    """quote / leading-bracket cleanup of scraped titles."""
    from ..functions.text import clean_quotes, html_title
    return table(spark, d, "pages").select("page_id", clean_quotes(html_title("html")).alias("title"))


@query("paragraph_join")
def paragraph_join(spark, d):
    """single line breaks -> spaces, paragraph breaks kept (Java regex
    look-arounds; checked against Python's re in tests)."""
    from ..functions.text import join_single_newlines
    return table(spark, d, "conversations").select("conv_id", "turn", join_single_newlines("text").alias("text"))


@query("date_context", views=("ev",), sql="""
SELECT event_id, array_to_string(list_transform(range(-7, 8), lambda k: strftime(day + CAST(k AS INTEGER), '%Y-%m-%d') || ' ' ||
  dayname(day + CAST(k AS INTEGER))), chr(10)) AS context FROM ev""")
def date_context(spark, d):
    """the ±7-day date helper text (date and weekday per line)."""
    from ..functions.dates import date_context as ctx
    return V.ev(spark, d).select("event_id", ctx("day").alias("context"))


@query("ar_forecast_grid")
def ar_forecast_grid(spark, d):
    """Autoregressive forecasts — recursive / direct, without / with the
    donors' mean as exogenous regressor — × lag order × training window, all
    configurations solved in one job."""
    g = SC.sc_grid(V.panel(spark, d), V.MEDIA_COLS[0], [28, 56], 7, start=V.START,
                   methods=("ar", "arx", "ar_direct", "arx_direct"), orders=(3, 7))
    return g.select("config", "events", "pre_rmse", "post_bias", "post_rmse")
