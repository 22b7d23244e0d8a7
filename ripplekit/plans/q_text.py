"""Text functions and corpus jobs."""
from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import parse_day_first, split_dates
from ..operators import corpus as C
from ..sources import views as V
from ..sources.tables import table
from .registry import query


# F1
@query("umlaut_fold", sql="""
SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'a'), 'ö', 'o'), 'ü', 'u'),
  'ß', 'ss'), 'Ä', 'A'), 'Ö', 'O'), 'Ü', 'U') AS text FROM documents WHERE lang = 'de'""")
def umlaut_fold(spark, d):
    t = table(spark, d, "documents").where(F.col("lang") == "de")
    return t.select("doc_id", X.fold_umlauts("text").alias("text"))


# F2 -------------------------------------------------------------------------
QTEXT_SQL = """CASE event_id % 9
  WHEN 0 THEN CAST(CAST(floor(size / 1000) AS BIGINT) AS VARCHAR)
  WHEN 1 THEN 'around ' || CAST(CAST(floor(size / 1000) AS BIGINT) AS VARCHAR)
  WHEN 2 THEN 'between ' || CAST(CAST(floor(size / 2000) AS BIGINT) AS VARCHAR) || ' and ' || CAST(CAST(floor(size / 1000) AS BIGINT) AS VARCHAR)
  WHEN 3 THEN 'up to ' || format('{:,}', CAST(floor(size) AS BIGINT)) || ' people'
  WHEN 4 THEN 'dozens of people'
  WHEN 5 THEN CASE actor WHEN 'F' THEN 'two dozen' WHEN 'O' THEN 'several' ELSE 'hundreds of thousands' END
  WHEN 6 THEN CAST(CAST(floor(size / 1000) AS BIGINT) AS VARCHAR) || '.5'
  WHEN 7 THEN 'no report'
  ELSE 'a few hundred' END"""


def _qtext():
    n = F.floor(F.col("size") / 1000).cast("bigint").cast("string")
    k = F.col("event_id") % 9
    return (F.when(k == 0, n).when(k == 1, F.concat(F.lit("around "), n))
             .when(k == 2, F.concat(F.lit("between "), F.floor(F.col("size") / 2000).cast("bigint").cast("string"),
                                    F.lit(" and "), n))
             .when(k == 3, F.concat(F.lit("up to "), F.format_number(F.floor("size"), 0), F.lit(" people")))
             .when(k == 4, F.lit("dozens of people"))
             .when(k == 5, F.when(F.col("actor") == "F", "two dozen").when(F.col("actor") == "O", "several")
                   .otherwise("hundreds of thousands"))
             .when(k == 6, F.concat(n, F.lit(".5"))).when(k == 7, F.lit("no report")).otherwise(F.lit("a few hundred")))


def _sql_strip(expr, affixes, suffix):
    for a in affixes:
        pat = re.escape(a) + "$" if suffix else "^" + re.escape(a)
        expr = f"regexp_replace({expr}, '{pat}', '')"
    return expr


def _parse_sql(s):
    nc = f"regexp_replace({s}, '(\\d+),(\\d+)', '\\1\\2', 'g')"
    t = _sql_strip(_sql_strip(nc, X.SUFFIXES, True), X.PREFIXES, False)
    t2 = _sql_strip(t, X.PREFIXES2, False)
    words = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in X.NUMBER_WORDS.items()) + "}"
    phr = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in X.PHRASES.items()) + "}"
    nullw = ", ".join(f"'{w}'" for w in X.NULL_WORDS)
    few = ", ".join(f"'{w}'" for w in X.FEW)
    return f"""CASE WHEN regexp_matches({s}, '^\\s*[+-]?\\d+\\s*$') THEN TRY_CAST(trim({s}) AS BIGINT)
  WHEN TRY_CAST({s} AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST({s} AS DOUBLE)) THEN CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS BIGINT)
  WHEN {s} IS NULL OR {s} IN ({nullw}) THEN NULL
  WHEN regexp_matches({nc}, '(\\d+)\\D+(\\d+)') THEN (CAST(regexp_extract({nc}, '(\\d+)\\D+(\\d+)', 1) AS BIGINT)
       + CAST(regexp_extract({nc}, '(\\d+)\\D+(\\d+)', 2) AS BIGINT)) // 2
  WHEN regexp_matches({nc}, '(\\d+)') THEN CAST(regexp_extract({nc}, '(\\d+)', 1) AS BIGINT)
  WHEN {t} IN ({few}) THEN 5
  WHEN {phr}[{t2}] IS NOT NULL THEN {phr}[{t2}]
  WHEN ends_with({t2}, 'dozen') AND {words}[substr({t2}, 1, length({t2}) - 6)] IS NOT NULL
    THEN {words}[substr({t2}, 1, length({t2}) - 6)] * 12
  ELSE {words}[{t2}] END"""


@query("parse_quantity", views=("ev",), sql=f"""
SELECT event_id, q AS size_text, CAST({_parse_sql("q")} AS BIGINT) AS n FROM (SELECT event_id, {QTEXT_SQL} AS q FROM ev)""")
def parse_quantity(spark, d):
    e = V.ev(spark, d).select("event_id", _qtext().alias("size_text"))
    return X.with_parsed_quantity(e, "size_text", "n")


# F3
@query("place_cleanup", views=("ev",), sql="""
SELECT event_id, split_part(location || ' - ' || area, ' - ', 1) AS place FROM ev""")
def place_cleanup(spark, d):
    e = V.ev(spark, d)
    return e.select("event_id", X.clean_place(F.concat_ws(" - ", "location", "area")).alias("place"))


# F4 / F27 -------------------------------------------------------------------
TOPIC = ["tion", "ung"]
ORGS = {"eux": ["eux"], "ouch": ["ouch"], "schst": ["sch st", "schst"]}


def _org_sql():
    sq = "replace(lower(text), ' ', '')"
    rel = " OR ".join(f"strpos({sq}, '{w}') > 0" for w in TOPIC)
    codes = "list_sort(list_filter([" + ", ".join(
        "CASE WHEN " + " OR ".join(f"strpos({sq}, '{a.replace(' ', '')}') > 0" for a in al) + f" THEN '{c}' END"
        for c, al in ORGS.items()) + "], lambda x: x IS NOT NULL))"
    lab = f"upper(CASE WHEN len({codes}) = 0 THEN 'other_climate_org' ELSE array_to_string({codes}, '; ') END)"
    return f"CASE WHEN {rel} THEN CASE WHEN strpos({lab}, ';') > 0 THEN 'FFFX' ELSE {lab} END END"


@query("org_labels", sql=f"SELECT doc_id, {_org_sql()} AS actor FROM documents")
def org_labels(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.squeeze("text").alias("sq"))
    return t.select("doc_id", X.organisation_label("sq", TOPIC, ORGS, "climate", squeezed=True).alias("actor"))


# F5 -------------------------------------------------------------------------
Q_TOPIC = ["*tion*", "ouch*"]
Q_PROTEST = ["eux", "*ung", "?les"]


@query("bool_query")
def bool_query(spark, d):
    t = table(spark, d, "documents")
    qs = X.topic_queries("text", Q_TOPIC, Q_PROTEST, short=True)
    return t.groupBy("lang").agg(*[F.sum(c.cast("int")).cast("long").alias(k) for k, c in qs.items()],
                                 F.count(F.lit(1)).alias("n"))


# F7
@query("multi_date_split", views=("ev",), sql="""
SELECT event_id, CAST(COALESCE(try_strptime(p, '%d.%m.%Y'), try_strptime(p, '%d/%m/%Y')) AS DATE) AS day
FROM (SELECT event_id, unnest(regexp_split_to_array(strftime(day, '%-d.%-m.%Y') || ', ' || strftime(day + 2, '%-d/%-m/%Y')
      || ' und ' || strftime(day + 9, '%-d.%-m.%Y'), '\\s*(?:,|;|\\+|&|und)\\s*')) AS p FROM ev)""")
def multi_date_split(spark, d):
    e = V.ev(spark, d)
    cell = F.concat(F.date_format("day", "d.M.yyyy"), F.lit(", "), F.date_format(F.date_add("day", 2), "d/M/yyyy"),
                    F.lit(" und "), F.date_format(F.date_add("day", 9), "d.M.yyyy"))
    x = e.select("event_id", F.explode(split_dates(cell)).alias("p"))
    return x.select("event_id", parse_day_first("p", ("d.M.yyyy", "d/M/yyyy")).alias("day"))


# F11
@query("gibberish", sql="""
SELECT doc_id, ROUND((length(text) - length(replace(text, 'e', ''))) / GREATEST(1, length(text)), 9) AS share_e,
  (length(text) - length(replace(text, 'e', ''))) / GREATEST(1, length(text)) < 0.08 AS abnormal_e,
  (length(text) - length(replace(text, 'x', ''))) / GREATEST(1, length(text)) > 0.02 AS abnormal_x,
  (length(text) - length(replace(text, 'q', ''))) / GREATEST(1, length(text)) > 0.03 AS abnormal_q,
  (length(text) - length(replace(text, 'i', ''))) / GREATEST(1, length(text)) > 0.09 AS abnormal_i FROM documents""")
def gibberish(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.round(X.letter_share("text", "e"), 9).alias("share_e"),
                    *[c.alias(k) for k, c in X.gibberish_flags("text").items()])


# F12
@query("truncate_words", sql="""
SELECT doc_id, array_to_string(string_split(text, ' ')[1:50], ' ') AS head50 FROM documents""")
def truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_words("text", 50).alias("head50"))


# F15 ------------------------------------------------------------------------
BOILER_SQL = """
, l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
 c AS (SELECT source, line, COUNT(*) AS n FROM l WHERE line <> '' AND line <> '* * *' GROUP BY 1, 2),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY n DESC, line) AS rk FROM c),
 nd AS (SELECT source, COUNT(*) AS ndocs FROM documents GROUP BY source),
 common AS (SELECT r.source, r.line FROM r JOIN nd ON r.source = nd.source WHERE rk <= 100 AND n > ndocs * 0.5)"""


@query("boilerplate_lines", sql=BOILER_SQL + "\nSELECT source, line FROM common")
def boilerplate_lines(spark, d):
    return C.boilerplate_lines(table(spark, d, "documents"))


@query("boilerplate_clean", sql=BOILER_SQL + """,
 dl AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT d.doc_id, COALESCE(x.text, '') AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM dl
  WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.source = dl.source AND c.line = dl.line) GROUP BY doc_id) x
ON d.doc_id = x.doc_id""")
def boilerplate_clean(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    out = C.remove_lines(docs, C.boilerplate_lines(docs))
    return out.select("doc_id", "text")


# F16
W_ = "[\\p{L}\\p{N}_]"


@query("yes_no", sql="""
SELECT conv_id, turn, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(ja|yes)([^\\p{L}\\p{N}_]|$)') AS yes FROM conversations
WHERE role = 'assistant'""")
def yes_no(spark, d):
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", X.says_yes("text").alias("yes"))


# F17 (over the adjacency edges; units get rule-derived coordinates)
def _coords(n):
    return n.select(F.col("n_name").alias("unit"), (F.col("n_nationkey") * 3 - 30).cast("double").alias("lat"),
                    (F.col("n_regionkey") * 20 - 40 + F.col("n_nationkey")).cast("double").alias("lon"))


@query("distance_weights", views=("nbr",), sql="""
, c AS (SELECT n_name AS unit, CAST(n_nationkey * 3 - 30 AS DOUBLE) AS lat, CAST(n_regionkey * 20 - 40 + n_nationkey AS DOUBLE) AS lon FROM nation),
 e AS (SELECT nbr.unit, nbr.neighbour, 2 * 6371.0088 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
   + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))) AS km
   FROM nbr JOIN c a ON nbr.unit = a.unit JOIN c b ON nbr.neighbour = b.unit)
SELECT unit, neighbour, ROUND(km, 6) AS km, ROUND((1 / km) / SUM(1 / km) OVER (PARTITION BY unit), 9) AS weight FROM e""")
def distance_weights(spark, d):
    from ..sources.tables import dim
    c = _coords(dim(spark, d, "nation"))
    e = V.nbr(spark, d).join(c, "unit").join(
        c.select(F.col("unit").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "neighbour")
    e = e.withColumn("km", X.haversine_km("lat", "lon", "lat2", "lon2"))
    w = (1 / F.col("km")) / F.sum(1 / F.col("km")).over(Window.partitionBy("unit"))
    return e.select("unit", "neighbour", F.round("km", 6).alias("km"), F.round(w, 9).alias("weight"))


# F18
@query("decode_names", sql="""
SELECT regexp_extract(v, '^(.*)_lag(-?\\d+)$', 1) AS predictor, CAST(regexp_extract(v, '^(.*)_lag(-?\\d+)$', 2) AS INTEGER) AS lag
FROM (SELECT 'media_' || lower(l_returnflag) || '_lag' || CAST(-(l_linenumber - 1) AS VARCHAR) AS v FROM lineitem) GROUP BY 1, 2""")
def decode_names(spark, d):
    li = table(spark, d, "lineitem")
    v = F.concat(F.lit("media_"), F.lower("l_returnflag"), F.lit("_lag"), (-(F.col("l_linenumber") - 1)).cast("string"))
    p, lag = X.decode_lag_name(v)
    return li.select(p.alias("predictor"), lag.alias("lag")).distinct()


# F20
@query("tag_arrays", views=("ev",), sql="""
, t AS (SELECT unit, day, list_sort(list_distinct(list_transform(string_split(string_agg(actor, ';'), ';'), lambda x: trim(x)))) AS tags
        FROM ev GROUP BY unit, day)
SELECT unit, day, array_to_string(tags, ';') AS tags, tags[1] AS first_tag,
  array_to_string(CASE WHEN len(tags) > 1 THEN list_filter(tags, lambda x: x <> 'O') ELSE tags END, ';') AS cleaned FROM t""")
def tag_arrays(spark, d):
    e = V.ev(spark, d).groupBy("unit", "day").agg(F.concat_ws(";", F.collect_list("actor")).alias("s"))
    tags = F.array_sort(X.tag_array("s"))
    cleaned = F.when(F.size(tags) > 1, F.array_remove(tags, "O")).otherwise(tags)
    return e.select("unit", "day", F.array_join(tags, ";").alias("tags"), F.element_at(tags, 1).alias("first_tag"),
                    F.array_join(cleaned, ";").alias("cleaned"))


# F23
@query("url_site", sql="""
SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '^www\\.', '') AS site FROM pages""")
def url_site(spark, d):
    return table(spark, d, "pages").select("page_id", X.site_name("url").alias("site"))


# F25
HEADLINE_WORDS = ["eux", "ouch"]


@query("headline_filter", sql="""
SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)),
  lambda l: strpos(lower(l), 'eux') > 0 OR strpos(lower(l), 'ouch') > 0), chr(10)) AS kept FROM conversations""")
def headline_filter(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.keep_lines_with("text", HEADLINE_WORDS).alias("kept"))


# F26
MOVEMENTS = {"fr": ["eaux", "ouch"], "de": ["ung", "sch"], "en": ["the", "tion"]}


@query("topic_tags", sql="""
SELECT doc_id, array_to_string(list_sort(list_filter([""" + ", ".join(
    "CASE WHEN " + " OR ".join(f"strpos(lower(text), '{w}') > 0" for w in ws) + f" THEN '{m}' END" for m, ws in MOVEMENTS.items())
    + """], lambda x: x IS NOT NULL)), ',') AS tags FROM documents""")
def topic_tags(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.array_join(X.topic_tags("text", MOVEMENTS), ",").alias("tags"))


# S11 / S12 ------------------------------------------------------------------
@query("html_items", sql="""
SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS item FROM pages""")
def html_items(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(X.html_items("html")).alias("item"))


@query("html_text", sql="""
SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title,
  replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
    '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text
FROM pages""")
def html_text(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", X.html_title("html").alias("title"), X.html_text("html").alias("text"))


# W15
@query("sessionize", sql="""
, f AS (SELECT conv_id, turn, role, text,
   CASE WHEN LAG(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS nw FROM conversations),
 i AS (SELECT *, SUM(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT conv_id, island, FIRST(role) AS role, MIN(turn) AS start, COUNT(*) AS fragments,
  FIRST(role) || chr(10) || chr(10) || string_agg(text, chr(10) || '...' || chr(10) ORDER BY turn) AS article FROM i GROUP BY conv_id, island""")
def sessionize(spark, d):
    c = table(spark, d, "conversations")
    return C.sessionize(c, "conv_id", "turn", "role", "text")


# W16
KWIC_PATTERN = "(?i)tion|ouch"


@query("kwic", sql="""
, s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*', 0)) AS sent,
          generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]*', 0), 1) AS pos FROM documents),
 h AS (SELECT *, regexp_matches(sent, '(?i)tion|ouch') AS hit FROM s),
 k AS (SELECT *, BOOL_OR(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS kept,
          BOOL_OR(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS any_hit,
          FIRST_VALUE(hit) OVER (PARTITION BY doc_id ORDER BY pos) AS hit0 FROM h),
 g AS (SELECT *, LAG(kept) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k)
SELECT d.doc_id, COALESCE(x.kw, '') AS kwic FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN (pos = 1 AND NOT hit0) OR (pos > 1 AND NOT prev) THEN chr(10) || '...' || chr(10) ELSE '' END || sent, '' ORDER BY pos) AS kw
  FROM g WHERE kept GROUP BY doc_id) x ON d.doc_id = x.doc_id""")
def kwic(spark, d):
    t = table(spark, d, "documents")
    return C.kwic(t.select("doc_id", "text"), "text", KWIC_PATTERN, 1).select("doc_id", "kwic")


# W17 / F19
@query("dedupe_earliest", sql="SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def dedupe_earliest(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return C.keep_first_per_content(t).select("doc_id")


# W19
@query("unique_that_day", views=("evlog",), sql="""
SELECT event_id, COUNT(*) OVER (PARTITION BY day, user_id, event_type) > 1 AS duplicated FROM evlog""")
def unique_that_day(spark, d):
    from ..operators.aggregates import with_group_stats
    e = with_group_stats(V.evlog(spark, d), ["day", "user_id", "event_type"], {"_c": F.count(F.lit(1))})
    return e.select("event_id", (F.col("_c") > 1).alias("duplicated"))


# W23
@query("text_history", views=("spine", "treat"), sql="""
, l AS (SELECT s.unit, s.day, strftime(s.day, '%Y-%m-%d') || ' ' || dayname(s.day) || ': ' || COALESCE(t.notes, '') AS line,
         COALESCE(t.occ_protest, 0) AS label FROM spine s LEFT JOIN treat t ON s.unit = t.unit AND s.day = t.day)
SELECT unit, day, COALESCE(array_to_string(list(line) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history,
  label FROM l""")
def text_history(spark, d):
    s = V.spine(spark, d).join(V.treat(spark, d).select("unit", "day", "notes", "occ_protest"), ["unit", "day"], "left")
    line = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" "), F.date_format("day", "EEEE"), F.lit(": "),
                    F.coalesce("notes", F.lit("")))
    s = s.repartition("unit").withColumn("line", line)
    return s.select("unit", "day", C.text_history(s, F.col("line")).alias("history"),
                    F.coalesce("occ_protest", F.lit(0)).alias("label"))


# T6
@query("ticker_explode", sql="""
SELECT doc_id, CAST(g.i - 1 AS INTEGER) AS pos, trim(string_split(text, '##')[g.i]) AS part
FROM documents, range(1, len(string_split(text, '##')) + 1) g(i) WHERE strpos(text, '##') > 0""")
def ticker_explode(spark, d):
    t = table(spark, d, "documents").where(F.col("text").contains("##"))
    return t.select("doc_id", F.posexplode(F.split("text", "##")).alias("pos", "part")) \
            .withColumn("part", F.trim("part"))
