"""Days in words: movable feasts (F9), date helper with holidays (F24), the daily text history (W23), sizes."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..sources import views as V
from ..sources.tables import dim, table
from .registry import query

#: Stand-in: the state whose rules a unit's region follows.
STATES = {"EUROPE": "BY", "AMERICA": "SN", "ASIA": "BB", "AFRICA": "TH", "MIDDLE EAST": "HE"}


def _days(spark, d):
    """The spine with each unit's state and its holidays."""
    area = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    units = area.select(F.col("n_name").alias("unit"), F.element_at(state, F.col("r_name")).alias("state"))
    return D.with_holiday(V.spine(spark, d).join(F.broadcast(units), "unit"))


# another computus than the library's
_EASTER_SQL = """e0 AS (SELECT CAST(y AS BIGINT) AS y, y % 19 AS g, y // 100 AS c FROM range(1990, 2030) t(y)),
 e1 AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM e0),
 e2 AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM e1),
 e3 AS (SELECT *, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM e2),
 easter AS (SELECT y, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS e FROM e3)"""


def _rules_sql():
    rows = []
    for rank, (name, when, states, first) in enumerate(D.HOLIDAYS):
        date = f"e + {when}" if isinstance(when, int) else f"make_date(y, {int(when[:2])}, {int(when[3:])})"
        for s in (states.split() if states else STATES.values()):
            rows.append(f"SELECT {rank} AS rank, '{s}' AS state, {date} AS day, '{name.replace(chr(39), chr(39) * 2)}' AS holiday FROM easter WHERE y >= {first}")
    rows.append("SELECT 99, 'SN', make_date(y, 11, 22) - CAST((dayofweek(make_date(y, 11, 22)) + 4) % 7 AS INTEGER), 'Repentance' FROM easter")
    return " UNION ALL ".join(rows)


_DAYS_SQL = f""", {_EASTER_SQL},
 rules AS (SELECT state, CAST(day AS DATE) AS day, min_by(holiday, rank) AS holiday FROM ({_rules_sql()}) GROUP BY 1, 2),
 st AS (SELECT n_name AS unit, CASE r_name {" ".join(f"WHEN '{a}' THEN '{s}'" for a, s in STATES.items())} END AS state
        FROM nation JOIN region ON n_regionkey = r_regionkey),
 days AS (SELECT s.unit, st.state, s.day, rules.holiday FROM spine s JOIN st ON s.unit = st.unit
          LEFT JOIN rules ON rules.state = st.state AND rules.day = s.day)"""
_LINE_SQL = """unit || ', ' || dayname(day) || ', ' || day(day) || '. ' || monthname(day) || ' ' || year(day) || coalesce(', ' || holiday, '')"""


@query("movable_feasts", views=("spine",), sql=_DAYS_SQL + """
SELECT unit, state, day, holiday FROM days WHERE holiday IS NOT NULL""")
def movable_feasts(spark, d):
    """every public holiday of every unit, movable and regional ones included, for all years of the data."""
    return _days(spark, d).where(F.col("holiday").isNotNull()).select("unit", "state", "day", "holiday")


@query("date_context_holiday", views=("spine",), sql=_DAYS_SQL + f""",
 l AS (SELECT *, {_LINE_SQL} AS line FROM days)
SELECT unit, day, array_to_string(list(line) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), chr(10)) AS context
FROM l""")
def date_context_holiday(spark, d):
    """the date helper of the seven days before and after, with region and holidays."""
    s = _days(spark, d).repartition("unit").withColumn("line", D.day_line("unit", "day", "holiday"))
    w = Window.partitionBy("unit").orderBy("day").rowsBetween(-7, 7)
    return s.select("unit", "day", F.array_join(F.collect_list("line").over(w), "\n").alias("context"))


HEADLINE_QUANTITY = 50


@query("day_text_series", views=("spine", "ev"), sql=_DAYS_SQL + f""",
 n AS (SELECT unit, day, COUNT(*) AS n, string_agg(actor || ': ' || notes || chr(10), '' ORDER BY actor, notes) AS notes FROM ev GROUP BY 1, 2),
 h AS (SELECT unit, day, string_agg(p_name, '; ' ORDER BY p_name) AS headlines FROM (
   SELECT DISTINCT n.n_name AS unit, CAST(l.l_shipdate AS DATE) AS day, p.p_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
   JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_quantity = {HEADLINE_QUANTITY}) GROUP BY 1, 2),
 t AS (SELECT days.unit, days.day, {_LINE_SQL.replace("unit ||", "days.unit ||").replace("(day)", "(days.day)")} AS head,
   CASE WHEN n.n > 0 THEN 'yes' ELSE 'no' END AS label,
   CASE WHEN n.n > 0 THEN chr(10) || 'number of events: ' || n.n || chr(10) || 'Events:' || chr(10) || n.notes ELSE chr(10) END
     || 'Headlines:' || chr(10) || coalesce(h.headlines, '') || chr(10) AS tail
   FROM days LEFT JOIN n ON n.unit = days.unit AND n.day = days.day LEFT JOIN h ON h.unit = days.unit AND h.day = days.day),
 w AS (SELECT unit, day, head, label, list(head) OVER b AS hs, list(label || tail) OVER b AS ts FROM t
       WINDOW b AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT unit, day, label, sha256(coalesce(array_to_string(list_transform(range(1, len(hs) + 1), lambda i: hs[i] || ' (' || (len(hs) - i + 1) ||
    ' days ago)' || chr(10) || 'has events: ' || ts[i] || chr(10)), ''), '') || head || ' (today)' || chr(10) || 'has events: ') AS text_sha256 FROM w""")
def day_text_series(spark, d):
    """For every unit-day the texts of the 30 days before (region, date, holiday, days ago, events with their notes,
    headlines) and today's up to the question; the label answers it.  Registered with the text's digest."""
    return day_texts(spark, d).select("unit", "day", "label", F.sha2("text", 256).alias("text_sha256"))


def day_texts(spark, d):
    """(unit, day, label, text) of ``day_text_series``.  A day's items are put together once and read by the 31 windows that
    hold them; headlines are distinct before they are collected."""
    e = V.ev(spark, d)
    notes = e.groupBy("unit", "day").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("actor", "notes"))),
                                                               lambda x: F.concat(x["actor"], F.lit(": "), x["notes"], F.lit("\n"))), "").alias("notes"))
    sup = table(spark, d, "supplier").join(dim(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .select("s_suppkey", F.col("n_name").alias("unit"))
    line = table(spark, d, "lineitem").where(F.col("l_quantity") == HEADLINE_QUANTITY)
    heads = (line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
             .select("unit", F.to_date("l_shipdate").alias("day"), "p_name").distinct().groupBy("unit", "day")
             .agg(F.array_join(F.sort_array(F.collect_list("p_name")), "; ").alias("headlines")))
    t = _days(spark, d).join(notes, ["unit", "day"], "left").join(heads, ["unit", "day"], "left").repartition("unit")
    some = F.col("n") > 0
    t = t.select("unit", "day", F.when(some, "yes").otherwise("no").alias("label"),
                 D.day_line("unit", "day", "holiday").alias("head"),
                 F.concat(F.when(some, F.concat(F.lit("\nnumber of events: "), F.col("n").cast("string"), F.lit("\nEvents:\n"), F.col("notes")))
                          .otherwise("\n"), F.lit("Headlines:\n"), F.coalesce("headlines", F.lit("")), F.lit("\n")).alias("tail"))
    w = Window.partitionBy("unit").orderBy("day").rowsBetween(-30, -1)
    t = t.withColumn("past", F.collect_list(F.struct("head", "label", "tail")).over(w))
    items = F.transform("past", lambda x, i: F.concat(x["head"], F.lit(" ("), (F.size("past") - i).cast("string"), F.lit(" days ago)\nhas events: "),
                                                      x["label"], x["tail"], F.lit("\n")))
    return t.select("unit", "day", "label", F.concat(F.array_join(items, ""), F.col("head"), F.lit(" (today)\nhas events: ")).alias("text"))


# F2 / S1 --------------------------------------------------------------------
def spelled(n):
    """Stand-in input: a number below a million in English words."""
    ones = F.split(F.lit("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                         "eighteen nineteen"), " ")
    tens = F.split(F.lit("- - twenty thirty forty fifty sixty seventy eighty ninety"), " ")

    def small(k):  # below 100
        at = lambda a, i: F.element_at(a, i.cast("int") + 1)
        return F.when(k < 20, at(ones, F.least(k, F.lit(19)))).otherwise(
            F.concat(at(tens, F.floor(k / 10)), F.when(k % 10 > 0, F.concat(F.lit("-"), at(ones, k % 10))).otherwise("")))

    def group(k):  # below 1000
        h = F.concat(F.element_at(ones, F.floor(k / 100).cast("int") + 1), F.lit(" hundred"))
        return F.when(k < 100, small(k)).when(k % 100 == 0, h).otherwise(F.concat(h, F.lit(" and "), small(k % 100)))

    big = F.concat(group(F.floor(n / 1000)), F.lit(" thousand"))
    return F.when(n < 1000, group(n)).when(n % 1000 == 0, big).otherwise(F.concat(big, F.lit(" "), group(n % 1000)))


@query("number_words", sql="""
SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 999999 + 1 AS n FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)""")
def number_words(spark, d):
    """every order's price as words, parsed back."""
    o = table(spark, d, "orders").select("o_orderkey", spelled(F.floor("o_totalprice") % 999999 + 1).alias("words"))
    return o.select("o_orderkey", X.parse_quantity("words").alias("n"))


@query("size_tags", sql="""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice)::BIGINT WHEN 1 THEN (floor(o_totalprice)::BIGINT + 2 * floor(o_totalprice)::BIGINT) // 2
  WHEN 2 THEN 50 END AS size FROM orders""")
def size_tags(spark, d):
    """Sizes out of event notes ("[size=...]") and tag cells ("crowd size=...")."""
    n = F.floor("o_totalprice").cast("string")
    note = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("A march. [size=around "), n, F.lit("]")))
            .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("armed; crowd size=between "), n, F.lit(" and "),
                                                         (2 * F.floor("o_totalprice")).cast("string")))
            .when(F.col("o_orderkey") % 4 == 2, F.lit("Road blocked [size=dozens]")).otherwise("A march. [size=no report]"))
    return table(spark, d, "orders").select("o_orderkey", X.parse_quantity(X.size_tag(note)).alias("size"))
