"""Stand-in views built from the given tables (see FIXTURES.md part B).

Each view exists twice: as a Spark DataFrame builder (what the library
runs) and as a SQL CTE (what the DuckDB oracle runs).  Both must define the
same columns with the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import conditional_counts, daily_treatment
from ..operators.spine import calendar_spine, fill_on_spine
from .tables import dim, table

# Fixed study period of the stand-in panel (parameters, like the reference's
# configured study period).
START = "1995-01-01"
END = "2001-08-01"
ACTORS = ("F", "O", "P")
MEDIA = [(m, d) for m in ("online", "print") for d in ("protest", "goal", "not_protest")]
MEDIA_COLS = [f"media_{m}_{d}" for m, d in MEDIA]
INSTR_COLS = ["weather_discount", "weather_tax", "weather_quantity"]


# ----------------------------------------------------------------- Spark side
def units(spark: SparkSession, d: str) -> DataFrame:
    return dim(spark, d, "nation").select(F.col("n_name").alias("unit"))


def ev(spark: SparkSession, d: str, priority: str = "1-URGENT") -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderpriority") == priority)
    c = table(spark, d, "customer")
    n = dim(spark, d, "nation")
    r = dim(spark, d, "region")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(o.o_orderkey.alias("event_id"), F.to_date(o.o_orderdate).alias("day"),
                     n.n_name.alias("unit"), r.r_name.alias("area"), o.o_orderstatus.alias("actor"),
                     c.c_mktsegment.alias("location"), o.o_totalprice.alias("size"),
                     c.c_name.alias("notes")))


def evall(spark: SparkSession, d: str) -> DataFrame:
    """Multi-source event table (role of the unioned protest sources)."""
    e = ev(spark, d)
    return e.select("event_id", "day", F.col("unit").alias("region"), F.col("actor").alias("type"),
                    "location", "notes",
                    F.when(F.col("location").isin("MACHINERY", "BUILDING", "AUTOMOBILE"), "acled")
                     .otherwise("gpreg").alias("source"),
                    F.col("size").alias("size_pre"),
                    F.when(F.col("actor") == "P", F.lit(None).cast("double"))
                     .otherwise(F.col("size") / 2).alias("size_post"))


def _lineitem_units(spark: SparkSession, d: str, cols) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", *cols)
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = dim(spark, d, "nation").select("n_nationkey", "n_name")
    su = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("unit"))
    return li.join(su, li.l_suppkey == su.s_suppkey).drop("l_suppkey", "s_suppkey")


def cnt(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem_units(spark, d, ["l_shipdate", "l_linestatus", "l_returnflag"])
    return (li.select("unit", F.to_date("l_shipdate").alias("day"),
                      F.when(F.col("l_linestatus") == "O", "online").otherwise("print").alias("medium"),
                      F.when(F.col("l_returnflag") == "A", "protest")
                       .when(F.col("l_returnflag") == "R", "goal").otherwise("not_protest").alias("dim"))
              .groupBy("unit", "day", "medium", "dim").agg(F.count(F.lit(1)).alias("n")))


def media_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily outcome counts per unit, one aggregate over the line table."""
    li = _lineitem_units(spark, d, ["l_shipdate", "l_linestatus", "l_returnflag"])
    medium = F.when(F.col("l_linestatus") == "O", "online").otherwise("print")
    dimc = (F.when(F.col("l_returnflag") == "A", "protest")
             .when(F.col("l_returnflag") == "R", "goal").otherwise("not_protest"))
    li = li.select("unit", F.to_date("l_shipdate").alias("day"), medium.alias("medium"), dimc.alias("dim"))
    spec = {f"media_{m}_{x}": (F.col("medium") == m) & (F.col("dim") == x) for m, x in MEDIA}
    return conditional_counts(li, ["unit", "day"], spec, weight=F.lit(1).cast("long"))


def treat(spark: SparkSession, d: str) -> DataFrame:
    return daily_treatment(ev(spark, d), ACTORS)


def instr(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem_units(spark, d, ["l_shipdate", "l_discount", "l_tax", "l_quantity"])
    return (li.groupBy("unit", F.to_date("l_shipdate").alias("day"))
              .agg(F.avg("l_discount").alias("weather_discount"), F.avg("l_tax").alias("weather_tax"),
                   F.avg("l_quantity").alias("weather_quantity")))


def spine(spark: SparkSession, d: str) -> DataFrame:
    return calendar_spine(units(spark, d), START, END)


def panel(spark: SparkSession, d: str, with_instruments: bool = False) -> DataFrame:
    t = treat(spark, d).drop("notes")
    m = media_daily(spark, d)
    fill = {c: 0 for c in ["occ_protest", *[f"occ_{a}" for a in ACTORS], "n_events", *MEDIA_COLS]}
    fill.update({c: 0.0 for c in [*[f"size_{a}" for a in ACTORS], "size_protest"]})
    p = fill_on_spine(fill_on_spine(spine(spark, d), t, fill=None), m, fill=fill)
    if with_instruments:
        p = p.join(instr(spark, d), on=["unit", "day"], how="left")
    return p


def nbr(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency: nations of the same region with consecutive keys (key, key+5),
    both directions.  An equi-join, linear in the number of units."""
    n = dim(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = n.alias("a"), n.alias("b")
    e = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) &
               (F.col("b.n_nationkey") == F.col("a.n_nationkey") + 5)) \
         .select(F.col("a.n_name").alias("unit"), F.col("b.n_name").alias("neighbour"))
    return e.unionByName(e.select(F.col("neighbour").alias("unit"), F.col("unit").alias("neighbour")))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def evlog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", "value",
                    F.from_json("props", "k int").getField("k").alias("k"))


# ------------------------------------------------------------------ SQL side
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"""SELECT o.o_orderkey AS event_id, CAST(o.o_orderdate AS DATE) AS day, n.n_name AS unit,
        r.r_name AS area, o.o_orderstatus AS actor, c.c_mktsegment AS location, o.o_totalprice AS size,
        c.c_name AS notes
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
      WHERE o.o_orderpriority = '1-URGENT'"""),
    "ev2": ((), f"""SELECT o.o_orderkey AS event_id, CAST(o.o_orderdate AS DATE) AS day, n.n_name AS unit,
        r.r_name AS area, o.o_orderstatus AS actor, c.c_mktsegment AS location, o.o_totalprice AS size,
        c.c_name AS notes
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
      WHERE o.o_orderpriority = '2-HIGH'"""),
    "evall": (("ev",), """SELECT event_id, day, unit AS region, actor AS type, location, notes,
        CASE WHEN location IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN 'acled' ELSE 'gpreg' END AS source,
        size AS size_pre, CASE WHEN actor = 'P' THEN NULL ELSE size / 2 END AS size_post
      FROM ev"""),
    "cnt": ((), """SELECT n.n_name AS unit, CAST(l.l_shipdate AS DATE) AS day,
        CASE WHEN l.l_linestatus = 'O' THEN 'online' ELSE 'print' END AS medium,
        CASE l.l_returnflag WHEN 'A' THEN 'protest' WHEN 'R' THEN 'goal' ELSE 'not_protest' END AS dim,
        COUNT(*) AS n
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
      GROUP BY 1, 2, 3, 4"""),
    "spine": ((), f"""SELECT n_name AS unit, CAST(g.d AS DATE) AS day
      FROM nation, range(DATE '{START}', DATE '{END}' + INTERVAL 1 DAY, INTERVAL 1 DAY) g(d)"""),
    "treat": (("ev",), """SELECT unit, day, 1 AS occ_protest,
        MAX(CASE WHEN strpos(actor, 'F') > 0 THEN 1 ELSE 0 END) AS occ_F,
        MAX(CASE WHEN strpos(actor, 'O') > 0 THEN 1 ELSE 0 END) AS occ_O,
        MAX(CASE WHEN strpos(actor, 'P') > 0 THEN 1 ELSE 0 END) AS occ_P,
        SUM(CASE WHEN actor = 'F' THEN size ELSE 0.0 END) AS size_F,
        SUM(CASE WHEN actor = 'O' THEN size ELSE 0.0 END) AS size_O,
        SUM(CASE WHEN actor = 'P' THEN size ELSE 0.0 END) AS size_P,
        SUM(COALESCE(size, 0.0)) AS size_protest, COUNT(*) AS n_events,
        string_agg(notes, '; ' ORDER BY notes) AS notes
      FROM ev GROUP BY unit, day"""),
    "media": (("cnt",), """SELECT unit, day,
        CAST(SUM(CASE WHEN medium = 'online' AND dim = 'protest' THEN n ELSE 0 END) AS BIGINT) AS media_online_protest,
        CAST(SUM(CASE WHEN medium = 'online' AND dim = 'goal' THEN n ELSE 0 END) AS BIGINT) AS media_online_goal,
        CAST(SUM(CASE WHEN medium = 'online' AND dim = 'not_protest' THEN n ELSE 0 END) AS BIGINT) AS media_online_not_protest,
        CAST(SUM(CASE WHEN medium = 'print' AND dim = 'protest' THEN n ELSE 0 END) AS BIGINT) AS media_print_protest,
        CAST(SUM(CASE WHEN medium = 'print' AND dim = 'goal' THEN n ELSE 0 END) AS BIGINT) AS media_print_goal,
        CAST(SUM(CASE WHEN medium = 'print' AND dim = 'not_protest' THEN n ELSE 0 END) AS BIGINT) AS media_print_not_protest
      FROM cnt GROUP BY unit, day"""),
    "instr": ((), """SELECT n.n_name AS unit, CAST(l.l_shipdate AS DATE) AS day,
        AVG(l.l_discount) AS weather_discount, AVG(l.l_tax) AS weather_tax, AVG(l.l_quantity) AS weather_quantity
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
      GROUP BY 1, 2"""),
    "panel": (("spine", "treat", "media"), """SELECT s.unit, s.day,
        COALESCE(t.occ_protest, 0) AS occ_protest, COALESCE(t.occ_F, 0) AS occ_F, COALESCE(t.occ_O, 0) AS occ_O,
        COALESCE(t.occ_P, 0) AS occ_P, COALESCE(t.size_F, 0.0) AS size_F, COALESCE(t.size_O, 0.0) AS size_O,
        COALESCE(t.size_P, 0.0) AS size_P, COALESCE(t.size_protest, 0.0) AS size_protest,
        COALESCE(t.n_events, 0) AS n_events,
        COALESCE(m.media_online_protest, 0) AS media_online_protest, COALESCE(m.media_online_goal, 0) AS media_online_goal,
        COALESCE(m.media_online_not_protest, 0) AS media_online_not_protest,
        COALESCE(m.media_print_protest, 0) AS media_print_protest, COALESCE(m.media_print_goal, 0) AS media_print_goal,
        COALESCE(m.media_print_not_protest, 0) AS media_print_not_protest
      FROM spine s LEFT JOIN treat t ON s.unit = t.unit AND s.day = t.day
        LEFT JOIN media m ON s.unit = m.unit AND s.day = m.day"""),
    "panelz": (("panel", "instr"), """SELECT p.*, i.weather_discount, i.weather_tax, i.weather_quantity
      FROM panel p LEFT JOIN instr i ON p.unit = i.unit AND p.day = i.day"""),
    "nbr": ((), """SELECT a.n_name AS unit, b.n_name AS neighbour FROM nation a JOIN nation b
        ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5
      UNION ALL SELECT b.n_name AS unit, a.n_name AS neighbour FROM nation a JOIN nation b
        ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5"""),
    "evlog": ((), """SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value,
        CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""),
}


def with_views(names, body: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in SQL_VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    b = body.lstrip()
    if not order:
        return "WITH " + b[1:] if b.startswith(",") else body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in order) + "\n" + b
