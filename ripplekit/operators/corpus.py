"""Text corpus jobs: boilerplate removal (F15), dedupe (F19/W17),
sessionizing fragments (W15), keyword-in-context (W16), text history (W23).

Per-document work stays inside the row (array higher-order functions), so it
needs no shuffle; corpus-wide statistics (line counts per source) are
ordinary aggregates with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boilerplate_lines(docs: DataFrame, source: str = "source", text: str = "text", share: float = 0.5,
                      top: int = 100) -> DataFrame:
    """(source, line) pairs whose count over all the source's documents exceeds
    ``share`` × #documents, among the ``top`` most common (stripped, non-empty,
    not '* * *') lines of the source."""
    lines = docs.select(source, F.explode(F.split(F.col(text), "\n")).alias("line")) \
                .select(source, F.trim("line").alias("line")) \
                .where((F.col("line") != "") & (F.col("line") != "* * *"))
    counts = lines.groupBy(source, "line").agg(F.count(F.lit(1)).alias("n"))
    ndocs = docs.groupBy(source).agg(F.count(F.lit(1)).alias("ndocs"))
    # Threshold first, rank after: a line above the threshold outranks every
    # line below it, so ranking only the candidates gives the same top-k, and
    # the window never sees a source's full set of distinct lines.
    cand = counts.join(ndocs, source).where(F.col("n") > F.col("ndocs") * share)
    w = Window.partitionBy(source).orderBy(F.col("n").desc(), F.col("line"))
    return cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select(source, "line")


def remove_lines(docs: DataFrame, common: DataFrame, key: str = "doc_id", source: str = "source",
                 text: str = "text") -> DataFrame:
    """Drop the common lines from every document of the source; other lines are
    stripped and kept in order.  The (small) per-source line sets are joined as
    an array so each document is filtered in place (no explode/regroup)."""
    sets = common.groupBy(source).agg(F.collect_set("line").alias("_common"))
    j = docs.join(sets, source, "left")
    kept = F.filter(F.transform(F.split(F.col(text), "\n"), lambda ln: F.trim(ln)),
                    lambda ln: ~F.coalesce(F.array_contains(F.col("_common"), ln), F.lit(False)))
    return j.select(*[F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in docs.columns])


def keep_first_per_content(docs: DataFrame, text: str = "text", order=("doc_id",), key: str = "doc_id") -> DataFrame:
    """One row per content hash, the earliest by ``order`` — an aggregate
    (min_by with partial aggregation), so a hash shared by a third of the
    corpus is still combined map-side."""
    h = F.md5(F.col(text))
    cols = [c for c in docs.columns]
    best = F.min_by(F.struct(*cols), F.struct(*[F.col(o) for o in order]))
    return docs.groupBy(h.alias("_h")).agg(best.alias("_b")).select("_b.*")


def sessionize(frags: DataFrame, part: str, order: str, title: str, text: str, sep: str = "\n...\n") -> DataFrame:
    """Consecutive fragments with the same title form one article
    (gaps-and-islands); article text = title + blank line + fragments joined
    by ``sep``.  The last island is kept."""
    w = Window.partitionBy(part).orderBy(order)
    new = F.when(F.lag(title).over(w).eqNullSafe(F.col(title)), 0).otherwise(1)
    isl = frags.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)
    return isl.groupBy(part, "island").agg(F.first(title).alias(title), F.min(order).alias("start"),
                                           F.count(F.lit(1)).alias("fragments"), body.alias("_body")) \
              .withColumn("article", F.concat_ws("\n\n", F.col(title), F.col("_body"))).drop("_body")


SENTENCE = r"[^.!?]+[.!?]*"


def sentences(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(SENTENCE), 0)


def kwic(df: DataFrame, text: str, pattern: str, n: int = 0, out: str = "kwic", gap: str = "\n...\n") -> DataFrame:
    """Sentences matching ``pattern`` plus ``n`` neighbours each side,
    concatenated in order; every run of kept sentences is preceded by ``gap``.
    Runs inside the row with higher-order functions (no shuffle).  Each
    intermediate array is its own projected column, so it is computed once
    per document rather than once per lambda call."""
    d = df.withColumn("_s", sentences(text))
    d = d.withColumn("_h", F.transform("_s", lambda x: x.rlike(pattern)))
    n_s = F.size("_s")
    d = d.withColumn("_k", F.transform(
        F.col("_s"), lambda x, i: F.exists(F.slice("_h", F.greatest(F.lit(1), i + 1 - n), 2 * n + 1 - F.greatest(F.lit(0), n - i)),
                                           lambda h: h)))
    # the reference also marks out-of-range neighbour -1 as kept when a match
    # lies in the first n sentences; then sentence 0 gets no gap marker
    virt = F.exists(F.slice("_h", 1, n), lambda h: h) if n >= 1 else F.lit(False)
    d = d.withColumn("_v", virt)
    pieces = F.transform(F.col("_s"), lambda x, i: F.when(
        F.element_at("_k", i + 1),
        F.concat(F.when(~F.when(i == 0, F.col("_v")).otherwise(F.element_at("_k", F.greatest(i, F.lit(1)))), F.lit(gap))
                 .otherwise(F.lit("")), x)).otherwise(F.lit("")))
    d = d.withColumn(out, F.when(n_s > 0, F.array_join(pieces, "")).otherwise(F.lit("")))
    return d.drop("_s", "_h", "_k", "_v")


def text_history(panel: DataFrame, line: Column, days: int = 30, unit: str = "unit", day: str = "day") -> Column:
    """The previous ``days`` daily lines of the unit joined by newlines
    (dense spine: row frame = day frame)."""
    w = Window.partitionBy(unit).orderBy(day).rowsBetween(-days, -1)
    return F.array_join(F.collect_list(line).over(w), "\n")
