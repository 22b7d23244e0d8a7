"""Event-table operators: source selection (P13), flags (P6), union (U1),
daily treatment aggregate (A1/A2), organisation labels (F4 lives in functions.text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL of differently shaped event tables, tagged by source."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def add_type_flags(df: DataFrame, moderate_types, radical_types, col: str = "type") -> DataFrame:
    """Boolean flags from type sets."""
    return df.withColumns({"moderate": F.col(col).isin(list(moderate_types)),
                           "radical": F.col(col).isin(list(radical_types))})


def row_mean(*cols) -> Column:
    """Null-skipping row mean (null when every input is null)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    s = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.when(n > 0, s / n)


# Source modes "acled", "gpreg", "mean" and "difference"; any other label keeps all rows.
def source_modes(region_col: str, excluded_region: str) -> dict:
    """Mode -> (rows, size); no size: both size columns stay."""
    registered = F.col("source") == "gpreg"
    return {
        "acled": (F.col("source") == "acled", F.col("size_post")),
        "gpreg": (registered & ~F.col(region_col).eqNullSafe(excluded_region), F.col("size_pre")),
        "mean": (F.lit(True), row_mean("size_pre", "size_post")),
        "difference": (registered & (F.least("size_pre", "size_post") > 0) & F.col("size_pre").isNotNull()
                       & F.col("size_post").isNotNull(), None),
    }


def events_of_source(df: DataFrame, mode: str, region_col: str = "region", excluded_region: str = "Sachsen") -> DataFrame:
    """The rows of one source mode, with its size column where it has one."""
    modes = source_modes(region_col, excluded_region)
    if mode not in modes:
        return df
    rows, size = modes[mode]
    kept = df.where(rows)
    return kept.drop("source") if size is None else kept.withColumn("size", size).drop("size_pre", "size_post", "source")


def notes_agg(col: str = "notes", sep: str = "; ") -> Column:
    """A2: null-skipping, order-stable text concatenation; null when no text."""
    joined = F.array_join(F.sort_array(F.collect_list(F.col(col))), sep)
    return F.when(F.count(F.col(col)) > 0, joined)


def daily_treatment(events: DataFrame, actors, unit: str = "unit", day: str = "day",
                    actor: str = "actor", size: str = "size", notes: str | None = "notes",
                    strict: bool = False) -> DataFrame:
    """A1: one row per (unit, day) with any-event flags per actor (occ_*),
    summed sizes per actor (size_*), the event count and joined notes.

    ``occ_<a>`` uses substring matching of the actor label (reference rule, so a
    combined label also sets its parts); ``strict=True`` uses equality.
    ``size_<a>`` always uses equality.  One hash aggregate with map-side combine.
    """
    aggs = [F.lit(1).alias("occ_protest")]
    for a in actors:
        hit = (F.col(actor) == a) if strict else F.col(actor).contains(a)
        aggs.append(F.max(F.when(hit, 1).otherwise(0)).alias(f"occ_{a}"))
    for a in actors:
        aggs.append(F.sum(F.when(F.col(actor) == a, F.col(size)).otherwise(F.lit(0.0))).alias(f"size_{a}"))
    aggs.append(F.sum(F.coalesce(F.col(size), F.lit(0.0))).alias("size_protest"))
    aggs.append(F.count(F.lit(1)).alias("n_events"))
    if notes:
        aggs.append(notes_agg(notes).alias("notes"))
    return events.groupBy(unit, day).agg(*aggs)


def conditional_counts(df: DataFrame, keys, spec: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """A3/A4 with known pivot values: one aggregate of conditional sums
    (keeps map-side combine; avoids the extra distinct-values job of ``pivot``)."""
    w = weight if weight is not None else F.lit(1)
    return df.groupBy(*keys).agg(*[F.sum(F.when(cond, w).otherwise(F.lit(0))).alias(name)
                                   for name, cond in spec.items()])
