"""Join operators.

Range and offset joins are rewritten as equi-joins on generated keys
(``explode(sequence(...))``), so Spark can use hash/sort-merge joins instead
of nested loops, and AQE's skew handling applies to the generated key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(frames, keys=("unit", "day"), how: str = "full", fill: dict | None = None) -> DataFrame:
    """Index-aligned column concat = chain of outer equi-joins on the keys,
    optional fill of the gaps."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on=list(keys), how=how)
    if fill:
        out = out.fillna(fill)
    return out


def window_rows(events: DataFrame, pre: int, post: int, day: str = "day", out: str = "win_day",
                rel: str = "rel_day") -> DataFrame:
    """J8 helper: one row per event and day of [day-pre, day+post)."""
    return events.withColumn(rel, F.explode(F.sequence(F.lit(-pre), F.lit(post - 1)))) \
                 .withColumn(out, F.date_add(F.col(day), F.col(rel)))


def event_window(events: DataFrame, panel: DataFrame, pre: int, post: int, unit: str = "unit",
                 day: str = "day", cols=()) -> DataFrame:
    """Panel rows in [event day - pre, event day + post) of the event's unit,
    as an equi-join on (unit, day) of the exploded window."""
    w = window_rows(events.select(F.col(unit), F.col(day).alias("event_day"), *[c for c in events.columns
                                                                                if c not in (unit, day)]),
                    pre, post, day="event_day")
    p = panel.select(F.col(unit), F.col(day).alias("win_day"), *cols)
    return w.join(p, on=[unit, "win_day"], how="inner")


def donor_pool(events: DataFrame, panel: DataFrame, treat: str = "occ_protest", unit: str = "unit",
               day: str = "day") -> DataFrame:
    """For each event (unit, day) every other unit untreated on that day.
    Null treatment counts as 'not a donor'.  Events without donors vanish
    (inner join)."""
    e = events.select(F.col(unit).alias("event_unit"), F.col(day))
    d = panel.where(F.col(treat) == 0).select(F.col(unit).alias("donor"), F.col(day))
    return e.join(d, on=day, how="inner").where(F.col("donor") != F.col("event_unit"))


def contaminated(events: DataFrame, indicator: Column, before: int, after: int, include_day0: bool = False,
                 unit: str = "unit", day: str = "day") -> DataFrame:
    """J9 helper: (unit, day) keys of events that have another flagged day of the
    same unit inside [-before, -1] ∪ [1, after] (and day 0 if requested)."""
    offs = [k for k in range(-before, after + 1) if k != 0 or include_day0]
    flagged = events.where(indicator).select(unit, F.col(day).alias("_fd"))
    keys = flagged.withColumn("_k", F.explode(F.array(*[F.lit(-k) for k in offs]))) \
                  .select(unit, F.date_add("_fd", F.col("_k")).alias(day)).distinct()
    return keys


def exclude_contaminated(events: DataFrame, panel: DataFrame, indicator: Column, before: int, after: int,
                         include_day0: bool = False, unit="unit", day="day") -> DataFrame:
    """Events whose unit has no flagged day inside the exclusion window."""
    bad = contaminated(panel, indicator, before, after, include_day0, unit, day)
    return events.join(bad, on=[unit, day], how="left_anti")


# The exclusion modes.
EXCLUSION_MODES = ("none", "acled", "official", "all", "regions")


def exclusion_flags(panel: DataFrame, acled: str, official: str, before: int, after: int, no_official: Column | None = None,
                    unit: str = "unit", day: str = "day") -> DataFrame:
    """J9 on a dense spine: ``x_{mode}`` says whether a unit-day is contaminated under each of the five modes: an event of
    the mode's sources in the days [-before, -1] or [1, after]; a missing official count excludes; ``regions`` excludes the
    units that ``no_official`` marks.  One window pass for all modes."""
    flags = {"acled": F.coalesce(F.col(acled), F.lit(0)) > 0, "official": F.coalesce(F.col(official) > 0, F.lit(True))}
    flags["all"] = flags["acled"] | flags["official"]
    w = Window.partitionBy(unit).orderBy(day)
    out = {"x_none": F.lit(False), "x_regions": F.lit(False) if no_official is None else F.coalesce(no_official, F.lit(False))}
    for mode, flag in flags.items():
        near = [F.max(flag).over(w.rowsBetween(*span)) for span in ((-before, -1), (1, after)) if span[0] <= span[1]]
        hit = F.lit(False)
        for x in near:
            hit = hit | F.coalesce(x, F.lit(False))
        out[f"x_{mode}"] = hit
    return panel.withColumns(out)


def offset_lookup(keys: DataFrame, series: DataFrame, offsets, value: str, unit="unit", day="day") -> DataFrame:
    """Value at (unit, day + k) for every k, as one equi-join."""
    k = keys.select(unit, day).withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))) \
            .withColumn("_d", F.date_add(F.col(day), F.col("offset")))
    s = series.select(F.col(unit), F.col(day).alias("_d"), F.col(value))
    return k.join(s, on=[unit, "_d"], how="left").drop("_d")


def climatology(df: DataFrame, value: str, years: int = 10, unit="unit", day="day") -> Column:
    """Mean of the same month and day over the ``years`` prior years — a
    RANGE window on year instead of a self join."""
    w = Window.partitionBy(unit, F.month(day), F.dayofmonth(day)).orderBy(F.year(day)) \
              .rangeBetween(-years, -1)
    return F.avg(F.col(value)).over(w)


def min_from_start_year(df: DataFrame, value: str, year: str, part) -> DataFrame:
    """For every start year s, min of ``value`` over rows with year >= s —
    a running min over years descending (no theta join)."""
    per_year = df.groupBy(*part, year).agg(F.min(value).alias("_m"))
    w = Window.partitionBy(*part).orderBy(F.col(year).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return per_year.select(*part, F.col(year).alias("start_year"), F.min("_m").over(w).alias("min_" + value))


def exclude_neighbours(pairs: DataFrame, edges: DataFrame, a: str = "event_unit", b: str = "donor") -> DataFrame:
    """Drop (a, b) pairs that are adjacent (edge table unit -> neighbour)."""
    e = edges.select(F.col("unit").alias(a), F.col("neighbour").alias(b))
    return pairs.join(e, on=[a, b], how="left_anti")


def substring_lookup(left: DataFrame, key: str, text: str, dim: DataFrame, name: str, order: str) -> DataFrame:
    """First dimension row (by ``order``) whose ``name`` occurs in ``text``.
    ``dim`` must be a bounded dimension (it is broadcast to a nested-loop join)."""
    j = left.join(F.broadcast(dim), F.instr(F.col(text), F.col(name)) > 0, "left")
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
