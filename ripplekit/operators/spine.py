"""Calendar spine and gap filling.

After the spine every unit has exactly one row per day, so row offsets in
window frames equal day offsets ("dense spine pattern").
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _date_lit(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.to_date(F.lit(d))


def calendar_spine(units: DataFrame, start, end, unit: str = "unit", day: str = "day") -> DataFrame:
    """One row per (unit, day) for every day in [start, end].

    Generated per unit row with ``explode(sequence)`` — no join, no shuffle.
    """
    return units.select(F.col(unit), F.explode(F.sequence(_date_lit(start), _date_lit(end))).alias(day))


def fill_on_spine(spine: DataFrame, df: DataFrame, keys=("unit", "day"), fill: dict | None = None) -> DataFrame:
    """Left join ``df`` onto the spine and replace missing values.

    ``fill`` maps column -> fill value (0 for counts/flags, '' for text).
    Columns not listed keep their nulls.
    """
    keys = list(keys)
    out = spine.join(df, on=keys, how="left")
    if fill:
        out = out.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
                           for c in out.columns])
    return out


def front_zero_back_ffill(spine: DataFrame, obs: DataFrame, cols, keys=("unit", "day")) -> DataFrame:
    """Put sparse observations on the spine.

    Days up to a unit's last observation: observed value, missing day or null
    value -> 0.  Days after the last observation: the last observed row's
    value carried forward to the spine end.
    """
    unit, day = keys
    marked = obs.select(unit, day, *cols).withColumn("_obs", F.lit(True))
    j = spine.join(marked, on=[unit, day], how="left")
    run = Window.partitionBy(unit).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    last_obs = F.max(F.when(F.col("_obs"), F.col(day))).over(Window.partitionBy(unit))
    out = [F.col(unit), F.col(day)]
    for c in cols:
        carried = F.last(F.when(F.col("_obs"), F.coalesce(F.col(c), F.lit(0))), ignorenulls=True).over(run)
        out.append(F.when(last_obs.isNotNull() & (F.col(day) > last_obs), carried)
                   .otherwise(F.coalesce(F.col(c), F.lit(0))).alias(c))
    return j.select(*out)
