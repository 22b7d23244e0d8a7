"""Window operators on a dense (unit, day) spine.

All frames are ROWS frames; they equal day offsets only after the calendar
spine (operators.spine) has made every series gap-free.  Callers that chain
several of these should ``repartition(unit)`` once: hash partitioning on the
unit satisfies every window below (also those partitioned by (unit, segment)),
so the whole feature block runs after a single shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing


def _w(unit, day):
    return Window.partitionBy(unit).orderBy(day)


def shift(c, k: int, unit="unit", day="day") -> Column:
    """Value k rows earlier (k > 0) or |k| rows later (k < 0)."""
    c = F.col(c) if isinstance(c, str) else c
    if k == 0:
        return c
    return F.lag(c, k).over(_w(unit, day)) if k > 0 else F.lead(c, -k).over(_w(unit, day))


# W1 -------------------------------------------------------------------------
def lag_block(df: DataFrame, cols, lags, unit="unit", day="day", keep=None) -> DataFrame:
    """``{c}_lag{l}`` = value l days later (l <= 0 reads the past), the
    reference's ``shift(-lag)`` convention.  ``keep`` filters generated names
    (e.g. roles.design_lag) so pruned columns are never computed."""
    new = {}
    for c in cols:
        for lag in lags:
            name = f"{c}_lag{lag}"
            if keep is None or keep(name):
                new[name] = shift(c, -lag, unit, day)
    return df.withColumns(new)


# W2 / W3 --------------------------------------------------------------------
def lead_target(y, step: int, unit="unit", day="day") -> Column:
    return shift(y, -step, unit, day)


def cumulative_target(y, step: int, unit="unit", day="day") -> Column:
    """Sum of days t..t+step; null unless the frame is full and the row has at
    least ``step`` predecessors (the reference rolls the shifted series)."""
    if step < 0:
        raise ValueError("cumulative target needs step >= 0")
    y = F.col(y) if isinstance(y, str) else y
    fw = _w(unit, day).rowsBetween(0, step)
    full = F.count(y).over(fw) == step + 1
    rn = F.row_number().over(_w(unit, day))
    return F.when(full & (rn > step), F.sum(y).over(fw))


# W4 -------------------------------------------------------------------------
def diff(y, k: int = 1, unit="unit", day="day") -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return y - F.lag(y, k).over(_w(unit, day))


# W5 -------------------------------------------------------------------------
def ewm_mean(df: DataFrame, col: str, span: float, out: str, unit="unit", day="day") -> DataFrame:
    """Bias-adjusted exponential moving mean (pandas ``ewm(span).mean()``,
    adjust=True, nulls skipped but counted in the decay).

    S_i = sum_j x_j q^(i-j) is computed exactly with plain running sums: the
    series is cut into segments short enough that q^(-offset) cannot overflow,
    each segment is summed relative to its own start, and the previous
    segment's end value is carried in with weight q^(distance).  Terms from two
    or more segments back are below q^L ~ e^-600 relative and vanish in double
    precision.  Same for the weight denominator.
    """
    alpha = 2.0 / (span + 1.0)
    q = 1.0 - alpha
    lnq = math.log(q)
    seg_len = max(1, int(600.0 / -lnq))
    x = F.col(col)
    tmp = f"__{out}"
    w = _w(unit, day)
    d = df.withColumn(f"{tmp}_i", F.row_number().over(w) - 1)
    d = d.withColumn(f"{tmp}_s", F.floor(F.col(f"{tmp}_i") / seg_len))
    o = F.col(f"{tmp}_i") - F.col(f"{tmp}_s") * seg_len          # offset inside segment
    ws = Window.partitionBy(unit, f"{tmp}_s").orderBy(day).rowsBetween(UNB, 0)
    num_local = F.sum(F.coalesce(x, F.lit(0.0)) * F.exp(-o * lnq)).over(ws) * F.exp(o * lnq)
    den_local = F.sum(F.when(x.isNotNull(), F.exp(-o * lnq)).otherwise(0.0)).over(ws) * F.exp(o * lnq)
    d = d.withColumns({f"{tmp}_nl": num_local, f"{tmp}_dl": den_local,
                       f"{tmp}_end": o == seg_len - 1})
    prev = w.rowsBetween(UNB, -1)
    carry_n = F.last(F.when(F.col(f"{tmp}_end"), F.col(f"{tmp}_nl")), ignorenulls=True).over(prev)
    carry_d = F.last(F.when(F.col(f"{tmp}_end"), F.col(f"{tmp}_dl")), ignorenulls=True).over(prev)
    decay = F.exp((o + 1) * lnq)
    num = F.col(f"{tmp}_nl") + F.coalesce(carry_n, F.lit(0.0)) * decay
    den = F.col(f"{tmp}_dl") + F.coalesce(carry_d, F.lit(0.0)) * decay
    d = d.withColumn(out, F.when(den > 0, num / den))
    return d.drop(f"{tmp}_i", f"{tmp}_s", f"{tmp}_nl", f"{tmp}_dl", f"{tmp}_end")


# W6 -------------------------------------------------------------------------
def gaussian_weights(n: int = 90, std: float = 30.0) -> list[float]:
    c = (n - 1) / 2.0
    return [math.exp(-0.5 * ((j - c) / std) ** 2) for j in range(n)]


def centred_frame(n: int):
    """Row frame of a centred rolling window of length n (pandas alignment)."""
    return -(n // 2), (n - 1) // 2


def deseason(df: DataFrame, cols, n: int = 90, std: float = 30.0, unit="unit", day="day") -> DataFrame:
    """``{c}_seasonal`` = centred Gaussian-weighted mean over n rows (null unless
    all n values exist), ``{c}_resid`` = c - seasonal; c itself is dropped."""
    wts = gaussian_weights(n, std)
    total = sum(wts)
    lo, hi = centred_frame(n)
    fr = _w(unit, day).rowsBetween(lo, hi)
    warr = F.array(*[F.lit(v) for v in wts])
    new = {}
    for c in cols:
        vals = F.collect_list(F.col(c)).over(fr)
        full = F.count(F.col(c)).over(fr) == n
        s = F.aggregate(F.zip_with(vals, warr, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        seas = F.when(full, s / total)
        new[f"{c}_seasonal"] = seas
        new[f"{c}_resid"] = F.col(c) - seas
    return df.withColumns(new).drop(*cols)


# W7 / W8 --------------------------------------------------------------------
def rolling_mean(y, n: int, unit="unit", day="day", centred: bool = False) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    lo, hi = centred_frame(n) if centred else (-(n - 1), 0)
    fr = _w(unit, day).rowsBetween(lo, hi)
    return F.when(F.count(y).over(fr) == n, F.avg(y).over(fr))


def rolling_std(y, n: int, unit="unit", day="day", centred: bool = False) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    lo, hi = centred_frame(n) if centred else (-(n - 1), 0)
    fr = _w(unit, day).rowsBetween(lo, hi)
    return F.when(F.count(y).over(fr) == n, F.stddev_samp(y).over(fr))


# W10 ------------------------------------------------------------------------
def running_sum(y, part, order) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.sum(y).over(Window.partitionBy(*part).orderBy(order).rowsBetween(UNB, 0))


# W12 / W13 / W14 ------------------------------------------------------------
def zscore(y, part=(), sample: bool = True) -> Column:
    """Standardise within ``part`` groups.  With ``part=()`` the window is a
    single partition: for whole-table moments compute the two scalars with
    one aggregate instead (as the ``zscore`` plan does)."""
    y = F.col(y) if isinstance(y, str) else y
    w = Window.partitionBy(*part)
    sd = F.stddev_samp(y) if sample else F.stddev_pop(y)
    return F.try_divide(y - F.avg(y).over(w), sd.over(w))   # constant group -> null, not an error


def minmax(y, part=()) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    w = Window.partitionBy(*part)
    lo, hi = F.min(y).over(w), F.max(y).over(w)
    return F.try_divide(y - lo, hi - lo)


def share_of(y, part=(), how: str = "sum") -> Column:
    y = F.col(y) if isinstance(y, str) else y
    w = Window.partitionBy(*part)
    agg = F.sum(y) if how == "sum" else F.max(y)
    return F.try_divide(y, agg.over(w))


def group_mean(y, part) -> Column:
    """Window form; for groups that can be hot use
    ``aggregates.with_group_stats`` (aggregate + join)."""
    y = F.col(y) if isinstance(y, str) else y
    return F.avg(y).over(Window.partitionBy(*part))


# W18 ------------------------------------------------------------------------
def change_vs_preceding(y, window: int, gap: int = 3, unit="unit", day="day") -> Column:
    """x minus the mean of days x-window .. x-gap (null unless all present)."""
    y = F.col(y) if isinstance(y, str) else y
    fr = _w(unit, day).rowsBetween(-window, -gap)
    n = window - gap + 1
    return F.when(F.count(y).over(fr) == n, y - F.avg(y).over(fr))


# W20 ------------------------------------------------------------------------
def logdiff(y, unit="unit", day="day") -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.log1p(y) - F.lag(F.log1p(y), 1).over(_w(unit, day))


def logdiff_inverse_from_start(d, x0, unit="unit", day="day") -> Column:
    """exp(log1p(x0) + running sum of d) - 1, d of the first row ignored."""
    d = F.col(d) if isinstance(d, str) else d
    x0 = F.col(x0) if isinstance(x0, str) else x0
    cs = F.sum(F.coalesce(d, F.lit(0.0))).over(_w(unit, day).rowsBetween(UNB, 0))
    return F.expm1(F.log1p(x0) + cs)


def logdiff_inverse_from_end(d, x_end, unit="unit", day="day") -> Column:
    """exp(log1p(x_end) - sum of d over the following rows) - 1."""
    d = F.col(d) if isinstance(d, str) else d
    x_end = F.col(x_end) if isinstance(x_end, str) else x_end
    after = F.sum(d).over(_w(unit, day).rowsBetween(1, UNF))
    return F.expm1(F.log1p(x_end) - F.coalesce(after, F.lit(0.0)))


# W22 ------------------------------------------------------------------------
def historic_mean(y, unit="unit", day="day") -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.avg(y).over(_w(unit, day).rowsBetween(UNB, -1))


# W25 ------------------------------------------------------------------------
def interpolate_linear(y, x, part=(), order=None) -> Column:
    """Linear interpolation of sparse points (y at position x) onto the rows
    between them; exact points are kept, edges stay null."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    base = Window.partitionBy(*part).orderBy(order if order is not None else x)
    prev_w, next_w = base.rowsBetween(UNB, 0), base.rowsBetween(0, UNF)
    px = F.last(F.when(y.isNotNull(), x), ignorenulls=True).over(prev_w)
    py = F.last(y, ignorenulls=True).over(prev_w)
    nx = F.first(F.when(y.isNotNull(), x), ignorenulls=True).over(next_w)
    ny = F.first(y, ignorenulls=True).over(next_w)
    return F.when(y.isNotNull(), y).when(nx == px, py).otherwise(
        py + (ny - py) * (x - px) / (nx - px))
