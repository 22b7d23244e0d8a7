"""Synthetic control over all events as one Spark job.

Window values of every (unit, day) are built once as arrays by a ROWS
window over the dense panel.  All events of one day share the same donor
pool (every unit untreated that day), so the solver groups by DAY: one
``applyInPandas`` group holds one array row per unit of that day (bounded by
the number of units, however many events fall on the day) and solves the
NNLS / simplex weights of each treated unit against the shared donors ->
long output (event, outcome, rel_day, y, y_synth).  The panel itself is never
shipped to a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .solvers import nnls, simplex_ls

SC_SCHEMA = ("unit string, event_day date, outcome string, rel_day int, y double, y_synth double, "
             "n_donors int, loss double")


def window_arrays(panel: DataFrame, outcomes, pre: int, post: int, unit: str = "unit", day: str = "day") -> DataFrame:
    """For every (unit, day) of the dense panel the outcome values of
    [day - pre, day + post) as arrays (one ROWS window pass).  Null when the
    pre-part leaves the spine or the window holds a null; near the spine end
    the array is shorter (post-period truncated, as in the reference)."""
    w = Window.partitionBy(unit).orderBy(day).rowsBetween(-pre, post - 1)
    wpre = Window.partitionBy(unit).orderBy(day).rowsBetween(-pre, 0)
    full_pre = F.count(F.lit(1)).over(wpre) == pre + 1
    return panel.select(F.col(unit).alias("series"), F.col(day).alias("event_day"),
                        *[F.when(full_pre & (F.count(F.col(o)).over(w) == F.count(F.lit(1)).over(w)),
                                 F.collect_list(F.col(o)).over(w)).alias(f"_a_{o}") for o in outcomes])


def event_members(panel: DataFrame, pre: int, treatment: str = "occ_protest", start: str | None = None,
                  unit: str = "unit", day: str = "day") -> DataFrame:
    """(unit, event_day, series) for each event (treatment = 1, full pre-window)
    and its donors (treatment = 0 on the event day; null is neither) plus the
    treated unit itself — an equi-join on the day."""
    p = panel.select(unit, day, treatment)
    ev = p.where(F.col(treatment) == 1).select(F.col(unit).alias("ev_unit"), F.col(day).alias("event_day"))
    if start is not None:
        ev = ev.where(F.date_sub("event_day", pre) >= F.to_date(F.lit(start)))
    donors = p.where(F.col(treatment) == 0).select(F.col(unit).alias("series"), F.col(day).alias("event_day"))
    return ev.join(donors, "event_day").where(F.col("series") != F.col("ev_unit")) \
             .unionByName(ev.withColumn("series", F.col("ev_unit")))


def event_panel(panel: DataFrame, outcomes, pre: int, post: int, treatment: str = "occ_protest",
                start: str | None = None, unit: str = "unit", day: str = "day") -> DataFrame:
    """Long rows (unit, event_day, series, outcome, rel_day, value) for
    callers that want one row per event, series and window day."""
    arr = window_arrays(panel, outcomes, pre, post, unit, day)
    m = event_members(panel, pre, treatment, start, unit, day).join(arr, ["series", "event_day"])
    long = m.unpivot(["ev_unit", "event_day", "series"], [f"_a_{o}" for o in outcomes], "outcome", "vals") \
            .where(F.col("vals").isNotNull())
    long = long.select("ev_unit", "event_day", "series", F.regexp_replace("outcome", "^_a_", "").alias("outcome"),
                       F.posexplode("vals").alias("pos", "value"))
    return long.select(F.col("ev_unit").alias(unit), "event_day", "series", "outcome",
                       (F.col("pos") - pre).cast("int").alias("rel_day"), "value")


def _spread(df: DataFrame, keys) -> DataFrame:
    """Hash-partition the solver input on its group keys into (at least) one
    partition per core.  The Python solve is CPU-bound while its input is
    small, so AQE would otherwise coalesce it into very few tasks; an explicit
    partition count is kept, and the grouped operator reuses this partitioning
    (no second shuffle)."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, 1) * 2
    return df.repartition(n, *keys)


def _ar_path(y: np.ndarray, npre: int, p: int, exog: np.ndarray | None = None, direct: bool = False) -> np.ndarray:
    """AR(p) with constant fitted by least squares on the pre-window.
    Recursive (default): in-sample one-step fits for the pre-period, then
    forecasts fed back.  ``exog``: an extra regressor known for every day (the
    donors' mean), used at the same day.  ``direct``: one regression per
    horizon h on the last p pre-period values (no feedback)."""
    out = np.full(len(y), np.nan)
    if npre <= p + 1:
        return out

    def row(hist, t):
        r = [1.0] + list(np.asarray(hist[t - p:t])[::-1])
        if exog is not None:
            r.append(exog[t])
        return np.array(r)

    rows = np.array([row(y, t) for t in range(p, npre)])
    beta = np.linalg.lstsq(rows, y[p:npre], rcond=None)[0]
    out[p:npre] = rows @ beta
    if direct:
        for h in range(1, len(y) - npre + 1):
            ts = list(range(p, npre - h + 1))
            if len(ts) < p + 2:
                break
            A = np.array([[1.0] + list(y[t - p:t][::-1]) + ([exog[t + h - 1]] if exog is not None else []) for t in ts])
            bh = np.linalg.lstsq(A, y[[t + h - 1 for t in ts]], rcond=None)[0]
            x = [1.0] + list(y[npre - p:npre][::-1]) + ([exog[npre + h - 1]] if exog is not None else [])
            out[npre + h - 1] = float(np.array(x) @ bh)
        return out
    hist = list(y[:npre])
    for t in range(npre, len(y)):
        v = float(row(np.array(hist), t) @ beta)
        out[t] = v
        hist.append(v)
    return out


def _solve_event(u, ed, series, mats, outcomes, pre, post, method, scale, unit, cut=None, ar_order=7):
    """NumPy solve of one event.  mats: outcome -> (n_series × (pre+post)) array."""
    series = np.asarray(series)
    t_idx = np.nonzero(series == u)[0]
    if len(t_idx) == 0 or mats[outcomes[0]].shape[1] == 0:
        return None
    ok = np.ones(len(series), dtype=bool)
    for o in outcomes:
        ok &= ~np.isnan(mats[o]).any(axis=1)
    if not ok[t_idx[0]]:
        return None
    d_idx = np.nonzero(ok & (series != u))[0]
    if len(d_idx) == 0 and not method.startswith("ar"):
        return None
    lo = 0 if cut is None else pre - cut           # shorter pre-period inside a longer window
    ys, Ds, pre_mask, rel, outs = [], [], [], [], []
    for o in outcomes:
        M = mats[o][:, lo:]
        npre = pre - lo
        y, D = M[t_idx[0]].copy(), M[d_idx].T.copy()
        if scale == "demean":
            y -= y[:npre].mean()
            D -= D[:npre].mean(axis=0)
        ys.append(y)
        Ds.append(D)
        pre_mask.append(np.arange(M.shape[1]) < npre)
        rel.append(np.arange(M.shape[1]) - npre)
        outs.append(np.full(M.shape[1], o, dtype=object))
    if method in ("ar", "arx", "ar_direct", "arx_direct"):
        ex = [D.mean(axis=1) if (method.startswith("arx") and D.shape[1]) else None for D in Ds]
        yh = np.concatenate([_ar_path(y, int(pm.sum()), ar_order, e, method.endswith("direct"))
                             for y, pm, e in zip(ys, pre_mask, ex)])
        y, pm = np.concatenate(ys), np.concatenate(pre_mask)
        rel, outs = np.concatenate(rel), np.concatenate(outs)
        ok_pre = pm & ~np.isnan(yh)
        loss = float(np.sqrt(np.mean((y[ok_pre] - yh[ok_pre]) ** 2))) if ok_pre.any() else float("nan")
        return pd.DataFrame({unit: u, "event_day": ed, "outcome": outs, "rel_day": rel.astype("int32"), "y": y,
                             "y_synth": yh, "n_donors": np.int32(0), "loss": loss})
    if scale == "logdiff":
        # fit on log1p-differences, then integrate back to levels from the first window day
        yh_all = []
        for y, D, pm in zip(ys, Ds, pre_mask):
            ly, lD = np.log1p(np.maximum(y, 0)), np.log1p(np.maximum(D, 0))
            dy, dD = np.diff(ly), np.diff(lD, axis=0)
            X = np.column_stack([np.ones(len(dy)), dD])
            pmd = pm[1:]
            w = nnls(X[pmd], dy[pmd])
            yh_all.append(np.expm1(ly[0] + np.concatenate([[0.0], np.cumsum(X @ w)])))
        yh = np.concatenate(yh_all)
        y, pm = np.concatenate(ys), np.concatenate(pre_mask)
        rel, outs = np.concatenate(rel), np.concatenate(outs)
        loss = float(np.sqrt(np.mean((y[pm] - yh[pm]) ** 2)))
        return pd.DataFrame({unit: u, "event_day": ed, "outcome": outs, "rel_day": rel.astype("int32"), "y": y,
                             "y_synth": yh, "n_donors": np.int32(len(d_idx)), "loss": loss})
    y, D = np.concatenate(ys), np.vstack(Ds)
    pm, rel, outs = np.concatenate(pre_mask), np.concatenate(rel), np.concatenate(outs)
    X = np.column_stack([np.ones(len(y)), D])
    if method == "simplex":
        w = np.concatenate([[0.0], simplex_ls(X[pm][:, 1:], y[pm])])
    else:
        w = nnls(X[pm], y[pm])
    yh = X @ w
    loss = float(np.sqrt(np.mean((y[pm] - yh[pm]) ** 2)))
    return pd.DataFrame({unit: u, "event_day": ed, "outcome": outs, "rel_day": rel.astype("int32"), "y": y,
                         "y_synth": yh, "n_donors": np.int32(len(d_idx)), "loss": loss})


def _day_solver(outcomes, pre, post, method, scale, unit, start_ok="_ev", configs=None):
    """One group per event DAY: the donors (untreated that day) are shared by
    every event of the day, so each unit-day window array is shipped once.
    With ``configs`` every configuration is solved on the same group (the data
    is not replicated per configuration)."""
    def solve_cfg(pdf, mats, n, ed, cfg):
        cut, sc, min_count, meth, order = None, scale, None, method, 7
        if cfg is not None:
            c = parse_config(cfg)
            cut = int(c["pre"])
            sc = None if c.get("scale", "none") == "none" else c["scale"]
            min_count = float(c["min"]) if "min" in c else None
            meth = c.get("method", method)
            order = int(c.get("order", 7))
        outs = []
        treat = pdf["_t"].to_numpy()
        evok = pdf[start_ok].to_numpy()
        free = treat == 0
        if cfg is not None and "donors" in c:
            free &= ~pdf[f"x_{c['donors']}"].to_numpy(bool)
        donors = np.nonzero(free)[0]
        series = pdf["series"].to_numpy()
        for ti in np.nonzero((treat == 1) & evok)[0]:
            if min_count is not None:
                # Skip events whose treated pre-period mean count is below the minimum
                lo = pre - (cut or pre)
                pre_vals = mats[outcomes[0]][ti, lo:pre]
                if np.isnan(pre_vals).any() or pre_vals.mean() < min_count:
                    continue
            idx = np.concatenate([[ti], donors])
            r = _solve_event(series[ti], ed, series[idx], {o: m[idx] for o, m in mats.items()}, outcomes,
                             pre, post, meth, sc, unit, cut, ar_order=order)
            if r is not None:
                if cfg is not None:
                    r["config"] = cfg
                outs.append(r)
        return outs

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ed = pdf["event_day"].iloc[0]
        lens = [len(v) for o in outcomes for v in pdf[f"_a_{o}"] if v is not None]
        n = min(lens) if lens else 0
        outs = []
        if n > pre:
            mats = {o: np.vstack([np.asarray(v[:n], dtype=float) if v is not None else np.full(n, np.nan)
                                  for v in pdf[f"_a_{o}"]]) for o in outcomes}
            for cfg in (configs or [None]):
                outs += solve_cfg(pdf, mats, n, ed, cfg)
        if outs:
            return pd.concat(outs, ignore_index=True)
        out = pd.DataFrame({c: pd.Series(dtype=t) for c, t in SC_DTYPES.items()}).rename(columns={"unit": unit})
        if configs:
            out["config"] = pd.Series(dtype=object)
        return out
    return solve


def parse_config(cfg: str) -> dict:
    """'pre=28|scale=none|min=5|method=ar|order=7' -> dict."""
    return dict(kv.split("=", 1) for kv in cfg.split("|"))


def day_members(panel: DataFrame, outcomes, pre: int, post: int, treatment: str = "occ_protest",
                start: str | None = None, unit: str = "unit", day: str = "day", extra=()) -> DataFrame:
    """One row per (day, unit) with the unit's window arrays, its treatment
    that day (null treatment rows are dropped: neither event nor donor) and
    whether it qualifies as an event (full pre-window after ``start``)."""
    arr = window_arrays(panel, outcomes, pre, post, unit, day)
    t = panel.select(F.col(unit).alias("series"), F.col(day).alias("event_day"), F.col(treatment).alias("_t"), *extra) \
             .where(F.col("_t").isNotNull())
    ok = F.lit(True) if start is None else (F.date_sub("event_day", pre) >= F.to_date(F.lit(start)))
    return t.join(arr, ["series", "event_day"]).withColumn("_ev", ok)


SC_DTYPES = {"unit": object, "event_day": object, "outcome": object, "rel_day": "int32", "y": float,
             "y_synth": float, "n_donors": "int32", "loss": float}


def synthetic_control(panel: DataFrame, outcomes, pre: int = 28, post: int = 7, treatment: str = "occ_protest",
                      start: str | None = None, method: str = "nnls", scale: str | None = None,
                      rolling: int = 1, unit: str = "unit", day: str = "day") -> DataFrame:
    """Per event, weights on the donors' stacked pre-period
    outcomes plus a non-negative constant (NNLS) or simplex weights; y_synth
    for every window day.  One group per event holds (donors + 1) rows of
    (pre + post)-long arrays."""
    outcomes = list(outcomes)
    p = panel
    if rolling > 1:
        w = Window.partitionBy(unit).orderBy(day).rowsBetween(-(rolling - 1), 0)
        p = p.withColumns({o: F.when(F.count(o).over(w) == rolling, F.avg(o).over(w)) for o in outcomes})
    m = _spread(day_members(p, outcomes, pre, post, treatment, start, unit, day), ["event_day"])
    return m.groupBy("event_day").applyInPandas(
        _day_solver(outcomes, pre, post, method, scale, unit), SC_SCHEMA.replace("unit string", f"{unit} string"))


def effect_table(sc: DataFrame, cumulative: bool = False, unit: str = "unit") -> DataFrame:
    """C19 input: effect = y − y_synth per event day, optionally cumulated from day 0."""
    e = sc.withColumn("effect", F.col("y") - F.col("y_synth"))
    if cumulative:
        w = Window.partitionBy(unit, "event_day", "outcome").orderBy("rel_day").rowsBetween(Window.unboundedPreceding, 0)
        e = e.where("rel_day >= 0").withColumn("effect", F.sum("effect").over(w))
    return e


def scaled_donor_mean(panel: DataFrame, outcome: str, pre: int, post: int, treatment: str = "occ_protest",
                      start: str | None = None, unit: str = "unit", day: str = "day") -> DataFrame:
    """C20 baseline: synthetic = donors' mean scaled by the ratio of the treated
    pre-period mean to the donors' pre-period mean.  Donors are shared by all
    events of a day, so the donor mean curve is computed once per day (an
    aggregate over untreated unit-days), then joined to the events."""
    m = day_members(panel, [outcome], pre, post, treatment, start, unit, day)
    vals = m.select("series", "event_day", "_t", "_ev", F.posexplode(f"_a_{outcome}").alias("pos", "value")) \
            .withColumn("rel_day", (F.col("pos") - pre).cast("int"))
    donor = vals.where(F.col("_t") == 0).groupBy("event_day", "rel_day").agg(
        F.avg("value").alias("donor_mean"), F.count(F.lit(1)).alias("n_donors"))
    ev = vals.where((F.col("_t") == 1) & F.col("_ev")).select(F.col("series").alias(unit), "event_day", "rel_day",
                                                               F.col("value").alias("y"))
    per_day = ev.join(donor, ["event_day", "rel_day"])
    w = Window.partitionBy(unit, "event_day")
    ratio = F.try_divide(F.avg(F.when(F.col("rel_day") < 0, F.col("y"))).over(w),
                         F.avg(F.when(F.col("rel_day") < 0, F.col("donor_mean"))).over(w))
    return per_day.where(F.col("n_donors") > 0).withColumn("y_synth", F.col("donor_mean") * ratio)

def sc_grid(panel: DataFrame, outcome: str, pres, post: int, scales=(None,), treatment: str = "occ_protest",
            start: str | None = None, unit: str = "unit", day: str = "day", min_counts=None,
            methods=("nnls",), orders=(7,)) -> DataFrame:
    """One job for a grid of configurations (pre-period,
    scaling, minimum count, method, lag order): window arrays are built once
    for the longest pre-period, each day group is shipped once and every
    configuration is solved on its slice inside the group.  Per config:
    pre-period fit RMSE, post-period bias and RMSE."""
    import itertools
    configs = []
    for p, sc, m, meth, o in itertools.product(pres, scales, min_counts or [None], methods, orders):
        c = f"pre={p}|scale={sc or 'none'}"
        c += f"|min={m}" if m is not None else ""
        c += f"|method={meth}" if meth != "nnls" else ""
        c += f"|order={o}" if meth.startswith("ar") else ""
        if c not in configs:
            configs.append(c)
    mx = max(pres)
    m = _spread(day_members(panel, [outcome], mx, post, treatment, start, unit, day), ["event_day"])
    schema = SC_SCHEMA.replace("unit string", f"{unit} string") + ", config string"
    res = m.groupBy("event_day").applyInPandas(
        _day_solver([outcome], mx, post, "nnls", None, unit, configs=configs), schema)
    eff = res.withColumn("err", F.col("y") - F.col("y_synth"))
    all_cfg = panel.sparkSession.createDataFrame([(c,) for c in configs], "config string")
    stats = eff.groupBy("config").agg(
        F.countDistinct(unit, "event_day").alias("events"),
        F.sqrt(F.avg(F.when(F.col("rel_day") < 0, F.col("err") * F.col("err")))).alias("pre_rmse"),
        F.avg(F.when(F.col("rel_day") >= 0, F.col("err"))).alias("post_bias"),
        F.sqrt(F.avg(F.when(F.col("rel_day") >= 0, F.col("err") * F.col("err")))).alias("post_rmse"))
    # every configuration appears, with 0 events when none qualifies
    return all_cfg.join(stats, "config", "left").fillna({"events": 0})


def donor_sets(panel: DataFrame, outcome: str, modes, pre: int, post: int, treatment: str = "occ_protest", scale: str | None = "demean",
               start: str | None = None, unit: str = "unit", day: str = "day") -> DataFrame:
    """Every event's effect under each donor set: donors are the untreated units of the day that ``x_{mode}`` does not
    exclude.  Window arrays are built and shipped once for all modes.  Rows (mode, unit, event_day, rel_day, effect)."""
    flags = [f"x_{m}" for m in modes]
    m = _spread(day_members(panel, [outcome], pre, post, treatment, start, unit, day, extra=flags), ["event_day"])
    configs = [f"pre={pre}|scale={scale or 'none'}|donors={x}" for x in modes]
    res = m.groupBy("event_day").applyInPandas(_day_solver([outcome], pre, post, "nnls", None, unit, configs=configs),
                                               SC_SCHEMA.replace("unit string", f"{unit} string") + ", config string")
    return res.select(F.regexp_extract("config", r"donors=(\w+)", 1).alias("mode"), unit, "event_day", "rel_day",
                      (F.col("y") - F.col("y_synth")).alias("effect"))
