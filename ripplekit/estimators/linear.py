"""OLS with HC3 errors (C1-C4), multiple-testing adjustment (C5), grouped
runs for many targets / steps / shifts in one pass (C26, C39)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import norm_ppf, t_cdf
from .gram import collect_gram

COEF_SCHEMA = ("predictor string, coef double, se double, stat double, p double, ci_lower double, "
               "ci_upper double, n long")


def _prep(df, y, xs, group, intercept, weight=None):
    cols = list(xs) + [y] + ([weight] if weight else [])
    d = df.select(*group, *cols).dropna(subset=cols)
    if intercept:
        d = d.withColumn("const", F.lit(1.0))
        xs = ["const"] + list(xs)
    return d, list(xs)


def ols(df: DataFrame, y: str, xs, group=(), intercept: bool = True, cov: str = "HC3", level: float = 0.95,
        weight: str | None = None, max_groups: int = 100_000) -> DataFrame:
    """OLS / WLS per group.

    Pass 1: Gram of [X, y] per group (one aggregate); β = (X'X)⁻¹X'y on the
    driver.  Pass 2 (HC3/HC0): Σ w² e²/(1-h)^p x x' per group, where e and the
    leverage h come from each group's β and (X'X)⁻¹ shipped as a broadcast
    table of #groups rows (size checked against ``max_groups``) — again one
    aggregate, whatever the number of groups.  HC errors use the normal
    reference distribution (the reference reports z); ``cov='nonrobust'``
    uses t with n-k dof."""
    group = list(group)
    d, X = _prep(df, y, xs, group, intercept, weight)
    # the design is read by two passes (Gram, then HC weights): keep it in
    # executor memory/disk between them (recomputable from lineage on loss)
    d = d.persist()
    w = F.col(weight) if weight else None
    cols = X + [y]
    k = len(X)
    G = collect_gram(d, cols, group, w)
    if len(G) > max_groups:
        raise ValueError(f"{len(G)} groups exceed max_groups={max_groups}")
    params = {}
    for g, (n, _, m) in G.items():
        xtx, xty = m[:k, :k], m[:k, k]
        inv = np.linalg.pinv(xtx)
        params[g] = (n, inv, inv @ xty, m)
    rows = []
    spark = df.sparkSession
    if cov in ("HC3", "HC0"):
        power = 2.0 if cov == "HC3" else 0.0
        d2 = d.mapInPandas(_hc_weights(spark, params, group, X, y, weight, power),
                           T.StructType(list(d.schema.fields) + [T.StructField("_hw", T.DoubleType())]))
        meat = collect_gram(d2, X, group, F.col("_hw"))
        for g, (n, inv, beta, m) in params.items():
            covm = inv @ meat[g][2] @ inv
            rows += _coef_rows(g, X, beta, covm, n, level, dist="normal")
    else:
        for g, (n, inv, beta, m) in params.items():
            xtx, xty, yy = m[:k, :k], m[:k, k], m[k, k]
            rss = yy - 2 * beta @ xty + beta @ xtx @ beta
            s2 = rss / max(n - k, 1)
            rows += _coef_rows(g, X, beta, s2 * inv, n, level, dist="t", dof=n - k)
    schema = ", ".join([f"{c} {dict(d.dtypes)[c]}" for c in group] + [COEF_SCHEMA])
    d.unpersist()
    return spark.createDataFrame(rows, schema)


def _hc_weights(spark, params, group, X, y, weight, power):
    """Arrow-batched residuals and leverages: w_i = (w e_i)² / (1 - h_i)^power
    with h_i = w x_i (X'WX)⁻¹ x_i'.  The per-group β and inverse (#groups × k²
    numbers, checked by ``max_groups``) travel as a broadcast variable."""
    bc = spark.sparkContext.broadcast({g: (inv, beta) for g, (n, inv, beta, m) in params.items()})

    def fn(batches):
        import numpy as np
        par = bc.value
        for pdf in batches:
            out = np.zeros(len(pdf))
            if group:
                parts = pdf.groupby(group, sort=False, dropna=False).indices.items()
            else:
                parts = [((), np.arange(len(pdf)))]
            for g, rows in parts:
                g = g if isinstance(g, tuple) else (g,)
                if g not in par:
                    continue
                inv, beta = par[g]
                sub = pdf.iloc[rows]
                Xm = sub[X].to_numpy(dtype=float)
                e = sub[y].to_numpy(dtype=float) - Xm @ beta
                h = np.einsum("ij,jk,ik->i", Xm, inv, Xm)
                if weight:
                    wv = sub[weight].to_numpy(dtype=float)
                    h, e = h * wv, e * wv
                out[rows] = e * e / np.power(1.0 - h, power)
            yield pdf.assign(_hw=out)
    return fn


def _coef_rows(g, X, beta, covm, n, level, dist="normal", dof=None):
    out = []
    for i, name in enumerate(X):
        se = float(math.sqrt(max(covm[i, i], 0.0)))
        stat = float(beta[i] / se) if se > 0 else float("nan")
        if dist == "normal":
            p = math.erfc(abs(stat) / math.sqrt(2)) if se > 0 else None
            q = norm_ppf(0.5 + level / 2)
        else:
            from ..functions.stats import t_ppf
            p = 2 * (1 - t_cdf(abs(stat), dof)) if se > 0 else None
            q = t_ppf(0.5 + level / 2, dof)
        out.append((*g, name, float(beta[i]), se, stat, p, float(beta[i] - q * se), float(beta[i] + q * se), int(n)))
    return out


def bh_by(df: DataFrame, p: str, part=(), method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg (bh) / Benjamini-Yekutieli (by) adjusted p-values:
    p·m/rank (× Σ1/i for BY), running min from the largest rank, capped at 1."""
    w_all = Window.partitionBy(*part)
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(p)))
    m = F.count(F.lit(1)).over(w_all)
    d = df.withColumn("_rank", rank).withColumn("_m", m)
    c = F.lit(1.0)
    if method == "by":
        # harmonic number H_m via log approximation is not exact; use a running sum over ranks
        d = d.withColumn("_inv", 1.0 / F.col("_rank"))
        c = F.sum("_inv").over(w_all)
    raw = F.col(p) * F.col("_m") / F.col("_rank") * c
    d = d.withColumn("_raw", raw)
    run = F.min("_raw").over(Window.partitionBy(*part).orderBy(F.col("_rank").desc())
                             .rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(f"{p}_{method}", F.least(F.lit(1.0), run)).drop("_rank", "_m", "_raw", "_inv")
