"""Instrumental variables from one cross-product matrix.

All k-class estimators (2SLS κ=1, LIML κ=min eigenvalue) need only the Gram
of [X, w, Z, y]: one Spark aggregate, then k×k algebra on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_ppf
from ..operators.aggregates import correlation, quotient
from .gram import collect_gram

IV_SCHEMA = ("method string, predictor string, coef double, se double, stat double, p double, ci_lower double, "
             "ci_upper double, kappa double, n long")


def k_class_from_gram(G, n: int, exog, endog, instruments, methods=("2sls", "liml"), level: float = 0.95):
    """Rows of the k-class estimators from the Gram of [exog, endog, instruments, y], and what a residual pass needs."""
    names = list(exog) + list(endog)
    nx, ne, nz = len(exog), len(endog), len(instruments)
    ix, ie, iz = list(range(nx)), list(range(nx, nx + ne)), list(range(nx + ne, nx + ne + nz))
    iy = nx + ne + nz
    R, Zf = ix + ie, ix + iz          # regressors, all exogenous
    sub = lambda a, b: G[np.ix_(a, b)]
    Qinv = np.linalg.pinv(sub(Zf, Zf))
    RR, Ry = sub(R, R), G[R, iy]
    ZR, Zy = sub(Zf, R), G[Zf, iy]
    RPR, RPy = ZR.T @ Qinv @ ZR, ZR.T @ Qinv @ Zy
    RMR, RMy = RR - RPR, Ry - RPy
    Wi = [iy] + ie                    # endogenous block incl. outcome
    WW = sub(Wi, Wi)
    WMz = WW - sub(Wi, Zf) @ Qinv @ sub(Zf, Wi)
    WMx = WW - sub(Wi, ix) @ np.linalg.pinv(sub(ix, ix)) @ sub(ix, Wi)
    kappa_liml = float(np.min(np.real(np.linalg.eigvals(np.linalg.solve(WMz, WMx)))))
    q = norm_ppf(0.5 + level / 2)
    rows, tsls = {}, None
    for m in methods:
        kappa = 1.0 if m == "2sls" else kappa_liml
        Ainv = np.linalg.pinv(RR - kappa * RMR)
        beta = Ainv @ (Ry - kappa * RMy)
        rss = G[iy, iy] - 2 * beta @ Ry + beta @ RR @ beta
        rows[m] = _coef_rows(m, names, beta, rss / max(n - len(R), 1) * Ainv, kappa, n, q)
        if m == "2sls":
            Ze = Zy - ZR @ beta
            tsls = (beta, np.linalg.pinv(RPR) @ ZR.T @ Qinv, float(n * (Ze @ Qinv @ Ze) / rss) if rss > 0 else float("nan"))
    return rows, tsls, q


def _coef_rows(method, names, beta, cov, kappa, n, q):
    out = []
    for i, name in enumerate(names):
        se = math.sqrt(max(cov[i, i], 0.0))
        z = beta[i] / se if se > 0 else float("nan")
        p = math.erfc(abs(z) / math.sqrt(2)) if se > 0 else None
        out.append((method, name, float(beta[i]), float(se), float(z), None if p is None else float(p),
                    float(beta[i] - q * se), float(beta[i] + q * se), float(kappa), int(n)))
    return out


def k_class(df: DataFrame, y: str, endog, exog, instruments, methods=("2sls", "liml"), level: float = 0.95,
            intercept: bool = True, robust: bool = False) -> DataFrame:
    endog, exog, instruments = list(endog), list(exog), list(instruments)
    d = df.select(*endog, *exog, *instruments, y).dropna()
    if intercept:
        d = d.withColumn("const", F.lit(1.0))
        exog = ["const"] + exog
    if robust:
        d = d.persist()  # read again by the residual pass
    (n, _, G), = collect_gram(d, exog + endog + instruments + [y]).values()
    by_method, tsls, q = k_class_from_gram(G, n, exog, endog, instruments, methods, level)
    rows = []
    for m in methods:
        rows += by_method[m]
        if m != "2sls":
            continue
        beta, H, sargan = tsls
        if robust:
            # HC0 sandwich for 2SLS: one more block-Gram pass over the
            # instruments weighted by the squared residuals
            from .gram import dot
            e = F.col(y) - dot(exog + endog, beta)
            (_, _, Om), = collect_gram(d.withColumn("_e2", e * e), exog + instruments, (), F.col("_e2")).values()
            rows += _coef_rows("2sls_robust", exog + endog, beta, H @ Om @ H.T, 1.0, n, q)
        if len(instruments) > len(endog):
            # Sargan over-identification test from the same Gram: n · e'P_Z e / e'e
            from ..functions.stats import chi2_sf
            df_over = len(instruments) - len(endog)
            rows.append(("sargan", "overid", sargan, None, None, float(chi2_sf(sargan, df_over)), None, None,
                         float(df_over), int(n)))
    if robust:
        d.unpersist()
    return df.sparkSession.createDataFrame(rows, IV_SCHEMA)


def first_stage_f(df: DataFrame, treatment: str, instruments) -> DataFrame:
    """Single-instrument F = r²(n-2)/(1-r²) per instrument, one aggregate; NaN for a constant treatment or instrument."""
    long = df.select(treatment, *instruments).unpivot([treatment], list(instruments), "instrument", "z") \
             .where(F.col("z").isNotNull() & F.col(treatment).isNotNull())
    r = long.groupBy("instrument").agg(correlation("z", treatment).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("instrument", "n", quotient(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")).alias("f"))


def wald_binary(df: DataFrame, y: str, w: str, z) -> DataFrame:
    """Wald estimator with a binary instrument from four conditional means."""
    z = F.col(z) if isinstance(z, str) else z
    d = df.select(F.col(y).alias("y"), F.col(w).alias("w"), z.cast("int").alias("z")).dropna()
    a = d.agg(F.avg(F.when(F.col("z") == 1, F.col("y"))).alias("y1"), F.avg(F.when(F.col("z") == 0, F.col("y"))).alias("y0"),
              F.avg(F.when(F.col("z") == 1, F.col("w"))).alias("w1"), F.avg(F.when(F.col("z") == 0, F.col("w"))).alias("w0"),
              F.count(F.lit(1)).alias("n"))
    return a.select("y1", "y0", "w1", "w0", "n",
                    F.try_divide(F.col("y1") - F.col("y0"), F.col("w1") - F.col("w0")).alias("wald"))


def gmm_two_step(df: DataFrame, y: str, endog, exog, instruments, intercept: bool = True) -> DataFrame:
    """Efficient two-step GMM.  Step 1 = 2SLS from the Gram; step 2
    weights the moments with Ω = Σ e_i² z_i z_i' — one more block-Gram pass
    with weight e² (residuals from broadcast β); Hansen J from the same sums."""
    import math as _m

    from ..functions.stats import chi2_sf
    endog, exog, instruments = list(endog), list(exog), list(instruments)
    d = df.select(*(endog + exog + instruments + [y])).dropna()
    if intercept:
        d = d.withColumn("const", F.lit(1.0))
        exog = ["const"] + exog
    d = d.persist()
    R, Z = exog + endog, exog + instruments
    order = R + instruments + [y]
    (n, _, G), = collect_gram(d, order).values()
    k, nzf = len(R), len(Z)
    idx = {c: i for i, c in enumerate(order)}
    ri, zi, yi = [idx[c] for c in R], [idx[c] for c in Z], idx[y]
    ZR, ZZ, Zy = G[np.ix_(zi, ri)], G[np.ix_(zi, zi)], G[zi, yi]
    W1 = np.linalg.pinv(ZZ)
    b1 = np.linalg.pinv(ZR.T @ W1 @ ZR) @ ZR.T @ W1 @ Zy
    from .gram import dot
    e = F.col(y) - dot(R, b1)
    (_, _, Om), = collect_gram(d.withColumn("_e2", e * e), Z, (), F.col("_e2")).values()
    W2 = np.linalg.pinv(Om)
    A = np.linalg.pinv(ZR.T @ W2 @ ZR)
    b2 = A @ ZR.T @ W2 @ Zy
    gbar = Zy - ZR @ b2
    J = float(gbar @ W2 @ gbar)
    rows = []
    for i, c in enumerate(R):
        se = _m.sqrt(max(A[i, i], 0.0))
        z = b2[i] / se if se > 0 else float("nan")
        rows.append(("gmm", c, float(b2[i]), float(se), float(z), float(_m.erfc(abs(z) / _m.sqrt(2))) if se > 0 else None,
                     float(b2[i] - 1.959964 * se), float(b2[i] + 1.959964 * se), None, int(n)))
    if nzf > k:
        rows.append(("hansen_j", "overid", J, None, None, float(chi2_sf(J, nzf - k)), None, None, float(nzf - k), int(n)))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, IV_SCHEMA)
