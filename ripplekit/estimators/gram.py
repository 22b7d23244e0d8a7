"""Gram pattern: every linear method only needs cross-product sums.

``gram`` computes sum(x_i * x_j) for all i <= j of the given columns (plus
the row count) per group in ONE hash aggregate with map-side combine; the
k×k matrices (k is tens) are the only thing that reaches the driver, and
their number is the number of groups (targets × steps, shifts, folds ...),
never the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_exprs(cols, weight: Column | None = None) -> list[Column]:
    w = weight if weight is not None else F.lit(1.0)
    out = [F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_sw")]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            out.append(F.sum(F.col(a) * F.col(cols[j]) * w).alias(f"_g{i}_{j}"))
    return out


def gram(df: DataFrame, cols, group=(), weight: Column | None = None) -> DataFrame:
    return df.groupBy(*group).agg(*gram_exprs(list(cols), weight))


def gram_blocks(df: DataFrame, cols, group=(), weight: Column | None = None) -> DataFrame:
    """Block Gram: each task multiplies its Arrow batches with NumPy (BLAS)
    and emits only the upper triangle of its partial X'X per group; a small
    grouped sum combines the partials.  Shuffle volume = #tasks × #groups × k²,
    independent of the row count; no k²-column SQL aggregate."""
    import pandas as pd
    group, cols = list(group), list(cols)
    k = len(cols)
    sel = df.select(*group, *[F.col(c).cast("double").alias(c) for c in cols],
                    (weight if weight is not None else F.lit(1.0)).cast("double").alias("_gw"))
    gtypes = [f"{g} {dict(df.dtypes)[g]}" for g in group]
    schema = ", ".join(gtypes + ["i int", "j int", "v double"])
    iu, ju = np.triu_indices(k)

    def fn(batches):
        acc = {}
        for pdf in batches:
            parts = pdf.groupby(group, sort=False, dropna=False) if group else [((), pdf)]
            for g, sub in parts:
                g = g if isinstance(g, tuple) else (g,)
                X = sub[cols].to_numpy(dtype=float)
                w = sub["_gw"].to_numpy(dtype=float)
                m = (X * w[:, None]).T @ X
                n, sw = len(sub), float(w.sum())
                if g in acc:
                    a = acc[g]
                    acc[g] = (a[0] + n, a[1] + sw, a[2] + m)
                else:
                    acc[g] = (n, sw, m)
        rows = []
        for g, (n, sw, m) in acc.items():
            rows.append(pd.DataFrame({**{c: [v] * (len(iu) + 2) for c, v in zip(group, g)},
                                      "i": np.concatenate([[-1, -2], iu]).astype("int32"),
                                      "j": np.concatenate([[-1, -2], ju]).astype("int32"),
                                      "v": np.concatenate([[float(n), sw], m[iu, ju]])}))
        if rows:
            yield pd.concat(rows, ignore_index=True)

    return sel.mapInPandas(fn, schema).groupBy(*group, "i", "j").agg(F.sum("v").alias("v"))


def collect_gram(df: DataFrame, cols, group=(), weight: Column | None = None) -> dict:
    """{group tuple: (n, sum_w, k×k matrix)} — only #groups × k² numbers reach the driver."""
    k = len(cols)
    res: dict = {}
    for r in gram_blocks(df, cols, group, weight).collect():
        g = tuple(r[c] for c in group)
        n, sw, m = res.get(g, (0, 0.0, np.zeros((k, k))))
        if r["i"] == -1:
            n = int(r["v"])
        elif r["i"] == -2:
            sw = r["v"]
        else:
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
        res[g] = (n, sw, m)
    return res


def ridge_from_gram(G: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """Ridge coefficients, constant first and unpenalised, from the cross products of [const, X, y].  On the centred,
    unit-variance scale, so that without a penalty columns that are constant or repeat others take the smallest
    coefficients that fit; without rows all are 0."""
    k = len(G) - 1
    beta = np.zeros(k)
    n = G[0, 0]
    if n <= 0:
        return beta
    mean = G[0, 1:] / n
    C = G[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(C), 0.0))
    some = np.flatnonzero(sd[:-1] ** 2 > 1e-12 * np.diag(G)[1:k])
    A = C[np.ix_(some, some)] + alpha * np.eye(len(some))
    s = np.sqrt(np.diag(A))
    beta[1 + some] = np.linalg.pinv(A / np.outer(s, s), rcond=1e-12, hermitian=True) @ (C[some, -1] / s) / s
    beta[0] = mean[-1] - beta[1:] @ mean[:-1]
    return beta


def with_intercept(df: DataFrame, name: str = "const") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def balanced_sum(terms) -> Column:
    """Sum as a balanced tree (a left-deep chain of hundreds of additions
    overflows the planner's recursion)."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def dot(cols, coefs) -> Column:
    """sum_i coef_i * col_i with driver-side literals."""
    return balanced_sum([F.col(c) * F.lit(float(b)) for c, b in zip(cols, coefs)])


def quad(cols, m) -> Column:
    """x' M x for a literal matrix M."""
    k = len(cols)
    terms = []
    for i in range(k):
        for j in range(k):
            if m[i, j] != 0.0:
                terms.append(F.col(cols[i]) * F.col(cols[j]) * F.lit(float(m[i, j])))
    return balanced_sum(terms)
