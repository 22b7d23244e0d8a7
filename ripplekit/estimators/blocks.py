"""Principal components by block (C11), partial regressions by the sweep operator (C39), paired gain tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_cdf
from .gram import collect_gram
from .multi import newton_models
from .passes import array_sums


# --- C11 ---------------------------------------------------------------------------------------------------------

def block_components(df: DataFrame, blocks: dict[str, list[str]]):
    """Principal components of each block's population-standardised columns.  One Gram of all columns gives means,
    deviations and covariances; returns ({block: (loadings, variances, means, deviations)}, df with the score columns
    ``pc_{block}_{i}``).  Signs: each component's largest loading is positive.  A column without
    variance stays out of its block (loading 0).  Rows must be complete."""
    cols = list(dict.fromkeys(c for b in blocks.values() for c in b))
    d = df.withColumn("_one", F.lit(1.0))
    got = collect_gram(d, ["_one", *cols])
    if not got:
        return {}, df.select("*", *[F.lit(None).cast("double").alias(f"pc_{b}_{i}") for b, cs in blocks.items() for i in range(len(cs))])
    (n, _, G), = got.values()
    mean = G[0, 1:] / n
    cov = G[1:, 1:] / n - np.outer(mean, mean)
    out, scores = {}, {}
    for b, cs in blocks.items():
        at = [cols.index(c) for c in cs]
        sd = np.sqrt(np.maximum(np.diag(cov)[at], 0))
        live = sd > 1e-12 * np.maximum(np.abs(mean[at]), 1e-300)
        scale = np.where(live, sd, 1.0)
        corr = np.where(np.outer(live, live), cov[np.ix_(at, at)] / np.outer(scale, scale), 0.0)
        value, vector = np.linalg.eigh(corr)
        order = np.argsort(-value, kind="stable")
        value, vector = value[order], vector[:, order]
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(cs))])
        out[b] = (vector, value, mean[at], scale)
        std = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(cs, mean[at], scale)]
        for i in range(len(cs)):
            terms = [x * F.lit(float(v)) for x, v in zip(std, vector[:, i])]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            scores[f"pc_{b}_{i}"] = total
    return out, df.withColumns(scores)


# --- C39 ---------------------------------------------------------------------------------------------------------

def sweep(A: np.ndarray, k: int) -> np.ndarray:
    """Sweep a symmetric matrix on pivot k: afterwards the swept block is the inverse, the rest what is left beside it."""
    d = A[k, k]
    B = A - np.outer(A[:, k], A[k]) / d
    B[k], B[:, k], B[k, k] = A[k] / d, A[:, k] / d, -1 / d
    return B


def partial_regression(m: np.ndarray, names, min_rows: int = 3):
    """Standardised coefficients of the last column on the others from a raw Gram whose first column is the constant:
    [(name, beta, se, p, r2, n)], or nothing where a column has no variance or depends on the others."""
    n = m[0, 0]
    k = len(names)
    if n < max(min_rows, k + 2):
        return []
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    if (sd <= 1e-12 * np.maximum(np.abs(mean), 1e-300)).any():
        return []
    A = cov / np.outer(sd, sd)
    for j in range(k):
        if A[j, j] < 1e-10:
            return []
        A = sweep(A, j)
    rest, dof = max(float(A[k, k]), 0.0), n - k - 1
    rows = []
    for j, name in enumerate(names):
        beta, se = float(A[j, k]), math.sqrt(max(-A[j, j] * rest / dof, 0.0))
        p = float(2 * (1 - t_cdf(abs(beta) / se, dof))) if se > 0 else None
        rows.append((name, beta, se, p, 1 - rest, int(round(n))))
    return rows


def timeline(df: DataFrame, y: str, models: dict[tuple, dict[str, str]]):
    """Many partial regressions of ``y`` from one pass: ``models``: key -> {predictor: column}; every model uses its own
    complete rows.  Rows (*key, predictor, beta, se, p, r2, n)."""
    def sums(pdf):
        out, target = {}, pdf[y].to_numpy(float)
        for i, cols in enumerate(models.values()):
            M = np.column_stack([np.ones(len(pdf)), pdf[list(cols.values())].to_numpy(float), target])
            M = M[~np.isnan(M).any(axis=1)]
            out[str(i)] = M.T @ M
        return out

    got = array_sums(df, sums)
    return [(*key, *row) for i, (key, cols) in enumerate(models.items()) if str(i) in got
            for row in partial_regression(got[str(i)], list(cols))]


# --- C32 ---------------------------------------------------------------------------------------------------------

def paired_t(differences) -> tuple[float, float, int]:
    """t and one-sided p of a mean difference above 0 over paired folds."""
    d = np.asarray([x for x in differences if x is not None and np.isfinite(x)], float)
    if len(d) < 2 or d.std(ddof=1) == 0:
        return float("nan"), float("nan"), len(d)
    t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    return float(t), float(1 - t_cdf(t, len(d) - 1)), len(d)


def logistic_fold_f1(df: DataFrame, label: str, sets: dict[str, list[str]], folds: int):
    """{set: [F1 of fold 1, ...]}: class-balanced logistic models on the folds before each fold, all sets and folds fitted
    together; F1 counts in one more pass."""
    count = {r["fold"]: (r["n"], r["pos"]) for r in
             df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).collect()}
    models, weights = {}, {}
    for f in range(1, folds):
        n, pos = (sum(v[i] for g, v in count.items() if g < f) for i in (0, 1))
        if f not in count or pos in (0, n):
            continue
        for s, cols in sets.items():
            models[s, f] = (label, cols, list(range(f)))
            weights[s, f] = (n / (2 * (n - pos)), n / (2 * pos))
    fits = newton_models(df, models, weights=weights)

    def hits(pdf):
        out, fold, y = {}, pdf["fold"].to_numpy(), pdf[label].to_numpy(float) > 0
        for s, cols in sets.items():
            X = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
            out[s] = np.zeros((folds, 3))
            for f in np.unique(fold):
                if (s, f) in fits:
                    at = fold == f
                    called = X[at] @ fits[s, f][0] >= 0
                    out[s][f] += [(called & y[at]).sum(), (called & ~y[at]).sum(), (~called & y[at]).sum()]
        return out

    got = array_sums(df, hits) if models else {}
    f1 = lambda tp, fp, fn: float(2 * tp / (2 * tp + fp + fn)) if tp + fp + fn else None
    return {s: [f1(*got[s][f]) if (s, f) in models else None for f in range(1, folds)] for s in sets} if got else {s: [] for s in sets}
