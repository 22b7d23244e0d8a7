"""Many targets, steps and treatments through every method in a few passes.

Targets x steps are extra columns of one wide design, each with its own missing rows; no row is copied.  A pass adds up
small arrays per task (``passes.array_sums``): cross products for least squares and the k-class estimators, one scalar
for each HC3 error, Newton sums for all propensity models (treatment x fold) at once, fold Grams for the outcome models,
and the weighted sums of the weighting estimators with their Poisson bootstrap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..functions.stats import norm_ppf
from . import shrinkage as S
from .iv import k_class_from_gram
from .passes import array_sums

SCHEMA = ("method string, estimand string, treatment string, target string, step int, coef double, ci_lower double, "
          "ci_upper double, n long, settled boolean")
METHODS = ("regression", "instrumental_variable", "instrumental_variable_liml", "propensity_weighting", "doubly_robust")
CLIP = 0.01


@dataclass
class Plan:
    """``designs``: treatment column (its lag 0) -> regressors, itself among them; ``ys``: column -> (target, step)."""
    designs: dict[str, list[str]]
    ys: dict[str, tuple[str, int]]
    instruments: list[str] = field(default_factory=list)
    folds: int = 5
    replicates: int = 200
    level: float = 0.95


def _matrix(pdf, cols) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), pdf[list(cols)].to_numpy(float)])


# --- Poisson bootstrap -------------------------------------------------------------------------------------------

def poisson_weights(h: np.ndarray, replicates: int) -> np.ndarray:
    """rows x (1 + replicates): ones, then a Poisson(1) weight for each replicate drawn from the row's 64-bit hash.  The
    draw depends on the row alone: any partitioning, and a task that runs again, gives the same weights."""
    x = h.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.column_stack([np.ones(len(h)), np.searchsorted(steps, u, "right").astype(float)])


def interval(values: np.ndarray, level: float) -> tuple[float, float, float]:
    """Estimate on the rows themselves and the percentile interval of its replicates."""
    rest = values[1:][np.isfinite(values[1:])]
    if not len(rest):
        return float(values[0]), float("nan"), float("nan")
    lo, hi = np.quantile(rest, [0.5 - level / 2, 0.5 + level / 2])
    return float(values[0]), float(lo), float(hi)


# --- propensity models -------------------------------------------------------------------------------------------

def logistic_newton(df: DataFrame, designs: dict[str, list[str]], folds: int, c: float = 1.0, rounds: int = 40,
                    tol: float = 1e-8) -> dict[tuple[str, int], tuple[np.ndarray, bool]]:
    """Cross-fitted logistic models {(treatment, fold): (coefficients, settled)}, each fitted on the rows outside the
    fold (column ``fold``)."""
    models = {(t, f): (t, [x for x in xs if x != t], [g for g in range(folds) if g != f])
              for t, xs in designs.items() for f in range(folds)}
    return newton_models(df, models, c, rounds, tol)


def newton_models(df: DataFrame, models: dict, c: float = 1.0, rounds: int = 40, tol: float = 1e-8,
                  weights: dict | None = None) -> dict:
    """Logistic models, C * loss + |b|^2 / 2 with the constant penalised too, all fitted together: one pass is one Newton
    step of every model; a step that raises a model's loss is halved.  ``models``: key -> (label, columns, folds to train
    on); returns key -> (coefficients with the constant first, settled).  ``weights``: key -> (weight of class 0, of class
    1).  A model without rows keeps zeros."""
    w = {m: np.zeros(1 + len(cols)) for m, (_, cols, _) in models.items()}
    best = {m: (w[m], np.inf) for m in models}     # where the last accepted step starts
    live, settled = set(models), dict.fromkeys(models, False)
    names = {m: str(i) for i, m in enumerate(models)}
    for _ in range(rounds):
        now = {m: w[m] for m in live}

        def sums(pdf):
            out, fold, seen = {}, pdf["fold"].to_numpy(), {}
            for m, b in now.items():
                label, cols, train = models[m]
                if tuple(cols) not in seen:
                    seen[tuple(cols)] = _matrix(pdf, cols)
                at = np.isin(fold, train)
                X, y = seen[tuple(cols)][at], pdf[label].to_numpy(float)[at]
                z = X @ b
                p = 0.5 * (1 + np.tanh(z / 2))
                s = 1.0 if weights is None else np.where(y > 0, weights[m][1], weights[m][0])
                loss = np.sum(s * (np.logaddexp(0, z) - y * z))
                out[names[m]] = np.column_stack([(X * (s * p * (1 - p))[:, None]).T @ X, X.T @ (s * (p - y)), np.full(len(b), loss)])
            return out

        got = array_sums(df, sums)
        if not got:
            break
        for m in list(live):
            s = got[names[m]]
            H, g, loss = s[:, :-2], s[:, -2], s[0, -1] + w[m] @ w[m] / (2 * c)
            if loss > best[m][1] * (1 + 1e-12) + 1e-12:
                w[m] = (w[m] + best[m][0]) / 2
                continue
            move = np.linalg.solve(H + np.eye(len(g)) / c, g + w[m] / c)
            best[m] = (w[m], loss)
            if np.abs(move).max() < tol:
                settled[m] = True
                live.discard(m)
            w[m] = w[m] - move
        if not live:
            break
    return {m: (w[m], settled[m]) for m in models}


# --- the runner --------------------------------------------------------------------------------------------------

def run_methods(df: DataFrame, plan: Plan, methods=METHODS) -> DataFrame:
    """One row for each method x estimand x treatment x target x step.

    ``df`` holds every regressor (complete), the responses and instruments (null where missing), ``fold`` and ``h``, a
    64-bit hash of the row's key; it is read by every pass, so store it.  A response uses its own complete rows;
    instrumental variables those with instruments; the outcome models of the doubly robust estimator train on rows
    complete in all responses.  Weighting estimators: scores cross-fitted by fold, clipped to CLIP .. 1 - CLIP, interval
    of 1 + ``replicates`` Poisson bootstrap weights with the nuisance models held.
    """
    rows: list[tuple] = []
    q = norm_ppf(0.5 + plan.level / 2)
    ycols, Z = list(plan.ys), list(plan.instruments)
    sets = {tuple(xs): [t for t in plan.designs if tuple(plan.designs[t]) == tuple(xs)] for xs in plan.designs.values()}
    use_iv = bool(Z) and any(m.startswith("instrumental") for m in methods)

    def products(pdf):
        out = {}
        Y, I = pdf[ycols].to_numpy(float), pdf[Z].to_numpy(float)
        inst = ~np.isnan(I).any(axis=1)
        for d, xs in enumerate(sets):
            X = _matrix(pdf, xs)
            for j in range(len(ycols)):
                ok = ~np.isnan(Y[:, j])
                M = np.column_stack([X, Y[:, j]])[ok]
                out[f"{d}|{j}"] = M.T @ M
                if use_iv:
                    M = np.column_stack([X, I, Y[:, j]])[ok & inst]
                    out[f"{d}|{j}|z"] = M.T @ M
        return out

    G = array_sums(df, products)
    if not G:
        return df.sparkSession.createDataFrame([], SCHEMA)
    if "regression" in methods:
        rows += _regression(df, plan, sets, ycols, G, q)
    if use_iv:
        for d, (xs, treated) in enumerate(sets.items()):
            for j, y in enumerate(ycols):
                full = G[f"{d}|{j}|z"]
                for t in treated:
                    rows += _instrumental(full, xs, t, Z, plan.ys[y], methods, plan.level)
    weighting = [m for m in ("propensity_weighting", "doubly_robust") if m in methods]
    if weighting:
        rows += _weighting(df, plan, ycols, weighting)
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _regression(df, plan, sets, ycols, G, q):
    fits = {}
    for d in range(len(sets)):
        for j in range(len(ycols)):
            m = G[f"{d}|{j}"]
            inv = np.linalg.pinv(m[:-1, :-1])
            fits[d, j] = (inv, inv @ m[:-1, -1], int(round(m[0, 0])))

    def spread(pdf):
        """HC3: only the treatment's entry of the sandwich is wanted, a sum of squares for each model."""
        out, Y = {}, pdf[ycols].to_numpy(float)
        for d, (xs, treated) in enumerate(sets.items()):
            X = _matrix(pdf, xs)
            for j in range(len(ycols)):
                inv, beta, _ = fits[d, j]
                ok = ~np.isnan(Y[:, j])
                Xj = X[ok]
                e = (Y[ok, j] - Xj @ beta) / (1 - np.einsum("ij,jk,ik->i", Xj, inv, Xj))
                at = [1 + xs.index(t) for t in treated]
                out[f"{d}|{j}"] = ((Xj @ inv[:, at]) ** 2 * (e * e)[:, None]).sum(axis=0)
        return out

    var = array_sums(df, spread)
    for d, (xs, treated) in enumerate(sets.items()):
        for j, y in enumerate(ycols):
            _, beta, n = fits[d, j]
            for i, t in enumerate(treated):
                b, se = float(beta[1 + xs.index(t)]), math.sqrt(max(var[f"{d}|{j}"][i], 0.0))
                yield ("regression", "coef", t, *plan.ys[y], b, b - q * se, b + q * se, n, True)


def _instrumental(full, xs, t, Z, named, methods, level):
    """Two-stage least squares and LIML of one treatment; the other regressors are exogenous."""
    k = 1 + len(xs)
    exog = [0] + [1 + i for i, x in enumerate(xs) if x != t]
    order = exog + [1 + xs.index(t)] + list(range(k, k + len(Z))) + [k + len(Z)]
    n = int(round(full[0, 0]))
    kinds = {"2sls": "instrumental_variable", "liml": "instrumental_variable_liml"}
    if n <= len(order):
        return []
    got, _, _ = k_class_from_gram(full[np.ix_(order, order)], n, [str(i) for i in exog], [t], Z, tuple(kinds), level)
    return [(kinds[m], "coef", t, *named, r[2], r[6], r[7], n, True) for m in kinds if kinds[m] in methods
            for r in got[m] if r[1] == t]


def outcome_models(df, plan, ycols):
    """{(treatment, fold, arm): coefficients, one column for each response}: lasso by information criterion on the rows
    of the arm outside the fold, from one pass of Grams by fold and arm."""
    def products(pdf):
        out, fold, Y = {}, pdf["fold"].to_numpy(), pdf[ycols].to_numpy(float)
        whole = ~np.isnan(Y).any(axis=1)
        for t, xs in plan.designs.items():
            M = np.column_stack([_matrix(pdf, [x for x in xs if x != t]), Y])
            arm = pdf[t].to_numpy(float)
            for f in range(plan.folds):
                for a in (0, 1):
                    rows = M[whole & (fold == f) & (arm == a)]
                    out[f"{t}|{f}|{a}"] = rows.T @ rows
        return out

    G = array_sums(df, products)
    models = {}
    for t, xs in plan.designs.items():
        k = len(xs)  # constant and the regressors but the treatment
        for f in range(plan.folds):
            for a in (0, 1):
                m = sum(G[f"{t}|{g}|{a}"] for g in range(plan.folds) if g != f)
                beta = np.full((k, len(ycols)), np.nan)
                for j in range(len(ycols)):
                    if m[0, 0] > 1:
                        mo = S.moments(m, range(1, k), k + j)
                        beta[:, j] = mo.with_intercept(S.lasso_ic(mo)[0])
                models[t, f, a] = beta
    return models


def _weighting(df, plan, ycols, methods):
    scores = logistic_newton(df, plan.designs, plan.folds)
    outcome = outcome_models(df, plan, ycols) if "doubly_robust" in methods else {}

    def sums(pdf):
        out, fold, Y = {}, pdf["fold"].to_numpy(), pdf[ycols].to_numpy(float)
        draws = poisson_weights(pdf["h"].to_numpy(), plan.replicates)
        for t, xs in plan.designs.items():
            X, w = _matrix(pdf, [x for x in xs if x != t]), pdf[t].to_numpy(float)
            e, mu = np.zeros(len(pdf)), np.full((2, *Y.shape), np.nan)
            for f in np.unique(fold):
                at = fold == f
                e[at] = 0.5 * (1 + np.tanh(X[at] @ scores[t, f][0] / 2))
                for a in (0, 1):
                    if outcome:
                        mu[a][at] = X[at] @ outcome[t, f, a]
            e = np.clip(e, CLIP, 1 - CLIP)
            odds = (1 - w) * e / (1 - e)
            for j in range(len(ycols)):
                ok = ~np.isnan(Y[:, j])
                y, wj, ej, oj = Y[ok, j], w[ok], e[ok], odds[ok]
                cols = [wj * y, wj, oj * y, oj, wj * y / ej, wj / ej, (1 - wj) * y / (1 - ej), (1 - wj) / (1 - ej)]
                if outcome:
                    m0, m1 = mu[0][ok, j], mu[1][ok, j]
                    cols += [m1 - m0 + wj * (y - m1) / ej - (1 - wj) * (y - m0) / (1 - ej), np.ones(len(y)),
                             wj * (y - m0) - oj * (y - m0)]
                out[f"{t}|{j}"] = draws[ok].T @ np.column_stack(cols)
                out[f"{t}|{j}|n"] = np.array([float(ok.sum())])
        return out

    got = array_sums(df, sums)
    for t in plan.designs:
        settled = all(scores[t, f][1] for f in range(plan.folds))
        for j, y in enumerate(ycols):
            s, n = got[f"{t}|{j}"].T, int(got[f"{t}|{j}|n"][0])
            with np.errstate(divide="ignore", invalid="ignore"):
                if "propensity_weighting" in methods:
                    yield ("propensity_weighting", "att", t, *plan.ys[y], *interval(s[0] / s[1] - s[2] / s[3], plan.level), n, settled)
                    yield ("propensity_weighting", "ate", t, *plan.ys[y], *interval(s[4] / s[5] - s[6] / s[7], plan.level), n, settled)
                if "doubly_robust" in methods:
                    yield ("doubly_robust", "att", t, *plan.ys[y], *interval(s[10] / s[1], plan.level), n, settled)
                    yield ("doubly_robust", "ate", t, *plan.ys[y], *interval(s[8] / s[9], plan.level), n, settled)
