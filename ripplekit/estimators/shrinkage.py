"""Shrinkage regressions from cross products (C30): lasso path by least-angle steps with an information criterion,
Bayesian ridge by evidence maximisation on the Gram's eigenvalues.

Everything here works on one centred Gram (``Moments``): k x k numbers, whatever the number of rows.  Fold Grams
subtract from the total, sub-designs are sub-matrices, so a whole grid of designs, methods and folds needs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Moments:
    """Centred cross products of n rows: G = X'X, c = X'y, yy = y'y, with the means that were taken off."""
    n: float
    G: np.ndarray
    c: np.ndarray
    yy: float
    mx: np.ndarray
    my: float

    def rss(self, b: np.ndarray) -> float:
        return max(float(self.yy - 2 * b @ self.c + b @ self.G @ b), 0.0)

    def with_intercept(self, b: np.ndarray) -> np.ndarray:
        return np.concatenate([[self.my - b @ self.mx], b])


def moments(m: np.ndarray, xs, y: int, one: int = 0) -> Moments:
    """From a raw Gram whose column ``one`` is the constant; ``xs`` and ``y`` are column numbers."""
    xs = np.asarray(xs)
    n = m[one, one]
    mx, my = m[one, xs] / n, m[one, y] / n
    return Moments(n, m[np.ix_(xs, xs)] - n * np.outer(mx, mx), m[xs, y] - n * mx * my, float(m[y, y] - n * my * my), mx, float(my))


def least_squares(mo: Moments) -> np.ndarray:
    """Minimum-norm solution on the scaled Gram (collinear columns share their effect)."""
    s = np.sqrt(np.maximum(np.diag(mo.G), 0))
    s[s == 0] = 1.0
    return np.linalg.pinv(mo.G / np.outer(s, s), rcond=1e-10, hermitian=True) @ (mo.c / s) / s


def lasso_path(mo: Moments, tol: float = 1e-9) -> list[tuple[float, np.ndarray]]:
    """Breakpoints (penalty, coefficients) of min RSS / 2 + penalty * |b|_1, from the largest penalty down.

    At each step the active coefficients move along G_A^-1 sign until a further column has the same correlation with
    the residual (it joins) or an active coefficient reaches 0 (it leaves).  A column that depends on the active ones
    (no variance left beside them) is passed over while they stay active.
    """
    k = len(mo.c)
    scale = np.sqrt(np.maximum(np.diag(mo.G), 0))
    usable = scale > 1e-12 * max(scale.max(initial=0), 1e-300)
    b, active, passed = np.zeros(k), [], set()
    corr = mo.c.copy()
    penalty = float(np.abs(np.where(usable, corr, 0)).max(initial=0))
    path = [(penalty, b.copy())]
    end = tol * max(penalty, 1e-300)
    left = -1
    for _ in range(8 * k + 8):
        if penalty <= end:
            return path
        for j in np.argsort(-np.abs(corr)):
            if j in active or j in passed or j == left or not usable[j] or abs(corr[j]) < penalty * (1 - 1e-9) - end:
                continue
            if active:
                A = np.ix_(active, active)
                rest = mo.G[j, j] - mo.G[j, active] @ np.linalg.solve(mo.G[A], mo.G[active, j])
                if rest < 1e-9 * mo.G[j, j]:
                    passed.add(j)
                    continue
            active.append(j)
        left = -1
        if not active:
            return path
        sign = np.sign(corr[active])
        move = np.linalg.solve(mo.G[np.ix_(active, active)], sign)
        drift = mo.G[:, active] @ move
        step, joins, leaves = penalty, None, None
        for j in range(k):
            if j in active or j in passed or not usable[j]:
                continue
            for num, den in ((penalty - corr[j], 1 - drift[j]), (penalty + corr[j], 1 + drift[j])):
                if den > 1e-12 and end < num / den < step:
                    step, joins = num / den, j
        for i, j in enumerate(active):
            if b[j] * move[i] < 0 and -b[j] / move[i] < step:
                step, leaves = -b[j] / move[i], j
        b = b.copy()
        b[active] += step * move
        corr = mo.c - mo.G @ b
        penalty -= step
        if leaves is not None:
            b[leaves] = 0.0
            active.remove(leaves)
            passed.clear()
            left = leaves
        path.append((max(penalty, 0.0), b.copy()))
    raise ArithmeticError("lasso path did not end")


def lasso_ic(mo: Moments, criterion: str = "aic") -> tuple[np.ndarray, float]:
    """The breakpoint with the smallest n log(2 pi s2) + RSS / s2 + factor * (number of coefficients); s2 is the noise
    variance of least squares."""
    rank = int(np.linalg.matrix_rank(mo.G, hermitian=True)) if len(mo.c) else 0
    s2 = mo.rss(least_squares(mo)) / max(mo.n - rank - 1, 1)
    factor = 2.0 if criterion == "aic" else np.log(mo.n)
    if s2 <= 0:
        penalty, b = lasso_path(mo)[-1]
        return b, penalty / mo.n
    score = lambda b: mo.n * np.log(2 * np.pi * s2) + mo.rss(b) / s2 + factor * np.count_nonzero(b)
    penalty, b = min(lasso_path(mo), key=lambda p: score(p[1]))
    return b, penalty / mo.n


def bayesian_ridge(mo: Moments, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> tuple[np.ndarray, float, bool]:
    """Coefficients, ratio of the two precisions (the ridge penalty) and whether the rounds settled.

    Evidence maximisation: with the noise precision a and the weight precision l, coefficients solve
    (G + l/a) b = c; the number of well-determined coefficients g = sum a e / (l + a e) over the eigenvalues e gives
    l = g / |b|^2 and a = (n - g) / RSS (both with the weak gamma prior).
    """
    e, V = np.linalg.eigh(mo.G)
    e = np.maximum(e, 0.0)
    proj = V.T @ mo.c
    a, l = 1.0 / max(mo.yy / mo.n, 1e-300), 1.0
    old = None
    for _ in range(rounds):
        b = V @ (proj / (e + l / a))
        g = float(np.sum(a * e / (l + a * e)))
        if old is not None and np.abs(b - old).sum() < tol:
            return b, l / a, True
        old = b
        l = (g + 2 * prior) / (float(b @ b) + 2 * prior)
        a = (mo.n - g + 2 * prior) / (mo.rss(b) + 2 * prior)
    return b, l / a, False
