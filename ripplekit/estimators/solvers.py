"""Small dense solvers run inside executors (per event / per group):
non-negative least squares (Lawson-Hanson) and simplex-constrained least
squares (projected gradient).  NumPy only."""

from __future__ import annotations

import numpy as np


def nnls(A: np.ndarray, b: np.ndarray, max_iter: int | None = None) -> np.ndarray:
    m, n = A.shape
    x = np.zeros(n)
    P = np.zeros(n, dtype=bool)
    tol = 10 * np.finfo(float).eps * np.linalg.norm(A, 1) * max(m, n)
    w = A.T @ (b - A @ x)
    it, max_iter = 0, max_iter or 3 * n + 10
    while (~P).any() and np.max(np.where(~P, w, -np.inf)) > tol and it < max_iter:
        it += 1
        j = int(np.argmax(np.where(~P, w, -np.inf)))
        P[j] = True
        while True:
            s = np.zeros(n)
            s[P] = np.linalg.lstsq(A[:, P], b, rcond=None)[0]
            if s[P].min() > tol:
                break
            mask = P & (s <= tol)
            alpha = np.min(x[mask] / (x[mask] - s[mask]))
            x = x + alpha * (s - x)
            P &= x > tol
            if not P.any():
                s = np.zeros(n)
                break
        x = s
        w = A.T @ (b - A @ x)
    return x


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto {w >= 0, sum w = 1}."""
    u = np.sort(v)[::-1]
    css = np.cumsum(u)
    k = np.arange(1, len(v) + 1)
    r = np.nonzero(u * k > (css - 1))[0][-1]
    theta = (css[r] - 1) / (r + 1.0)
    return np.maximum(v - theta, 0.0)


def simplex_ls(A: np.ndarray, b: np.ndarray, iters: int = 1000, tol: float = 1e-12) -> np.ndarray:
    """min ||Aw - b||² s.t. w in the simplex (accelerated projected gradient)."""
    n = A.shape[1]
    L = np.linalg.norm(A, 2) ** 2 or 1.0
    w = np.full(n, 1.0 / n)
    z, t = w.copy(), 1.0
    for _ in range(iters):
        g = A.T @ (A @ z - b)
        w_new = project_simplex(z - g / L)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w_new + (t - 1) / t_new * (w_new - w)
        done = np.max(np.abs(w_new - w)) < tol
        w, t = w_new, t_new
        if done:
            break
    return w
