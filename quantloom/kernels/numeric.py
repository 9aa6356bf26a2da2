"""Special functions and small optimisers in NumPy."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    out = m + np.log(np.sum(np.exp(x - m), axis=axis, keepdims=True))
    return out.squeeze() if axis is None else np.squeeze(out, axis)


def digamma(x) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.atleast_1d(np.asarray(x, float)).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def norm_ppf(p) -> np.ndarray:
    return np.array([NORMAL.inv_cdf(min(max(float(v), 1e-12), 1 - 1e-12)) for v in np.ravel(p)])


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    order = np.argsort(x, kind="stable")
    _, start, counts = np.unique(x[order], return_index=True, return_counts=True)
    out = np.empty(len(x))
    out[order] = np.repeat(start + (counts + 1) / 2, counts)
    return out


def bisect(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-10) -> float:
    """A root in [lo, hi]; the nearer end if the sign does not change."""
    a, b = f(lo), f(hi)
    if a * b > 0:
        return lo if abs(a) < abs(b) else hi
    while hi - lo > tol * max(1.0, abs(lo)):
        mid = (lo + hi) / 2
        if f(mid) * a > 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def golden(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-6) -> float:
    """Minimiser of a unimodal function."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def nelder_mead(f: Callable[[np.ndarray], float], x0, step: float = 0.3, iters: int = 400, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Simplex search without derivatives."""
    x0 = np.asarray(x0, float)
    pts = np.vstack([x0, x0 + step * np.eye(len(x0))])
    val = np.array([f(p) for p in pts])
    for _ in range(iters):
        o = np.argsort(val)
        pts, val = pts[o], val[o]
        if val[-1] - val[0] < tol * (abs(val[0]) + tol):
            break
        mid = pts[:-1].mean(0)
        r = 2 * mid - pts[-1]
        fr = f(r)
        if fr < val[0]:
            e = 3 * mid - 2 * pts[-1]
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = 0.5 * (mid + (r if fr < val[-1] else pts[-1]))
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts[1:] = 0.5 * (pts[1:] + pts[0])
                val[1:] = [f(p) for p in pts[1:]]
    k = int(np.argmin(val))
    return pts[k], float(val[k])


def ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def logistic_fit(x: np.ndarray, y: np.ndarray, lam: float = 1.0, iters: int = 50) -> np.ndarray:
    """Newton steps for summed logistic loss with an L2 penalty on all but the intercept (first)."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    pen = np.full(len(w), lam)
    pen[0] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + pen * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen + 1e-10)
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-10:
            break
    return w


def t_logpdf(z2: np.ndarray, logdet: float, dim: int, nu: float) -> np.ndarray:
    """Multivariate t log-density from squared distances."""
    return math.lgamma((nu + dim) / 2) - math.lgamma(nu / 2) - 0.5 * (dim * math.log(nu * math.pi) + logdet) - (nu + dim) / 2 * np.log1p(z2 / nu)


def t_fit(x: np.ndarray, cap: float = 200.0) -> tuple[float, float, float]:
    """Location, scale and degrees of freedom of a Student t by maximum likelihood."""
    x = x[np.isfinite(x)]

    def nll(p: np.ndarray) -> float:
        s, nu = math.exp(p[1]), 2.05 + math.exp(min(p[2], 8))
        return -float(np.sum(t_logpdf(((x - p[0]) / s) ** 2, 2 * math.log(s), 1, nu)))

    best, _ = nelder_mead(nll, [float(np.median(x)), math.log(x.std() + 1e-12), 1.5], iters=600)
    return float(best[0]), math.exp(best[1]), min(2.05 + math.exp(min(best[2], 8)), cap)


def hac_mean(d: np.ndarray, h: int) -> tuple[float, float, float]:
    """Mean, Newey-West statistic, two-sided normal p."""
    e, n = d - d.mean(), len(d)
    s = e @ e / n + 2 * sum((1 - k / h) * (e[k:] @ e[:-k]) / n for k in range(1, h))
    stat = d.mean() / math.sqrt(max(s, 1e-18) / n)
    return float(d.mean()), float(stat), 2 * NORMAL.cdf(-abs(stat))


def signed_rank_p(d: np.ndarray) -> float:
    """Two-sided Wilcoxon signed-rank p by the normal approximation with ties."""
    d = d[d != 0]
    if not len(d):
        return 1.0
    r = average_ranks(np.abs(d))
    mean, var = r.sum() / 2, (r * r).sum() / 4
    z = (r[d > 0].sum() - mean) / math.sqrt(var)
    return 2 * NORMAL.cdf(-abs(z))


def sign_test_p(wins: int, n: int) -> float:
    """Two-sided exact binomial p at one half."""
    tail = sum(math.comb(n, k) for k in range(min(wins, n - wins) + 1)) / 2**n
    return min(1.0, 2 * tail)
