"""Nearest-neighbour mutual information and bootstrap indices."""

from __future__ import annotations

import numpy as np

from .numeric import average_ranks, bisect, digamma, norm_ppf


def rank_gauss(x: np.ndarray) -> np.ndarray:
    return norm_ppf((average_ranks(x) - 0.375) / (len(x) + 0.25))


def ksg(x: np.ndarray, y: np.ndarray, k: int = 4, block: int = 512, ranks: bool = True) -> float:
    """Kraskov's first estimator in nats, maximum norm, distances taken in blocks of rows."""
    x, y = (rank_gauss(v) for v in (x, y)) if ranks else (x, y)
    n, nx, ny = len(x), np.empty(len(x)), np.empty(len(x))
    for a in range(0, n, block):
        dx = np.abs(x[a : a + block, None] - x[None, :])
        dy = np.abs(y[a : a + block, None] - y[None, :])
        d = np.maximum(dx, dy)
        rows = np.arange(len(d))
        d[rows, a + rows] = np.inf
        eps = np.partition(d, k - 1, axis=1)[:, k - 1][:, None]
        nx[a : a + block], ny[a : a + block] = (dx < eps).sum(1) - 1, (dy < eps).sum(1) - 1
    return float(digamma(k)[0] + digamma(n)[0] - (digamma(nx + 1) + digamma(ny + 1)).mean())


def ksg_net(x: np.ndarray, y: np.ndarray, shuffles: int = 5, k: int = 4, seed: int = 0) -> float:
    """KSG less its mean over shuffled pairs."""
    rng = np.random.default_rng(seed)
    return ksg(x, y, k) - float(np.mean([ksg(x, rng.permutation(y), k) for _ in range(shuffles)]))


def plugin_mi(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete mutual information in nats with the Miller-Madow correction."""
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    c = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(c, (a, b), 1)
    p = c / c.sum()
    m = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    full = p > 0
    return float((p[full] * np.log(p[full] / m[full])).sum() - (full.sum() - c.shape[0] - c.shape[1] + 1) / (2 * len(a)))


def binary_ceiling(bits: float) -> float:
    """Annual Sharpe ratio of a fair-sized bet right with the probability that so many bits allow."""
    h = lambda p: -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    p = bisect(lambda q: 1 - h(q) - bits, 0.5 + 1e-12, 1 - 1e-12)
    return float((2 * p - 1) * np.sqrt(252))


def stationary_indices(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Resampled positions in circular blocks of geometric length."""
    new = rng.random(n) < 1 / mean_block
    new[0] = True
    starts = rng.integers(0, n, n)
    block = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return (starts[first][block] + np.arange(n) - first[block]) % n


def circular_indices(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Resampled positions in circular blocks of fixed length."""
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]


def confidence_set(losses: np.ndarray, alpha: float = 0.1, draws: int = 500, mean_block: float = 63.0, seed: int = 42) -> tuple[list[int], dict[int, float]]:
    """Model confidence set by the largest t statistic, one set of bootstrap samples for all rounds."""
    t, m = losses.shape
    rng = np.random.default_rng(seed)
    boot = np.array([losses[stationary_indices(t, mean_block, rng)].mean(0) for _ in range(draws)])
    mean, alive, pv, worst = losses.mean(0), list(range(m)), {}, 0.0
    while len(alive) > 1:
        d = mean[alive] - mean[alive].mean()
        b = boot[:, alive] - boot[:, alive].mean(1, keepdims=True) - d
        se = np.maximum(b.std(0), 1e-12)
        stat = d / se
        p = float((np.abs(b / se).max(1) >= stat.max()).mean())
        worst = max(worst, p)
        pv[alive[int(np.argmax(stat))]] = worst
        if p >= alpha:
            break
        alive.pop(int(np.argmax(stat)))
    for k in alive:
        pv.setdefault(k, 1.0)
    return alive, pv
