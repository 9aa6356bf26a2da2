"""Volatility forecasters and point processes: EWMA, HAR, GJR-GARCH-t, rough kernel, Hawkes; Kalman pairs and Hedge weights.

Models with a ``step`` advance one observation at a time; batch and streaming share it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .numeric import nelder_mead, ols

TINY = 1e-12


@dataclass
class Ewma:
    """s2 = lam s2 + (1 - lam) r2, seeded by the mean of the first squares."""

    lam: float = 0.94
    s2: float = math.nan

    def step(self, r: float) -> float:
        self.s2 = r * r if math.isnan(self.s2) else self.lam * self.s2 + (1 - self.lam) * r * r
        return self.s2

    def run(self, r: np.ndarray, seed_rows: int = 20) -> np.ndarray:
        self.s2 = float((r[:seed_rows] ** 2).mean()) if len(r) else math.nan
        return np.array([self.step(float(x)) for x in r])


@dataclass
class EwmMoments:
    """Exponentially weighted mean and deviation with weights that sum over all rows seen (bias-corrected)."""

    halflife: float
    s0: float = 0.0
    s1: float = 0.0
    s2: float = 0.0
    q: float = 0.0

    @classmethod
    def of_span(cls, span: float) -> EwmMoments:
        return cls(math.log(0.5) / math.log(1 - 2 / (span + 1)))

    def step(self, x: float) -> tuple[float, float]:
        d = 0.5 ** (1 / self.halflife)
        self.s0, self.s1, self.s2, self.q = self.s0 * d + 1, self.s1 * d + x, self.s2 * d + x * x, self.q * d * d + 1
        mean = self.s1 / self.s0
        den = self.s0**2 - self.q
        var = (self.s2 / self.s0 - mean * mean) * self.s0**2 / den if den > 1e-12 else math.nan
        return mean, math.sqrt(max(var, 0.0)) if var == var else math.nan


def trailing_means(x: np.ndarray, widths: tuple[int, ...] = (1, 5, 22)) -> np.ndarray:
    """Means over the last w values at each row, NaN before the window is full."""
    c = np.concatenate([[0.0], np.cumsum(x)])
    out = np.full((len(x), len(widths)), np.nan)
    for k, w in enumerate(widths):
        out[w - 1 :, k] = (c[w:] - c[:-w]) / w
    return out


class Har:
    """Log variance on its 1, 5 and 22 row means."""

    def fit(self, rv: np.ndarray) -> Har:
        l = np.log(np.maximum(rv, TINY))
        f = trailing_means(l)
        x, y = f[21:-1], l[22:]
        z = np.column_stack([np.ones(len(x)), x])
        self.beta = ols(z, y)
        self.s2 = float((y - z @ self.beta).var())
        return self

    def predict(self, rv: np.ndarray) -> np.ndarray:
        """At each row the variance of the next."""
        f = trailing_means(np.log(np.maximum(rv, TINY)))
        return np.exp(self.beta[0] + f @ self.beta[1:] + self.s2 / 2)


class GjrGarch:
    """GJR-GARCH(1,1) with Student-t shocks and the long-run variance at the sample's."""

    def _unpack(self, p: np.ndarray) -> tuple[float, float, float, float]:
        # shares of total persistence < 1: alpha + gamma / 2 + beta
        e = np.exp(np.clip(p[:3], -12, 12))
        s = 1 + e.sum()
        return e[0] / s, 2 * e[1] / s, e[2] / s, 2.1 + math.exp(min(p[3], 5))

    def variances(self, r: np.ndarray) -> np.ndarray:
        """Variance at each row from earlier rows, and one more for the next."""
        base = self.level * (1 - self.alpha - self.gamma / 2 - self.beta)
        out = np.empty(len(r) + 1)
        s = out[0] = self.level
        a, g, b = self.alpha, self.gamma, self.beta
        for i, x in enumerate(r.tolist()):
            s = base + (a + (g if x < 0 else 0.0)) * x * x + b * s
            out[i + 1] = s
        return out

    def step(self, s2: float, r: float) -> float:
        base = self.level * (1 - self.alpha - self.gamma / 2 - self.beta)
        return base + (self.alpha + (self.gamma if r < 0 else 0.0)) * r * r + self.beta * s2

    def fit(self, r: np.ndarray) -> GjrGarch:
        self.level = float(r.var())

        def nll(p: np.ndarray) -> float:
            self.alpha, self.gamma, self.beta, self.nu = self._unpack(p)
            v = np.maximum(self.variances(r)[:-1], TINY)
            n = self.nu
            c = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(math.pi * (n - 2))
            return float(-(len(r) * c - 0.5 * np.log(v).sum() - (n + 1) / 2 * np.log1p(r * r / (v * (n - 2))).sum()))

        best = None
        for a, g, b in ((0.05, 0.05, 0.88), (0.03, 0.1, 0.85), (0.1, 0.02, 0.8)):
            rest = 1 - a - g / 2 - b
            got = nelder_mead(nll, [math.log(a / rest), math.log(g / 2 / rest), math.log(b / rest), 1.5], iters=120)
            best = got if best is None or got[1] < best[1] else best
        self.alpha, self.gamma, self.beta, self.nu = self._unpack(best[0])
        self.loglik = -best[1]
        return self


def rough_kernel(hurst: float, horizon: int, rows: int) -> np.ndarray:
    """Weights of the conditional mean of fractional log variance on past rows, newest first, sum one."""
    s = np.arange(rows)
    k = 1 / ((s + horizon + 0.5) * (s + 0.5) ** (hurst + 0.5))
    return k / k.sum()


def hurst_of(logvol: np.ndarray, lags=(1, 2, 3, 4, 5, 7, 9, 11, 15, 19, 24, 32, 41, 50), qs=(0.5, 1.0, 1.5, 2.0, 3.0)) -> float:
    """Scaling exponent through the origin over moments."""
    z = []
    for q in qs:
        m = [np.mean(np.abs(logvol[d:] - logvol[:-d]) ** q) for d in lags if d < len(logvol)]
        z.append(np.polyfit(np.log(lags[: len(m)]), np.log(m), 1)[0])
    q = np.array(qs)
    return float((q * np.array(z)).sum() / (q * q).sum())


class Rough:
    """Rough-volatility forecaster: exponential prefilter, kernel mean, linear calibration."""

    def __init__(self, horizon: int = 1, rows: int = 500, halflives: tuple[int, ...] = (1, 2, 5, 10)) -> None:
        self.horizon, self.rows, self.halflives = horizon, rows, halflives

    def _signal(self, l: np.ndarray, h: float) -> np.ndarray:
        a = 1 - 0.5 ** (1 / h)
        f = np.empty_like(l)
        cur = l[0]
        for i, x in enumerate(l):
            cur += a * (x - cur)
            f[i] = cur
        k = self.kernel
        return np.array([k[: min(i + 1, len(k))] @ f[i :: -1][: len(k)] / k[: min(i + 1, len(k))].sum() for i in range(len(f))])

    def fit(self, var: np.ndarray) -> Rough:
        l = np.log(np.maximum(var, TINY))
        self.hurst = min(max(hurst_of(0.5 * l), 0.02), 0.49)
        self.kernel = rough_kernel(self.hurst, self.horizon, self.rows)
        best = None
        for h in self.halflives:
            s = self._signal(l, h)
            x, y = s[30 : -self.horizon], l[30 + self.horizon :]
            z = np.column_stack([np.ones(len(x)), x])
            b = ols(z, y)
            v = float((y - z @ b).var())
            if best is None or v < best[0]:
                best = (v, h, b)
        self.s2, self.halflife, self.beta = best
        return self

    def predict(self, var: np.ndarray) -> np.ndarray:
        s = self._signal(np.log(np.maximum(var, TINY)), self.halflife)
        return np.exp(self.beta[0] + self.beta[1] * s + self.s2 / 2)


def lever_vol(r: np.ndarray, first: int = 252, every: int = 21, halflife: float = 21.0) -> np.ndarray:
    """Annual volatility that a book's own returns foretell for the next row.

    Squares on their 1, 5 and 22 row means by least squares, refitted on all pairs that
    have ended; the exponentially weighted deviation before the first fit."""
    sq = r * r
    x = np.column_stack([np.ones(len(r)), trailing_means(sq)])
    plain = EwmMoments(halflife)
    out = np.array([plain.step(float(v))[1] for v in r]) if len(r) else np.zeros(0)
    beta = None
    for t in range(first, len(r)):
        if beta is None or t % every == 0:
            beta = np.linalg.lstsq(x[21:t], sq[22 : t + 1], rcond=None)[0]
        if np.isfinite(x[t]).all():
            out[t] = math.sqrt(max(float(x[t] @ beta), 1e-10))
    return out * math.sqrt(252)


def walk_forward_variance(r: np.ndarray, rv: np.ndarray, first: int = 750, every: int = 21, garch_every: int = 63) -> dict[str, np.ndarray]:
    """Forecast of each row's variance from earlier rows by four models, refitted on expanding windows."""
    n = len(r)
    out = {k: np.full(n, np.nan) for k in ("ewma", "har", "garch", "rough")}
    out["ewma"][1:] = Ewma().run(r)[:-1]
    for t in range(first, n, every):
        end = min(t + every, n)
        out["har"][t:end] = Har().fit(rv[:t]).predict(rv[:end])[t - 1 : end - 1]
        out["rough"][t:end] = Rough().fit(rv[:t]).predict(rv[:end])[t - 1 : end - 1]
    for t in range(first, n, garch_every):
        end = min(t + garch_every, n)
        out["garch"][t:end] = GjrGarch().fit(r[:t]).variances(r[:end])[t:end]
    return out


# ---- point processes


def hawkes_nll(p: np.ndarray, t: np.ndarray, horizon: float) -> float:
    """Negative log-likelihood of mu + sum n b exp(-b dt), with mu and b as logarithms, n by logit."""
    mu, n, b = math.exp(p[0]), 1 / (1 + math.exp(-p[1])), math.exp(p[2])
    decay = np.exp(-b * np.diff(t))
    a = np.empty(len(t))
    cur = a[0] = 0.0
    for i, d in enumerate(decay.tolist(), 1):
        cur = d * (1 + cur)
        a[i] = cur
    return float(mu * horizon + n * (1 - np.exp(-b * (horizon - t))).sum() - np.log(mu + n * b * a).sum())


def fit_hawkes(t: np.ndarray, horizon: float | None = None) -> dict[str, float]:
    """Base rate, branching ratio, decay; NaN for fewer than twenty events."""
    if len(t) < 20:
        return {"mu": math.nan, "n": math.nan, "beta": math.nan}
    horizon = float(horizon or t[-1])
    rate = len(t) / horizon
    best = None
    for n0, b0 in ((0.3, rate), (0.6, 2 * rate), (0.8, 0.5 * rate), (0.1, 5 * rate)):
        got = nelder_mead(lambda p: hawkes_nll(p, t, horizon), [math.log(rate * (1 - n0)), math.log(n0 / (1 - n0)), math.log(b0)], iters=150)
        best = got if best is None or got[1] < best[1] else best
    p = best[0]
    return {"mu": math.exp(p[0]), "n": 1 / (1 + math.exp(-p[1])), "beta": math.exp(p[2])}


def simulate_hawkes(mu: float, n: float, beta: float, horizon: float, rng: np.random.Generator) -> np.ndarray:
    """Branching construction: immigrants, and offspring of each event until none are left."""
    gen = np.sort(rng.uniform(0, horizon, rng.poisson(mu * horizon)))
    out = [gen]
    while len(gen):
        kids = rng.poisson(n, len(gen))
        gen = np.repeat(gen, kids) + rng.exponential(1 / beta, kids.sum())
        gen = gen[gen < horizon]
        out.append(gen)
    return np.sort(np.concatenate(out))


def debias(n_hat: float, true: np.ndarray, fitted: np.ndarray) -> float:
    """Inverse of the recovery curve, by linear pieces."""
    o = np.argsort(fitted)
    return float(np.clip(np.interp(n_hat, fitted[o], true[o]), 0, 0.999))


# ---- state machines of the book


@dataclass
class KalmanPair:
    """Regression of y on x with drifting intercept and slope; z is the innovation in units of its own trailing deviation."""

    resid_var: float
    delta: float = 1e-5
    lam: float = 0.96
    theta: np.ndarray = field(default=None)
    cov: np.ndarray = field(default_factory=lambda: np.eye(2))
    var: float = math.nan

    def step(self, y: float, x: float) -> tuple[float, float]:
        h = np.array([1.0, x])
        first = self.theta is None
        if first:
            self.theta, self.var = np.array([y - x, 1.0]), max(self.resid_var, 1e-8)
        prior = self.cov + self.delta / (1 - self.delta) * np.eye(2)
        e = y - float(h @ self.theta)
        if not first:
            self.var = self.lam * self.var + (1 - self.lam) * e * e
        gain = prior @ h / (h @ prior @ h + max(self.resid_var, 1e-8))
        self.theta = self.theta + gain * e
        self.cov = prior - np.outer(gain, h @ prior)
        return e / math.sqrt(max(self.var, 1e-12)), float(self.theta[1])


@dataclass
class SpreadTrader:
    """Entry, exit, stop and time-out on a z-score; a stop retires the pair."""

    entry: float = 2.5
    leave: float = 0.75
    stop: float = 4.5
    most_days: int = 60
    position: int = 0
    days: int = 0
    dead: bool = False

    def step(self, z: float) -> str | None:
        """What is done on today's z, for tomorrow."""
        if self.dead:
            return None
        if self.position == 0:
            if self.entry < abs(z) < self.stop:
                self.position, self.days = (-1 if z > 0 else 1), 0
                return "enter"
            return None
        self.days += 1
        broken = abs(z) > self.stop
        if broken or abs(z) < self.leave or self.days >= self.most_days:
            self.position, self.dead = 0, broken
            return "stop" if broken else "exit"
        return None


@dataclass
class Hedge:
    """Multiplicative weights over experts, with a fixed share mixed in."""

    n: int
    eta: float = 0.05
    share: float = 0.0
    w: np.ndarray = field(default=None)

    def step(self, gains: np.ndarray) -> np.ndarray:
        """Weights for the next row after the gains of this one."""
        w = np.full(self.n, 1 / self.n) if self.w is None else self.w
        w = w * np.exp(self.eta * (gains - gains.max()))
        w = w / w.sum()
        self.w = (1 - self.share) * w + self.share / self.n
        return self.w
