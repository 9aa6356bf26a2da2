"""Seeded worlds with known truth, and the agent market; each takes a generator so that keys, not partitions, fix the draws."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .information import plugin_mi


def rng_of(seed: int, key: int = 0) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, key]))


def gbm_ohlc(n: int, sigma: float, rng: np.random.Generator, steps: int = 78, overnight: float = 0.3) -> np.ndarray:
    """open, high, low, close of n days of geometric Brownian motion; ``overnight`` of the variance falls between sessions."""
    day = sigma / math.sqrt(252)
    gap = rng.normal(0, day * math.sqrt(overnight), n)
    path = np.cumsum(rng.normal(0, day * math.sqrt((1 - overnight) / steps), (n, steps)), axis=1)
    path = np.concatenate([np.zeros((n, 1)), path], axis=1)
    base = np.concatenate([[0.0], np.cumsum(gap + path[:, -1])[:-1]]) + gap
    p = 100 * np.exp(base[:, None] + path)
    return np.column_stack([p[:, 0], p.max(1), p.min(1), p[:, -1]])


def regime_market(n: int, assets: int, rng: np.random.Generator) -> np.ndarray:
    """Closes (n, assets) of a three-regime factor market with t shocks."""
    trans = np.array([[0.985, 0.012, 0.003], [0.02, 0.96, 0.02], [0.01, 0.04, 0.95]])
    mu, sd = np.array([8e-4, 1e-4, -1.5e-3]), np.array([0.007, 0.012, 0.022])
    state, path = 0, np.empty(n, int)
    for i, u in enumerate(rng.random(n)):
        state = int(np.searchsorted(np.cumsum(trans[state]), u))
        path[i] = min(state, 2)
    f = mu[path] + sd[path] * rng.standard_t(5, n) / math.sqrt(5 / 3)
    beta = rng.uniform(0.6, 1.4, assets)
    idio = 0.012 * rng.standard_t(5, (n, assets)) / math.sqrt(5 / 3)
    return 100 * np.exp(np.cumsum(f[:, None] * beta + idio, axis=0))


def hmm_features(n: int, nu: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(return, log volatility) rows and states of a known three-state world; Gaussian for infinite nu."""
    trans = np.array([[0.98, 0.015, 0.005], [0.02, 0.96, 0.02], [0.01, 0.03, 0.96]])
    mean = np.array([[8e-4, -2.4], [1e-4, -1.9], [-1.2e-3, -1.3]])
    sd = np.array([[0.006, 0.15], [0.011, 0.15], [0.022, 0.18]])
    s, state = np.empty(n, int), 0
    for i, u in enumerate(rng.random(n)):
        state = min(int(np.searchsorted(np.cumsum(trans[state]), u)), 2)
        s[i] = state
    e = rng.standard_normal((n, 2))
    if math.isfinite(nu):
        e = e / np.sqrt(rng.chisquare(nu, (n, 1)) / nu) * math.sqrt((nu - 2) / nu)
    return mean[s] + sd[s] * e, s


def gjr_returns(n: int, rng: np.random.Generator, alpha=0.04, gamma=0.08, beta=0.89, nu=6.0, level=1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Returns and true variances of a GJR-GARCH-t world."""
    z = rng.standard_t(nu, n) * math.sqrt((nu - 2) / nu)
    base, s = level * (1 - alpha - gamma / 2 - beta), level
    r, v = np.empty(n), np.empty(n)
    for i in range(n):
        v[i] = s
        r[i] = math.sqrt(s) * z[i]
        s = base + (alpha + (gamma if r[i] < 0 else 0)) * r[i] ** 2 + beta * s
    return r, v


def fgn(n: int, hurst: float, rng: np.random.Generator) -> np.ndarray:
    """Fractional Gaussian noise by circulant embedding."""
    k = np.arange(n + 1)
    g = 0.5 * (np.abs(k + 1) ** (2 * hurst) - 2 * np.abs(k) ** (2 * hurst) + np.abs(k - 1) ** (2 * hurst))
    lam = np.maximum(np.fft.fft(np.concatenate([g, g[-2:0:-1]])).real, 0)
    m = len(lam)
    w = rng.standard_normal(m) + 1j * rng.standard_normal(m)
    return np.fft.fft(np.sqrt(lam / m) * w).real[:n]


def rough_variance(n: int, rng: np.random.Generator, hurst: float = 0.1, nu: float = 0.3, level: float = -9.2, shape: float = 3.7) -> tuple[np.ndarray, np.ndarray]:
    """Measured and true daily variance with rough log volatility and gamma measurement noise."""
    x = np.cumsum(nu * fgn(n, hurst, rng))
    true = np.exp(level + 2 * (x - x.mean()))
    return true * rng.gamma(shape, 1 / shape, n), true


def sv_world(n: int, rng: np.random.Generator, s2: float = 0.12, rho: float = 0.98, jumps: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Returns and variances with lognormal stochastic volatility of variance s2, and jumps."""
    e = rng.standard_normal(n) * math.sqrt(s2 * (1 - rho**2))
    h = np.empty(n)
    cur = rng.standard_normal() * math.sqrt(s2)
    for i in range(n):
        cur = rho * cur + e[i]
        h[i] = cur
    vol = 0.01 * np.exp(h)
    r = vol * rng.standard_normal(n) + (rng.random(n) < jumps) * rng.normal(0, 0.06, n)
    return r, vol**2


def clock_world(n: int, assets: int, rng: np.random.Generator, rho_eps: float = 0.45, rho_clock: float = 0.8, s2: float = 0.12, joint_jumps: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Returns and variances of assets whose volatilities share a clock; with common jumps there is contagion beyond it."""
    mix = lambda rho, shape: math.sqrt(rho) * rng.standard_normal((shape[0], 1)) + math.sqrt(1 - rho) * rng.standard_normal(shape)
    e, h = mix(rho_clock, (n, assets)), np.zeros((n, assets))
    for i in range(1, n):
        h[i] = 0.98 * h[i - 1] + math.sqrt(s2 * (1 - 0.98**2)) * e[i]
    vol = 0.01 * np.exp(h)
    r = vol * mix(rho_eps, (n, assets))
    hit = rng.random(n) < joint_jumps
    r[hit] -= np.abs(rng.normal(0.05, 0.02, (hit.sum(), 1)))
    return r, vol**2


def reversible_world(n: int, rng: np.random.Generator, s2: float = 0.15, rho: float = 0.98, shape: float = 3.7) -> tuple[np.ndarray, np.ndarray]:
    """Returns and measured variances whose volatility does not know the returns: time has no arrow."""
    r, var = sv_world(n, rng, s2, rho)
    return r, var * rng.gamma(shape, 1 / shape, n)


def volofvol_world(n: int, assets: int, rng: np.random.Generator, switching: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Variances whose own volatility switches between calm and agitated (or stays), with joint shocks when agitated."""
    state, w = 0, np.empty(n)
    for i, u in enumerate(rng.random(n)):
        state = 1 - state if u < 0.01 else state
        w[i] = (0.04, 0.16)[state] if switching else 0.1
    h = np.zeros(n)
    z = rng.standard_normal(n)
    for i in range(1, n):
        h[i] = 0.97 * h[i - 1] + w[i] * z[i]
    vol = 0.01 * np.exp(h)
    r = vol[:, None] * (math.sqrt(0.6) * rng.standard_normal((n, 1)) + math.sqrt(0.4) * rng.standard_normal((n, assets)))
    return r, np.repeat(vol[:, None] ** 2, assets, axis=1)


def fold_world(n: int, rng: np.random.Generator, dt: float = 0.05, sigma: float = 0.12, period: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """A double well whose forcing drifts to the fold and back: state and jumps, which slow down before they come."""
    x, jump, cur = np.empty(n), np.zeros(n, int), -1.0
    z = rng.standard_normal(n) * sigma * math.sqrt(dt)
    for i in range(n):
        force = 0.45 * math.sin(2 * math.pi * i / period)
        new = cur + (cur - cur**3 + force) * dt + z[i]
        jump[i] = int(cur * new < 0)
        x[i] = cur = new
    return x, jump


def shock_world(n: int, rng: np.random.Generator, phi: float = 0.85, rate: float = 1 / 400) -> tuple[np.ndarray, np.ndarray]:
    """AR(1) with sudden shocks and no slowing before them."""
    jump = (rng.random(n) < rate).astype(int)
    x, cur = np.empty(n), 0.0
    for i, z in enumerate(rng.standard_normal(n) * 0.1 - 1.5 * jump):
        cur = phi * cur + z
        x[i] = cur
    return x, jump


def harvest_world(n: int, unharvested: bool, rng: np.random.Generator, edge: float = 0.12) -> dict[str, np.ndarray]:
    """Discrete features and a sign; ``regime`` is harvested, ``extra`` holds more only if told. ``gap_bits`` is the true difference."""
    regime, extra, junk = rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 3, n)
    lift = edge if unharvested else 0.0
    p = 0.5 + edge * (2 * regime - 1) + lift * (2 * extra - 1)
    sign = np.where(rng.random(n) < p, 1, -1)
    h = lambda q: -(q * np.log2(q) + (1 - q) * np.log2(1 - q))
    full = np.mean([h(0.5 + edge * a + lift * b) for a in (-1, 1) for b in (-1, 1)])
    part = np.mean([h(0.5 + edge * a) for a in (-1, 1)])
    return {"regime": regime, "extra": extra, "junk": junk, "sign": sign, "gap_bits": np.full(n, part - full)}


# ---- agent market


@dataclass(frozen=True)
class Market:
    """What the agents do and how strongly.

    Fixed values: strengths, scales, caps and speeds must equal those of the published
    experiment for its outcomes to be comparable.
    """

    # price formation and noise
    impact: float = 1.0
    noise: float = 0.005
    value_step: float = 0.006
    # strengths: pull to value, trend, volatility targets, liquidity
    pull: float = 0.15
    trend: float = 0.003
    trend_scale: float = 0.01
    trend_speed: float = 1 / 10
    targets: float = 0.06
    target_vol: float = 0.010
    most_leverage: float = 3.0
    vol_speed: float = 1 / 8
    liquidity: float = 0.30
    # anticipators of the flow of volatility targets: share, capital of a layer, noise of execution
    ahead: float = 0.25
    capital: float = 0.01
    ahead_noise: float = 0.001
    # speeds of the cohorts where horizons differ
    cohorts: tuple[float, ...] = (1 / 5, 1 / 20, 1 / 80)

    def leverage(self, var: np.ndarray) -> np.ndarray:
        return np.minimum(self.most_leverage, self.target_vol / np.maximum(np.sqrt(var), 1e-5))

    def flow_to_come(self, var: np.ndarray) -> np.ndarray:
        """What volatility targets have yet to trade until variance is back at their target, mean over cohorts."""
        return self.targets * (min(self.most_leverage, 1.0) - self.leverage(var)).mean(axis=-1)

    def anticipated(self, var: np.ndarray, layers: int = 1) -> np.ndarray:
        """Holding of all layers of anticipators: each takes its share of what the ones below it have left of
        the flow to come, within its own capital."""
        flow = left = self.flow_to_come(var)
        for _ in range(max(layers, 1)):
            left = left - np.clip(self.ahead * left, -self.capital, self.capital)
        return flow - left


#: Configurations by the flows that are on: G noise, F value, C trend, V volatility targets, M makers, H cohorts of horizons, A anticipators.
CONFIGS = {"G": "", "F": "F", "FC": "FC", "FV": "FV", "FCV": "FCV", "FCVM": "FCVM", "FCVMH": "FCVMH", "FCVMA": "FCVMA"}


def agent_market(flows: str, seeds: list[int], n: int = 6000, layers: int = 1, lean: float = 0.0, market: Market = Market()) -> np.ndarray:
    """Returns (len(seeds), n): all seeds advance together as one vector, each with its own noise.

    Orders of day t know returns up to the day before. With ``lean`` makers move their
    quotes by that share of the impact of the flow to come; only the change of the quote
    is part of a day's return. A day draws its step of value, its noise and, with
    anticipators, that of their execution, in this order, as in the published runs.
    """
    kinds = 3 if "A" in flows else 2
    draws = np.stack([np.random.default_rng(x).standard_normal((n, kinds)) for x in seeds])
    value = market.value_step * draws[:, :, 0].cumsum(axis=1)
    noise, late = market.noise * draws[:, :, 1], market.ahead_noise * draws[:, :, -1]
    many = "H" in flows
    fast = np.array(market.cohorts if many else (market.trend_speed,))
    slow = np.array(market.cohorts if many else (market.vol_speed,))
    out = np.zeros((len(seeds), n))
    drift = np.zeros((len(seeds), len(fast)))
    var = np.full((len(seeds), len(slow)), market.target_vol**2)
    price = before = held = quoted = np.zeros(len(seeds))
    geared = market.leverage(var)
    for t in range(n):
        drift = drift + fast * (before[:, None] - drift)
        var = var + slow * (before[:, None] ** 2 - var)
        orders = [noise[:, t]]
        if "F" in flows:
            orders.append(market.pull * (value[:, t] - price))
        if "C" in flows:
            orders.append(market.trend * np.tanh(drift.mean(axis=1) / market.trend_scale))
        if "V" in flows:
            wanted = market.leverage(var)
            orders.append(market.targets * (wanted - geared).mean(axis=1))
            geared = wanted
        if "M" in flows:
            orders.append(-market.liquidity * before)
        if "A" in flows:
            wish = market.anticipated(var, layers)
            orders.append(wish - held + late[:, t])
            held = wish
        move = market.impact * sum(orders)
        if lean:
            quote = lean * market.impact * market.flow_to_come(var)
            move, quoted = move + quote - quoted, quote
        out[:, t] = before = np.clip(move, -0.25, 0.25)
        price = price + before
    return out


# ---- stylised facts


def acf(x: np.ndarray, k: int) -> float:
    d = x - x.mean()
    return float((d[k:] * d[:-k]).mean() / max(d.var(), 1e-18)) if k < len(x) else 0.0


def kurt(x: np.ndarray) -> float:
    n, d = len(x), x - x.mean()
    g = (d**4).mean() / max((d * d).mean() ** 2, 1e-30) - 3
    return float((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def symbols(x: np.ndarray, bins: int = 3) -> np.ndarray:
    return np.searchsorted(np.quantile(x, np.arange(1, bins) / bins), x, side="right")


def entropy_production(s: np.ndarray, n: int = 3, bins: int = 3, alpha: float = 0.5) -> float:
    """Divergence of forward from reversed n-grams, bits per step."""
    rows = np.lib.stride_tricks.sliding_window_view(s, n)
    base = bins ** np.arange(n)
    cells = lambda c: (np.bincount(c, minlength=bins**n) + alpha) / (len(c) + alpha * bins**n)
    p, q = cells(rows @ base[::-1]), cells(rows @ base)
    return float((p * np.log2(p / q)).sum() / n)


def ep_test(x: np.ndarray, draws: int = 200, block: int = 126, rng: np.random.Generator | None = None, bins: int = 3) -> tuple[float, float, bool]:
    """Entropy production, the 95 % point of its null of randomly reversed blocks, and whether it is above it."""
    rng = rng or np.random.default_rng(0)
    s = symbols(x, bins)
    ep = entropy_production(s, bins=bins)
    parts = [s[i : i + block] for i in range(0, len(s), block)]
    null = [entropy_production(np.concatenate([p[::-1] if rng.random() < 0.5 else p for p in parts]), bins=bins) for _ in range(draws)]
    top = float(np.quantile(null, 0.95))
    return ep, top, ep > top


def direction_test(codes: np.ndarray, sign: np.ndarray, draws: int = 200, rng: np.random.Generator | None = None) -> tuple[float, bool]:
    """Bits about the next sign net of shuffles, and whether they are significant."""
    rng = rng or np.random.default_rng(0)
    mi = plugin_mi(codes, sign)
    null = np.array([plugin_mi(codes, rng.permutation(sign)) for _ in range(draws)])
    return float((mi - null.mean()) / math.log(2)), bool(mi > np.quantile(null, 0.95))


#: The ten stylised facts with the statistics and limits that define them.
FACTS = (
    ("returns hardly correlate", lambda x: -0.15 <= x["ac1"] <= 0.05),
    ("tails are fat", lambda x: 4.5 <= x["kurt"] <= 40),
    ("sizes correlate, and for long", lambda x: x["ac1_abs"] >= 0.12 and x["ac_slow"] >= 0.05),
    ("weekly volatility remembers eight weeks", lambda x: x["ac8_week"] >= 0.12),
    ("losses raise volatility", lambda x: x["leverage"] <= -0.03),
    ("tails go with volatility scaled out", lambda x: x["kurt_z"] <= 5),
    ("shocks of volatility point up", lambda x: x["skew_week"] >= -0.35),
    ("time has an arrow, mostly that of volatility", lambda x: x["arrow"] and x["ep_z"] <= 0.75 * x["ep_r"]),
    ("direction is not foretold", lambda x: not x["foretold"]),
    ("large losses outnumber large gains", lambda x: x["tail_asym"] >= 1.25),
)


def battery(r: np.ndarray, seed: int = 0, draws: int = 120) -> dict[str, float]:
    """The statistics of daily returns behind the stylised facts, the facts as 0/1 (E1 to E10) and their number."""
    rng = np.random.default_rng(seed)
    size = np.abs(r)
    # trailing variance of five days, from the first day that has five before it on
    var = np.maximum(np.lib.stride_tricks.sliding_window_view(r * r, 5).mean(axis=1), 1e-12)
    x = r[4:]
    scaled = x / np.sqrt(var)
    weeks = np.log(np.maximum(r[: len(r) // 5 * 5] ** 2, 1e-12)).reshape(-1, 5).mean(axis=1)
    centred = weeks - weeks.mean()
    phi = np.cov(centred[:-1], centred[1:])[0, 1] / max(centred[:-1].var(), 1e-18)
    shocks = centred[1:] - phi * centred[:-1]
    past = np.lib.stride_tricks.sliding_window_view(r, 21).sum(axis=1)
    thirds = np.argsort(np.argsort(var[16:])) * 3 // len(past)
    state = 9 * (np.sign(r[20:]) + 1) + 3 * (np.sign(past) + 1) + thirds
    far = 2.5 * r.std()
    ep_r, _, arrow = ep_test(r, draws, rng=rng)
    ep_z, _, _ = ep_test(scaled, draws, rng=rng)
    bits, foretold = direction_test(state[:-1].astype(int), np.sign(r[21:]).astype(int), draws, rng)
    found = {
        "ac1": acf(r, 1),
        "kurt": kurt(r) + 3,
        "kurt_z": kurt(scaled) + 3,
        "ac1_abs": acf(size, 1),
        "ac_slow": float(np.mean([acf(size, k) for k in range(5, 21)])),
        "ac8_week": acf(weeks, 8),
        "skew_week": float((shocks**3).mean() / max(shocks.std() ** 3, 1e-18)),
        "leverage": float(np.mean([np.corrcoef(x[:-k], var[k:])[0, 1] for k in range(1, 11)])),
        "tail_asym": float((r < -far).sum() / max((r > far).sum(), 1)),
        "ep_r": ep_r, "ep_z": ep_z, "arrow": arrow, "bits": bits, "foretold": foretold,
    }
    facts = [float(holds(found)) for _, holds in FACTS]
    return {k: float(v) for k, v in found.items()} | {f"E{k}": v for k, v in enumerate(facts, 1)} | {"score": sum(facts)}
