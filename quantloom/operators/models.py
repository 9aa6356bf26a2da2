"""Grouped-map operators: one ordered series (or one grid cell) per group, NumPy inside.

A series is one group by nature, since each step needs the one before; series,
configurations and seeds run in parallel. Results are tables of plain columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import trailing
from ..kernels import hmm as H
from ..kernels import information as N
from ..kernels import numeric as K
from ..kernels import portfolio as O
from ..kernels import volmodels as M
from ..kernels import worlds as W


def per_series(x: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "date") -> DataFrame:
    """``fn`` on each group in order; the keys are put in front of what it returns."""
    head = ", ".join(f"`{k}` {x.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values(order, kind="stable").reset_index(drop=True))
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return x.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def grid(spark: SparkSession, rows: list[tuple], ddl: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Fan-out: one task group per grid row (first column is the cell's id)."""
    g = spark.createDataFrame(rows, ddl)
    cell = g.columns[0]
    return g.repartition(len(rows), cell).groupBy(cell).applyInPandas(lambda p: fn(p), schema)


# ---- regimes


def features(rets: DataFrame, window: int = 10, by: tuple[str, ...] = ("u",)) -> DataFrame:
    """Return and log of the trailing annual volatility (floored)."""
    w = trailing(window, by)
    vol = F.when(F.count("r").over(w) >= window, F.stddev_samp("r").over(w) * (252**0.5))
    return rets.withColumn("logvol", F.when(vol.isNotNull(), F.log(F.greatest(vol, F.lit(1e-4))))).where("logvol is not null")


ENGINES: dict[str, Callable[[], H.HMM]] = {
    "gaussian": lambda: H.HMM(),
    "student": lambda: H.HMM(student=True),
    "duration": lambda: H.HMM(sub=3),
}


def regimes(feats: DataFrame, engine: str = "student", k: int = 3, first: int = 750, every: int = 21, by: str = "u") -> DataFrame:
    """Walk-forward regimes: filtered probabilities, confirmed regime and the predictive log-density of each return."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x = p[["r", "logvol"]].to_numpy(float)

        def make() -> H.HMM:
            m = ENGINES[engine]()
            m.k = k
            return m

        got = H.walk_forward(x, make, first, every)
        probs = got["filtered"] if got["filtered"].shape[1] == k else np.full((len(x), k), np.nan)
        state = H.Hysteresis()
        return pd.DataFrame({"date": p["date"], "probs": [v.tolist() if np.isfinite(v).all() else None for v in probs], "regime": [state.step(v) for v in probs], "logscore": got["score"]})

    return per_series(feats, [by], fn, "date timestamp, probs array<double>, regime int, logscore double")


def jump_regimes(feats: DataFrame, jump: float = 16.0, first: int = 750, every: int = 21, by: str = "u") -> DataFrame:
    """Walk-forward jump model: causal states and predictive log-densities; refits start cold."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x = p[["r", "logvol"]].to_numpy(float)
        state, score = np.full(len(x), -1), np.full(len(x), np.nan)
        for t in range(first, len(x), every):
            end = min(t + every, len(x))
            m = H.JumpModel(jump=jump).fit(x[:t])
            s = m.online(x[:end])
            state[t - 1 : end] = s[t - 1 :]
            score[t:end] = m.predictive_logpdf(s[t - 1 : end - 1], x[t:end, 0])
        return pd.DataFrame({"date": p["date"], "regime": state, "logscore": score})

    return per_series(feats, [by], fn, "date timestamp, regime int, logscore double")


def horserace(feats: DataFrame, first: int = 750, every: int = 63) -> DataFrame:
    """Mean predictive log score by engine; engines run as parallel groups."""
    engines = feats.sparkSession.createDataFrame([(e,) for e in (*ENGINES, "jump")], "engine string")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x, e = p[["r", "logvol"]].to_numpy(float), p["engine"].iloc[0]
        if e == "jump":
            score = jump_scores(x, 16.0, first, every)
        else:
            score = H.walk_forward(x, ENGINES[e], first, every)["score"]
        ok = np.isfinite(score)
        return pd.DataFrame({"n": [int(ok.sum())], "mean_logscore": [float(score[ok].mean()) if ok.any() else np.nan]})

    return per_series(feats.crossJoin(engines), ["engine"], fn, "n long, mean_logscore double")


def features_range(rets: DataFrame, gk: DataFrame, window: int = 10, least: int = 5) -> DataFrame:
    """Return and log of the annual volatility from the market's mean range variance (floored)."""
    mk = gk.where("gk_var is not null").groupBy("date").agg(F.avg("gk_var").alias("gk_var"))
    w = trailing(window, ("u",))
    vol = F.when(F.count("gk_var").over(w) >= least, F.sqrt(F.avg("gk_var").over(w) * 252))
    return rets.join(mk, "date").withColumn("logvol", F.when(vol.isNotNull(), F.log(F.greatest(vol, F.lit(1e-4))))).where("logvol is not null").select("u", "date", "r", "logvol")


#: Regime models by name: Gaussian and Student-t with two to five states, durations, jumps.
REGIME_MODELS: dict[str, Callable[[], H.HMM] | None] = {
    **{f"G{k}": (lambda k=k: H.HMM(k=k)) for k in (2, 3, 4, 5)},
    **{f"T{k}": (lambda k=k: H.HMM(k=k, student=True)) for k in (2, 3, 4, 5)},
    "Dur3x3": lambda: H.HMM(sub=3),
    "SJM3": None,
}


def jump_scores(x: np.ndarray, jump: float, first: int, every: int) -> np.ndarray:
    """Log-density of each next return under the jump model, refitted on expanding windows."""
    score = np.full(len(x), np.nan)
    for t in range(first, len(x), every):
        m, end = H.JumpModel(jump=jump).fit(x[:t]), min(t + every, len(x))
        score[t:end] = m.predictive_logpdf(m.online(x[:end])[t - 1 : end - 1], x[t:end, 0])
    return score


def model_scores(feats: DataFrame, first: int = 750, every: int = 21) -> DataFrame:
    """u, model, date, logscore: walk-forward predictive log-densities of all regime models; a model is one group."""
    names = feats.sparkSession.createDataFrame([(m,) for m in REGIME_MODELS], "model string")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x, make = p[["r", "logvol"]].to_numpy(float), REGIME_MODELS[p["model"].iloc[0]]
        score = jump_scores(x, 16.0, first, every) if make is None else H.walk_forward(x, make, first, every)["score"]
        return pd.DataFrame({"date": p["date"], "logscore": score})[np.isfinite(score)]

    return per_series(feats.crossJoin(F.broadcast(names)), ["u", "model"], fn, "date timestamp, logscore double")


def scores_confidence_set(scores: DataFrame, alpha: float = 0.1, draws: int = 1000) -> DataFrame:
    """Per model: mean log score, p-value and whether it stays in the confidence set of the best."""
    models = list(REGIME_MODELS)

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        wide = p.pivot(index="date", columns="model", values="logscore")[models].dropna().to_numpy()
        if len(wide) < 2:
            return pd.DataFrame({"model": models, "score": np.nan, "p": np.nan, "kept": 0})
        alive, pv = N.confidence_set(-wide, alpha, draws)
        return pd.DataFrame({"model": models, "score": wide.mean(0), "p": [pv[k] for k in range(len(models))], "kept": [int(k in alive) for k in range(len(models))]})

    return per_series(scores, ["u"], fn, "model string, score double, p double, kept int")


def jump_penalties(feats: DataFrame, penalties=(2.0, 4.0, 8.0, 16.0, 32.0, 64.0), first: int = 750, every: int = 21, tune: float = 0.5) -> DataFrame:
    """Mean score by penalty on the first ``tune`` part of the predictions, which choose it; the rest stays unseen."""
    dim = feats.sparkSession.createDataFrame([(v,) for v in penalties], "penalty double")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x = p[["r", "logvol"]].to_numpy(float)
        score = jump_scores(x[: first + int(max(len(x) - first, 0) * tune)], float(p["penalty"].iloc[0]), first, every)
        ok = np.isfinite(score)
        return pd.DataFrame({"n": [int(ok.sum())], "score": [float(score[ok].mean()) if ok.any() else np.nan]})

    got = per_series(feats.crossJoin(F.broadcast(dim)), ["u", "penalty"], fn, "n int, score double")
    best = F.row_number().over(Window.partitionBy("u").orderBy(F.desc_nulls_last("score"), "penalty")) == 1
    return got.withColumn("chosen", best.cast("int"))


def spectral_ratios(gk: DataFrame, window: int = 60) -> DataFrame:
    """Power of log volatility below a quarter of the frequencies over that above, in each trailing window of past rows."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x = 0.5 * np.log(p["gk_var"].to_numpy(float))
        if len(x) <= window:
            return pd.DataFrame({"date": p["date"], "ratio": np.nan})
        past = np.lib.stride_tricks.sliding_window_view(x, window)[:-1]
        f = np.abs(np.fft.rfft(past - past.mean(1, keepdims=True), axis=1)) ** 2
        cut = f.shape[1] // 4
        low, high = f[:, 1:cut].sum(1), f[:, cut:].sum(1)
        ratio = np.divide(low, high, out=np.full(len(low), np.nan), where=high > 0)
        return pd.DataFrame({"date": p["date"], "ratio": np.concatenate([np.full(window, np.nan), ratio])})

    return per_series(gk.where("gk_var is not null"), ["asset"], fn, "date timestamp, ratio double")


# ---- volatility


def variance_forecasts(x: DataFrame, first: int = 750, every: int = 63, by: str = "asset") -> DataFrame:
    """Forecasts of next-row variance (needs r and gk_var) by four models."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        got = M.walk_forward_variance(p["r"].to_numpy(float), p["gk_var"].to_numpy(float), first, every, 3 * every)
        return pd.DataFrame({"date": p["date"], "rv": p["gk_var"], **got})

    rows = x.where("r is not null and gk_var is not null")
    return per_series(rows, [by], fn, "date timestamp, rv double, ewma double, har double, garch double, rough double")


def ewma_variance(x: DataFrame, lam: float = 0.94, by: str = "asset") -> DataFrame:
    """Recursive variance after each row."""
    fn = lambda p: pd.DataFrame({"date": p["date"], "s2": M.Ewma(lam).run(p["r"].to_numpy(float))})
    return per_series(x.where("r is not null"), [by], fn, "date timestamp, s2 double")


def ewm_moments(x: DataFrame, halflife: float = 21.0, value: str = "r", by: str = "asset") -> DataFrame:
    """Exponentially weighted mean and bias-corrected deviation."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        m = M.EwmMoments(halflife)
        out = [m.step(v) for v in p[value].to_numpy(float)]
        return pd.DataFrame({"date": p["date"], "ewm_mean": [a for a, _ in out], "ewm_std": [b for _, b in out]})

    return per_series(x.where(F.col(value).isNotNull()), [by], fn, "date timestamp, ewm_mean double, ewm_std double")


def exposure(rets: DataFrame, target: float = 0.13, cap: float = 1.5, span: int = 5, halflife: float = 21.0, by: str = "u", forecast: bool = False, tilt: float = 0.0) -> DataFrame:
    """Lever (target over trailing volatility, or over its forecast) times the brakes (column brake),
    smoothed and capped; for the next row. With a tilt the product leans by that share with the
    sign of the market's momentum (column momentum), inside the cap."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        vol, smooth = M.EwmMoments(halflife), M.EwmMoments.of_span(span)
        r = p["r"].to_numpy(float)
        ahead = M.lever_vol(r) if forecast else np.array([vol.step(v)[1] * 252**0.5 for v in r])
        lean = 1 + tilt * np.sign(np.nan_to_num(p["momentum"].to_numpy(float))) if tilt else np.ones(len(p))
        lever, out = [], []
        for s, b, m in zip(ahead, p["brake"], lean, strict=True):
            lever.append(min(target / s, cap) if s == s and s > 0 else 1.0)
            out.append(min(max(smooth.step(lever[-1] * b * m)[0], 0.0), cap))
        return pd.DataFrame({"date": p["date"], "lever": lever, "exposure": out})

    return per_series(rets, [by], fn, "date timestamp, lever double, exposure double")


def hawkes_fits(events: DataFrame, by: list[str]) -> DataFrame:
    """Branching ratio of each event stream (column pos)."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(p["pos"].to_numpy(float))
        return pd.DataFrame({"events": [len(t)], **{k: [v] for k, v in M.fit_hawkes(t, float(p["horizon"].iloc[0])).items()}})

    return per_series(events, by, fn, "events long, mu double, n double, beta double", order="pos")


def hawkes_recovery(spark: SparkSession, grid_n=(0.2, 0.4, 0.6, 0.8), horizon: float = 2000.0, rate: float = 0.1, reps: int = 4, seed: int = 0) -> DataFrame:
    """Mean fitted branching ratio for each true one."""
    rows = [(i * reps + k, float(n)) for i, n in enumerate(grid_n) for k in range(reps)]

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        n = p["n"].iloc[0]
        t = M.simulate_hawkes(rate * (1 - n), n, 0.5, horizon, W.rng_of(seed, int(p["cell"].iloc[0])))
        return pd.DataFrame({"n": [n], "fitted": [M.fit_hawkes(t, horizon)["n"]]})

    return grid(spark, rows, "cell int, n double", fn, "n double, fitted double").groupBy("n").agg(F.avg("fitted").alias("fitted"))


def t_tails(x: DataFrame, value: str, by: str = "asset") -> DataFrame:
    """Student-t fit per series."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        loc, scale, nu = K.t_fit(p[value].to_numpy(float))
        return pd.DataFrame({"loc": [loc], "scale": [scale], "nu": [nu]})

    return per_series(x.where(F.col(value).isNotNull()), [by], fn, "loc double, scale double, nu double")


# ---- portfolios


def rebalance_windows(rets: DataFrame, window: int = 252, every: int = 21) -> DataFrame:
    """Rows of each trailing window, keyed by its last date (``at``); windows overlap, so a row is in several.

    Dates are numbered once; a row goes to the rebalances of the next ``window`` rows."""
    n = rets.select("date").distinct().withColumn("u", F.lit(0)).withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("date"))).drop("u")
    top = n.agg(F.max("i").alias("top"))
    x = rets.join(n, "date").join(F.broadcast(top))
    first = F.greatest(F.ceil((F.col("i") - window) / every).cast("int"), F.lit(0))
    last = F.floor((F.least(F.col("i") + window - 1, F.col("top")) - window) / every).cast("int")
    k = F.explode(F.when(last >= first, F.sequence(first, last)))
    rows = x.withColumn("k", k).where(F.col("i") > F.col("k") * every)
    rows = rows.where(F.col("i") <= F.col("k") * every + window)
    ends = n.select((F.col("i") - window).alias("e"), F.col("date").alias("at")).where(F.col("e") % every == 0).select((F.col("e") / every).cast("int").alias("k"), "at")
    return rows.join(F.broadcast(ends), "k").select("at", "asset", "date", "r")


def _matrix(p: pd.DataFrame) -> pd.DataFrame:
    return p.pivot(index="date", columns="asset", values="r").fillna(0.0)


def portfolio_weights(windows: DataFrame, method: str = "hrp", signal: str | None = None, cap: float = 0.35) -> DataFrame:
    """Weights per window by hrp, bl (HRP with views from the last rows), minvar, rmt or cvar."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(p)
        r = m.to_numpy()
        cov = O.shrunk_cov(r)
        if method == "hrp":
            w = O.hrp_weights(cov)
        elif method == "bl":
            z = r[-63:].sum(0)
            w = O.construct(cov, np.clip((z - z.mean()) / max(z.std(ddof=1), 1e-12), -3, 3), cap)
        elif method == "minvar":
            w = O.min_variance(cov)
        elif method == "rmt":
            w = O.min_variance(O.denoise_cov(np.cov(r.T), len(r)))
        else:
            w = O.min_cvar(r, cap=cap, rounds=600)
        return pd.DataFrame({"asset": m.columns, "w": w})

    return per_series(windows, ["at"], fn, "asset string, w double")


def spectrum(windows: DataFrame) -> DataFrame:
    """Eigenvalues of each window's correlation matrix, the noise edge and the number of factors."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        r = _matrix(p).to_numpy()
        eig = np.linalg.eigvalsh(np.corrcoef(r.T))
        k, s2 = O.signal_factors(eig, r.shape[1] / len(r))
        return pd.DataFrame({"eigenvalues": [eig.tolist()], "noise_var": [s2], "edge": [O.mp_edge(r.shape[1] / len(r), s2)], "factors": [k]})

    return per_series(windows, ["at"], fn, "eigenvalues array<double>, noise_var double, edge double, factors int")


def ou_signals(windows: DataFrame) -> DataFrame:
    """Mean-reversion scores of residuals per window."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(p)
        s = O.ou_scores(m.to_numpy())
        return pd.DataFrame({"asset": m.columns, "s": s["s"], "s_raw": s["s_raw"], "b": s["b"], "halflife": s["halflife"]})

    return per_series(windows, ["at"], fn, "asset string, s double, s_raw double, b double, halflife double")


def estimator_bakeoff(rets: DataFrame, window: int = 252, every: int = 21) -> DataFrame:
    """Realised volatility of minimum-variance books by covariance estimator over the rows after each window."""
    both = rebalance_windows(rets, window + every, every)

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        r = _matrix(p).to_numpy()
        a, b = r[:-every], r[-every:]
        s = np.cov(a.T)
        est = {"sample": s, "shrunk": O.shrunk_cov(a), "rmt": O.denoise_cov(s, len(a)), "shrunk_rmt": O.denoise_cov(O.shrunk_cov(a), len(a))}
        return pd.DataFrame({"estimator": list(est), "var": [float((b @ O.min_variance(c)).var()) for c in est.values()]})

    return per_series(both, ["at"], fn, "estimator string, var double").groupBy("estimator").agg((F.sqrt(F.avg("var")) * 252**0.5).alias("realised_vol"))


# ---- pairs and experts


def kalman_pairs(prices: DataFrame, pairs: list[tuple[str, str]], burn: int = 252) -> DataFrame:
    """z-scores, slopes, positions and actions per pair; the first ``burn`` rows only warm the filter."""
    spark = prices.sparkSession
    dim = spark.createDataFrame([(f"{a}/{b}", a, b) for a, b in pairs], "pair string, a string, b string")
    y = prices.select("date", F.col("asset").alias("a"), F.log("close").alias("y"))
    x = prices.select("date", F.col("asset").alias("b"), F.log("close").alias("x"))
    rows = y.join(F.broadcast(dim), "a").join(x, ["date", "b"])

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        head = p.iloc[:burn]
        slope = np.polyfit(head["x"], head["y"], 1)
        k, trader = M.KalmanPair(float((head["y"] - np.polyval(slope, head["x"])).var())), M.SpreadTrader()
        z, beta, pos, act = [], [], [], []
        for i, (a, b) in enumerate(zip(p["y"], p["x"], strict=True)):
            s, t = k.step(a, b)
            z.append(s)
            beta.append(float(np.clip(t, 0.2, 3.0)))
            act.append(trader.step(s) if i >= burn else None)
            pos.append(trader.position)
        return pd.DataFrame({"date": p["date"], "z": z, "beta": beta, "position": pos, "action": act})

    return per_series(rows, ["pair"], fn, "date timestamp, z double, beta double, position int, action string")


def hedge_weights(experts: DataFrame, eta: float = 0.05, share: float = 0.005) -> DataFrame:
    """Weights of experts (u, date, expert, r) before each row, and the book's return."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index="date", columns="expert", values="r").fillna(0.0)
        scale = max(float(np.abs(m.to_numpy()[:63]).mean()), 1e-9)
        h, w, out = M.Hedge(m.shape[1], eta, share), np.full(m.shape[1], 1 / m.shape[1]), []
        for g in m.to_numpy():
            out.append((w.tolist(), float(w @ g)))
            w = h.step(g / scale)
        return pd.DataFrame({"date": m.index, "weights": [a for a, _ in out], "r": [b for _, b in out]})

    return per_series(experts, ["u"], fn, "date timestamp, weights array<double>, r double")


# ---- information and irreversibility


def knn_information(x: DataFrame, a: str, b: str, shuffles: int = 5, by: str = "asset", seed: int = 0) -> DataFrame:
    """Nearest-neighbour information net of shuffles per series."""
    fn = lambda p: pd.DataFrame({"n": [len(p)], "nats": [N.ksg_net(p[a].to_numpy(float), p[b].to_numpy(float), shuffles, seed=seed)]})
    return per_series(x.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [by], fn, "n long, nats double")


def entropy_test(x: DataFrame, value: str, draws: int = 200, by: str = "asset", seed: int = 0) -> DataFrame:
    """Entropy production per series with its null of reversed blocks."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        ep, top, sig = W.ep_test(p[value].to_numpy(float), draws, rng=np.random.default_rng(seed))
        return pd.DataFrame({"ep": [ep], "null95": [top], "significant": [int(sig)]})

    return per_series(x.where(F.col(value).isNotNull()), [by], fn, "ep double, null95 double, significant int")


def direction_bits(x: DataFrame, codes: str, sign: str, draws: int = 200, by: str = "asset", seed: int = 0) -> DataFrame:
    """Bits about the next sign per series, net and tested against permutations."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        bits, sig = W.direction_test(p[codes].to_numpy(), p[sign].to_numpy(), draws, np.random.default_rng(seed))
        return pd.DataFrame({"bits": [bits], "significant": [int(sig)]})

    return per_series(x, [by], fn, "bits double, significant int")


def incremental_scores(x: DataFrame, base: list[str], more: list[str], label: str = "label", every: int = 252, first: int = 756, embargo: int = 20, by: str = "asset") -> DataFrame:
    """Walk-forward logistic scores of each row without (base) and with (all) the further features, and its label."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        y, f = p[label].to_numpy(float), {"base": p[base].to_numpy(float), "all": p[[*base, *more]].to_numpy(float)}
        out = {k: np.full(len(p), np.nan) for k in f}
        for t in range(first, len(p), every):
            for k, z in f.items():
                tr = slice(0, t - embargo)
                mu, sd = z[tr].mean(0), np.maximum(z[tr].std(0), 1e-12)
                if 0 < y[tr].sum() < t - embargo:
                    w = K.logistic_fit((z[tr] - mu) / sd, y[tr])
                    out[k][t : t + every] = w[0] + (z[t : t + every] - mu) / sd @ w[1:]
        ok = np.isfinite(out["base"])
        return pd.DataFrame({"date": p["date"], "base": out["base"], "all": out["all"], "label": y})[ok]

    full = x.where(F.col(label) >= 0)
    for c in (*base, *more):
        full = full.where(F.col(c).isNotNull())
    return per_series(full, [by], fn, "date timestamp, base double, all double, label double")


def incremental_auc(x: DataFrame, base: list[str], more: list[str], label: str = "label", every: int = 252, first: int = 756, embargo: int = 20, by: str = "asset") -> DataFrame:
    """Areas under the curve of the walk-forward scores with and without the further features; null where a label is missing."""
    from .events import auc

    s = incremental_scores(x, base, more, label, every, first, embargo, by)
    a, b = (auc(s, c, "label", (by,)).withColumnRenamed("auc", f"auc_{c}") for c in ("base", "all"))
    n = s.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(a, by).join(b, by).withColumn("gain", F.col("auc_all") - F.col("auc_base"))


# ---- agent market


def agent_batteries(spark: SparkSession, seeds: int = 8, rows: int = 6000, configs: dict[str, str] | None = None, seed0: int = 100, draws: int = 120) -> DataFrame:
    """Stylised-fact scores per configuration and seed; a cell is one group."""
    cells = [(i, name, flows, seed0 + k) for i, ((name, flows), k) in enumerate((c, k) for c in (configs or W.CONFIGS).items() for k in range(seeds))]
    events = ", ".join(f"E{k} double" for k in range(1, 11))

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        row = p.iloc[0]
        b = W.battery(W.agent_market(row["flows"], [int(row["seed"])], rows)[0], int(row["seed"]), draws)
        return pd.DataFrame({"config": [row["config"]], "seed": [int(row["seed"])], **{k: [b[k]] for k in ("kurt", "leverage", "ac8_week", *[f"E{k}" for k in range(1, 11)], "score")}})

    return grid(spark, cells, "cell int, config string, flows string, seed int", fn, f"config string, seed int, kurt double, leverage double, ac8_week double, {events}, score double")


def majority_scores(batteries: DataFrame) -> DataFrame:
    """Number of events that most seeds of a configuration pass."""
    ev = [f"E{k}" for k in range(1, 11)]
    g = batteries.groupBy("config").agg(F.count(F.lit(1)).alias("seeds"), *[(F.sum(e) * 2 > F.count(F.lit(1))).cast("int").alias(e) for e in ev], F.median("kurt").alias("kurt"))
    return g.withColumn("score", sum((F.col(e) for e in ev), F.lit(0)))
