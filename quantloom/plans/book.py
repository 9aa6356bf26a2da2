"""The books: walk-forward backtest with the risk overlay, single-signal sleeves, pairs and residual sleeves, and the trading system.

Targets of all rebalance dates are computed in parallel, one group per date. What depends
on the path (the no-trade band against drifted weights) runs in one ordered group per
book over rebalance dates only; between them drift has a closed form, so daily rows are
joined and summed by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ordered
from ..kernels import portfolio as O
from ..operators import models as X
from ..operators.risk import exposure_brakes
from ..operators.signals import combined
from ..staging import staged


@dataclass(frozen=True)
class BookConfig:
    """Knobs of the books; rates are a year, costs in basis points."""

    window: int = 252
    every: int = 21
    cap: float = 0.35
    band: float = 0.0025
    commission: float = 1.0
    spread: float = 2.0
    impact: float = 10.0
    impact_cap: float = 25.0
    target_vol: float = 0.13
    max_exposure: float = 1.5
    cvar_target: float = 0.018
    dd_start: float = 0.08
    dd_floor: float = 0.20
    floor: float = 0.25
    financing: float = 0.035
    forecast: bool = True
    tilt: float = 0.15


def target_weights(rets: DataFrame, signals: DataFrame, value: str, cfg: BookConfig = BookConfig()) -> DataFrame:
    """at, asset, w: the constructed portfolio at each rebalance; one group per date."""
    win = X.rebalance_windows(rets, cfg.window, cfg.every)
    s = signals.select(F.col("date").alias("at"), "asset", F.col(value).alias("z"))
    cap = cfg.cap

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index="date", columns="asset", values="r").fillna(0.0)
        z = p.groupby("asset")["z"].first().reindex(m.columns).fillna(0.0).to_numpy()
        return pd.DataFrame({"asset": m.columns, "w": O.construct(O.shrunk_cov(m.to_numpy()), z, cap)})

    return X.per_series(win.join(s, ["at", "asset"], "left"), ["at"], fn, "asset string, w double")


def holding_periods(ats: DataFrame, rets: DataFrame) -> DataFrame:
    """date, at, k: of each date the last rebalance before it and its number, carried forward over the dates.

    The dates are numbered in one ordered group of some thousand rows; rows join it by equality."""
    days = rets.select("date").unionByName(ats.select(F.col("at").alias("date"))).distinct().join(ats.select(F.col("at").alias("date"), F.lit(1).alias("new")), "date", "left")
    w = Window.partitionBy(F.lit("all")).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    held = days.withColumn("at", F.max(F.when(F.col("new") == 1, F.col("date"))).over(w)).withColumn("k", F.sum("new").over(w).cast("int"))
    return held.where("at is not null").select("date", "at", "k")


def traded(targets: DataFrame, rets: DataFrame, cfg: BookConfig = BookConfig(), banded: bool = True) -> DataFrame:
    """k, at, asset, w, dw: weights after trading at each rebalance, against the drifted weights of the one before.

    One ordered group: as many steps as there are rebalances."""
    ats = targets.select("at").distinct()
    days = ats.withColumn("k", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy("at")))
    held = rets.join(holding_periods(ats, rets), "date")
    growth = held.groupBy("k", "asset").agg(F.exp(F.sum("r")).alias("g"))
    rows = targets.join(days, "at").join(growth, ["k", "asset"], "left").withColumn("book", F.lit("book"))
    band = cfg.band if banded else 0.0

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        names, out = sorted(p["asset"].unique()), []
        cur = np.zeros(len(names))
        for (k, at), q in p.groupby(["k", "at"], sort=True):
            q = q.set_index("asset").reindex(names)
            d = q["w"].fillna(0.0).to_numpy() - cur
            new = np.maximum(cur + np.where(np.abs(d) < band, 0.0, d), 0.0)
            new = new / new.sum() if new.sum() > 0 else new
            out.append(pd.DataFrame({"k": int(k), "at": at, "asset": names, "w": new, "dw": new - cur}))
            cur = new * q["g"].fillna(1.0).to_numpy()
            cur = cur / cur.sum() if cur.sum() > 0 else cur
        return pd.concat(out)

    return X.per_series(rows, ["book"], fn, "k int, at timestamp, asset string, w double, dw double", order="k")


def daily_weights(trades: DataFrame, rets: DataFrame) -> DataFrame:
    """Weights at the start of each day after a rebalance, drifted in closed form, with the day's return.

    A book without any weight holds cash: all its weights are 0."""
    span = rets.join(holding_periods(trades.select("at").distinct(), rets).drop("at"), "date")
    x = span.join(trades.select("k", "asset", "w"), ["k", "asset"])
    w = Window.partitionBy("k", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    grown = x.withColumn("g", F.col("w") * F.exp(F.coalesce(F.sum("r").over(w), F.lit(0.0))))
    share = F.try_divide("g", F.sum("g").over(Window.partitionBy("k", "date")))
    return grown.withColumn("weight", F.coalesce(share, F.lit(0.0))).select("date", "k", "asset", "weight", "r")


def costs(trades: DataFrame, rets: DataFrame, cfg: BookConfig = BookConfig()) -> DataFrame:
    """Cost by the first date after each rebalance, as a return."""
    vol = rets.withColumn("vol", F.stddev_samp("r").over(ordered().rowsBetween(-59, 0))).withColumn("next", F.lead("date").over(ordered()))
    x = trades.join(vol.select(F.col("date").alias("at"), "asset", "vol", "next"), ["at", "asset"])
    hit = F.least(cfg.impact * F.coalesce("vol", F.lit(0.02)) / 0.01 * F.sqrt(F.abs("dw") / 0.01), F.lit(cfg.impact_cap))
    return x.groupBy(F.col("next").alias("date")).agg((F.sum(F.abs("dw") * (cfg.commission + cfg.spread + hit)) / 1e4).alias("cost"), F.sum(F.abs("dw")).alias("turnover"))


def momentum_of_market(rets: DataFrame, rows: int = 21) -> DataFrame:
    """date, momentum: sum of the equal-weight market's last returns; none before there are so many."""
    m = rets.groupBy("date").agg(F.avg("r").alias("m"))
    w = Window.partitionBy(F.lit("all")).orderBy("date").rowsBetween(-(rows - 1), 0)
    return m.select("date", F.when(F.count("m").over(w) >= rows, F.sum("m").over(w)).alias("momentum"))


def overlay(gross: DataFrame, cfg: BookConfig = BookConfig(), rets: DataFrame | None = None) -> DataFrame:
    """date, u, gross, exposure (of the day before) from the book's own returns, leaning with the market's momentum if ``rets`` are given."""
    b = exposure_brakes(gross, cfg.cvar_target, cfg.dd_start, cfg.dd_floor, cfg.floor)
    tilt = cfg.tilt if rets is not None else 0.0
    if tilt:
        b = b.join(momentum_of_market(rets), "date", "left")
    e = X.exposure(b, cfg.target_vol, cfg.max_exposure, forecast=cfg.forecast, tilt=tilt)
    x = gross.join(e.select("date", "lever", "exposure"), "date")
    lag = F.coalesce(F.lag("exposure").over(Window.partitionBy("u").orderBy("date")), F.lit(1.0))
    return x.select("date", "u", F.col("r").alias("gross"), "lever", lag.alias("exposure"))


def run_book(rets: DataFrame, regimes: DataFrame, cfg: BookConfig = BookConfig(), value: str = "combined") -> dict[str, DataFrame]:
    """Targets, trades, daily weights and the net returns of the walk-forward book; positions earn from the next day."""
    rets = staged(rets)
    sig = combined(rets, regimes)
    trades = staged(traded(target_weights(rets, sig, value, cfg), rets, cfg).drop("book"))
    daily = staged(daily_weights(trades, rets))
    gross = daily.groupBy("date").agg(F.sum(F.col("weight") * (F.exp("r") - 1)).alias("r")).withColumn("u", F.lit("book"))
    o = overlay(gross, cfg, rets).join(costs(trades, rets, cfg), "date", "left").na.fill(0.0, ["cost", "turnover"])
    fin = F.greatest(F.col("exposure") - 1, F.lit(0.0)) * (cfg.financing / 252)
    net = o.withColumn("net", F.col("gross") * F.col("exposure") - F.col("cost") - fin)
    return {"trades": trades, "daily": daily, "net": net}


def sleeves(rets: DataFrame, regimes: DataFrame, cfg: BookConfig = BookConfig()) -> DataFrame:
    """date, expert, r: books of the single signals without band and overlay."""
    rets = staged(rets)
    sig = staged(combined(rets, regimes))
    out = None
    for s in ("momentum", "mean_reversion", "low_vol"):
        t = traded(target_weights(rets, sig, s, cfg), rets, cfg, banded=False)
        d = daily_weights(t, rets).groupBy("date").agg(F.sum(F.col("weight") * (F.exp("r") - 1)).alias("r")).withColumn("expert", F.lit(s))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("u", F.lit("book"))


def gates_blend(experts: DataFrame, regimes: DataFrame, gates: dict[int, dict[str, float]]) -> DataFrame:
    """Sleeves weighted by the regime of the day before."""
    dim = experts.sparkSession.createDataFrame([(k, e, w) for k, m in gates.items() for e, w in m.items()], "regime int, expert string, gate double")
    lagged = regimes.withColumn("regime", F.lag("regime").over(Window.partitionBy("u").orderBy("date"))).select("date", "regime")
    return experts.join(lagged, "date").join(F.broadcast(dim), ["regime", "expert"]).groupBy("date").agg(F.sum(F.col("gate") * F.col("r")).alias("r"))


def pairs_sleeve(prices: DataFrame, kalman: DataFrame) -> DataFrame:
    """Returns of the pairs book: yesterday's positions over two half legs, equally over live pairs."""
    w = Window.partitionBy("pair").orderBy("date")
    ret = prices.withColumn("s", F.col("close") / F.lag("close").over(ordered()) - 1).select("date", "asset", "s")
    k = kalman.withColumn("p", F.lag("position").over(w)).withColumn("b", F.lag("beta").over(w)).withColumn("a1", F.split("pair", "/")[0]).withColumn("a2", F.split("pair", "/")[1])
    x = k.join(ret.select("date", F.col("asset").alias("a1"), F.col("s").alias("s1")), ["date", "a1"]).join(ret.select("date", F.col("asset").alias("a2"), F.col("s").alias("s2")), ["date", "a2"])
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return x.withColumn("pnl", F.coalesce(F.col("p") * 0.5 * (F.col("s1") - F.col("b") * F.col("s2")), F.lit(0.0)) / n).groupBy("date").agg(F.sum("pnl").alias("r"))


def statarb_sleeve(scores: DataFrame, rets: DataFrame, enter: float = 1.25, leave: float = 0.5, cost_bps: float = 3.5) -> DataFrame:
    """Contrarian positions on residual scores: in beyond ``enter``, out within ``leave``; gross one, costs on changes."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        pos, cur = [], 0
        for s, raw in zip(p["s"], p["s_raw"], strict=True):
            if cur == 0 and s == s and abs(s) > enter:
                cur = -1 if s > 0 else 1
            elif cur and (raw != raw or abs(raw) < leave):
                cur = 0
            pos.append(cur)
        return pd.DataFrame({"at": p["at"], "position": pos})

    p = X.per_series(scores, ["asset"], fn, "at timestamp, position int", order="at")
    w = p.withColumn("w", F.coalesce(F.try_divide(F.col("position"), F.sum(F.abs("position")).over(Window.partitionBy("at"))), F.lit(0.0)))
    by = Window.partitionBy("asset").orderBy("at")
    w = w.withColumn("dw", F.abs(F.col("w") - F.coalesce(F.lag("w").over(by), F.lit(0.0))))
    held = rets.join(holding_periods(w.select("at").distinct(), rets).drop("k"), "date")
    x = held.join(w, ["asset", "at"])
    first = F.row_number().over(Window.partitionBy("asset", "at").orderBy("date")) == 1
    x = x.withColumn("c", F.when(first, F.col("dw") * cost_bps / 1e4).otherwise(0.0))
    return x.groupBy("date").agg((F.sum(F.col("w") * F.col("r")) - F.sum("c")).alias("r"))


def portfolio_vol(daily: DataFrame, forecasts: DataFrame, corr: DataFrame) -> DataFrame:
    """Forecast volatility of the book: root of the sum over pairs of weights, forecasts and correlations."""
    x = daily.join(forecasts, ["date", "asset"]).select("date", "asset", (F.col("weight") * F.col("vol")).alias("wv"))
    a = x.select("date", F.col("asset").alias("a"), F.col("wv").alias("x"))
    b = x.select("date", F.col("asset").alias("b"), F.col("wv").alias("y"))
    full = corr.select("a", "b", "corr").unionByName(corr.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    cross = a.join(b, "date").where("a <> b").join(F.broadcast(full), ["a", "b"]).groupBy("date").agg(F.sum(F.col("x") * F.col("y") * F.col("corr")).alias("c"))
    own = a.groupBy("date").agg(F.sum(F.col("x") * F.col("x")).alias("o"))
    return own.join(cross, "date").select("date", F.sqrt(F.greatest(F.col("o") + F.col("c"), F.lit(1e-12))).alias("vol"))
