"""The trading system: volatility forecasts per asset, a risk-parity book with regime-dependent views,
exposure by the forecast volatility of the whole book, and today's allocation.

All of it looks back only. Forecasts run per asset, targets per rebalance date, the
book's forecast volatility per chunk of dates; the path-dependent part has a step per
rebalance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ordered
from ..kernels import volmodels as M
from ..operators import models as X
from ..operators.risk import rolling_cvar
from ..operators.signals import combined
from ..staging import staged
from . import book


@dataclass(frozen=True)
class SystemConfig:
    """Knobs of the system; volatilities a year, costs in basis points."""

    every: int = 21
    window: int = 252
    refit: int = 21
    first: int = 504
    target_vol: float = 0.11
    cap: float = 0.35
    band: float = 0.0025
    dd_start: float = 0.08
    dd_floor: float = 0.20
    floor: float = 0.25
    cvar_target: float = 0.018
    smooth: int = 5
    commission: float = 1.0
    spread: float = 2.0
    #: Size by forecasts; else by the mean of the last 21 rows (the control arm).
    forecast: bool = True

    def book(self) -> book.BookConfig:
        return book.BookConfig(window=self.window, every=self.every, cap=self.cap, band=self.band, commission=self.commission, spread=self.spread, impact=0.0)


def asset_vol(gk: DataFrame, cfg: SystemConfig = SystemConfig()) -> DataFrame:
    """asset, date, forecast, realised: annual volatility of each row as foretold by earlier rows, and the mean of the last 21."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        rv, out = p["gk_var"].to_numpy(float), np.full(len(p), np.nan)
        for t in range(cfg.first, len(rv), cfg.refit):
            end = min(t + cfg.refit, len(rv))
            out[t:end] = M.Har().fit(rv[:t]).predict(rv[:end])[t - 1 : end - 1]
        return pd.DataFrame({"date": p["date"], "forecast": np.sqrt(np.maximum(out, 1e-12) * 252)})

    known = gk.where("gk_var is not null").select("asset", "date", "gk_var")
    w = ordered().rowsBetween(-20, 0)
    last = known.withColumn("realised", F.when(F.count("gk_var").over(w) >= 21, F.avg(F.sqrt("gk_var")).over(w) * 252**0.5)).select("asset", "date", "realised")
    return X.per_series(known, ["asset"], fn, "date timestamp, forecast double").join(last, ["asset", "date"])


def book_vol(daily: DataFrame, vols: DataFrame, rets: DataFrame, value: str, window: int = 252, chunk: int = 63) -> DataFrame:
    """date, vol: root of w' D R D w with the weights of the day, volatilities known the day before and
    the correlation of the ``window`` rows before it.

    A task has one chunk of dates and the rows they look back to, so a row is copied
    (window + chunk) / chunk times, and no matrix of pairs is ever a table."""
    number = rets.select("date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy("date")) - 1)
    lagged = vols.select("asset", "date", F.lag(value).over(ordered()).alias("v"))
    x = rets.select("asset", "date", "r").join(lagged, ["asset", "date"], "left").join(daily.select("asset", "date", "weight"), ["asset", "date"], "left").join(number, "date")
    first, last = F.floor(F.col("i") / chunk), F.floor((F.col("i") + window) / chunk)
    x = x.withColumn("c", F.explode(F.sequence(first, last)))

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        c = int(p["c"].iloc[0])
        wide = p.pivot(index="i", columns="asset", values=["r", "v", "weight"])
        at, (r, v, w) = wide.index.to_numpy(), (wide[k].to_numpy(float) for k in ("r", "v", "weight"))
        dates, out = p.groupby("i")["date"].first(), []
        for i in range(c * chunk, (c + 1) * chunk):
            k = int(np.searchsorted(at, i))
            if k >= len(at) or at[k] != i:
                continue
            use = np.isfinite(v[k]) & (np.nan_to_num(w[k]) > 0)
            past = np.nan_to_num(r[(at >= i - window) & (at < i)][:, use])
            if use.sum() < 2 or len(past) < 2:
                continue
            sd = past.std(0, ddof=1)
            z = (past - past.mean(0)) / np.where(sd > 0, sd, 1.0)
            own = v[k][use] * w[k][use]
            flat = float((own[sd <= 0] ** 2).sum())  # an asset that stood still correlates with none
            out.append((dates[i], float(np.sqrt(max((z @ own).var(ddof=1) + flat, 1e-12)))))
        return pd.DataFrame(out, columns=["date", "vol"])

    return x.groupBy("c").applyInPandas(fn, "date timestamp, vol double")


def exposure(gross: DataFrame, vol: DataFrame, cfg: SystemConfig = SystemConfig()) -> DataFrame:
    """u, date, r, vol, raw, exposure: the least of the volatility, CVaR and drawdown multipliers, smoothed; for the next row."""
    w = Window.partitionBy("u").orderBy("date")
    x = rolling_cvar(gross.join(vol, "date", "left"))
    x = x.withColumn("vol", F.last("vol", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nav = F.exp(F.sum(F.log1p("r")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("nav", nav).withColumn("dd", F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    one = F.lit(1.0)
    of_vol = F.coalesce(F.least(one, cfg.target_vol / F.col("vol")), one)
    of_cvar = F.coalesce(F.when(F.col("cvar") > 0, F.least(one, cfg.cvar_target / F.col("cvar"))), one)
    depth = F.greatest(F.lit(0.0), F.least(one, (-F.col("dd") - cfg.dd_start) / (cfg.dd_floor - cfg.dd_start)))
    x = x.withColumn("raw", F.least(of_vol, of_cvar, 1 - depth * (1 - cfg.floor))).select("u", "date", "r", "vol", "raw")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        s = M.EwmMoments.of_span(cfg.smooth)
        return pd.DataFrame({"date": p["date"], "r": p["r"], "vol": p["vol"], "raw": p["raw"], "exposure": [min(max(s.step(v)[0], 0.0), 1.0) for v in p["raw"]]})

    return X.per_series(x, ["u"], fn, "date timestamp, r double, vol double, raw double, exposure double")


def hold(rets: DataFrame, regimes: DataFrame, cfg: SystemConfig = SystemConfig()) -> dict[str, DataFrame]:
    """Targets, trades and daily weights of the book before it is sized."""
    rets, b = staged(rets), cfg.book()
    targets = staged(book.target_weights(rets, combined(rets, regimes), "combined", b))
    trades = staged(book.traded(targets, rets, b).drop("book"))
    return {"rets": rets, "targets": targets, "trades": trades, "daily": staged(book.daily_weights(trades, rets))}


def size(held: dict[str, DataFrame], vols: DataFrame, cfg: SystemConfig = SystemConfig()) -> dict[str, DataFrame]:
    """``held`` with exposure and net returns; the exposure of a day earns from the next."""
    rets, daily = held["rets"], held["daily"]
    gross = daily.groupBy("date").agg(F.sum(F.col("weight") * (F.exp("r") - 1)).alias("r")).withColumn("u", F.lit("system"))
    vol = book_vol(daily, vols, rets, "forecast" if cfg.forecast else "realised", cfg.window)
    e = staged(exposure(gross, vol, cfg))
    lag = F.coalesce(F.lag("exposure").over(Window.partitionBy("u").orderBy("date")), F.lit(1.0))
    net = e.withColumn("applied", lag).join(book.costs(held["trades"], rets, cfg.book()).select("date", "cost"), "date", "left").na.fill(0.0, ["cost"])
    return held | {"exposure": e, "net": net.withColumn("net", F.col("r") * F.col("applied") - F.col("cost"))}


def run_system(rets: DataFrame, gk: DataFrame, regimes: DataFrame, cfg: SystemConfig = SystemConfig()) -> dict[str, DataFrame]:
    """Targets, trades, daily weights, exposure and net returns of the system."""
    return size(hold(rets, regimes, cfg), asset_vol(gk, cfg), cfg)


def allocation(system: dict[str, DataFrame], notional: float = 100_000.0, least: float = 0.005) -> DataFrame:
    """asset, dollars: whole dollars of the latest targets above ``least`` at the latest exposure, and the cash that is left."""
    now = system["exposure"].groupBy("u").agg(F.max_by("exposure", "date").alias("exposure")).select("exposure")
    t = system["targets"]
    last = t.join(F.broadcast(t.agg(F.max("at").alias("at"))), "at").where(F.col("w") > least)
    rows = last.join(F.broadcast(now)).select("asset", F.round(F.col("w") * F.col("exposure") * notional, 0).alias("dollars"))
    cash = rows.agg((notional - F.coalesce(F.sum("dollars"), F.lit(0.0))).alias("dollars")).select(F.lit("CASH").alias("asset"), "dollars")
    return rows.unionByName(cash)
