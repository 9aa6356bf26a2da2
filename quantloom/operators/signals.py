"""Cross-sectional signals: each is a z-score across assets per date, clipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, norm_ppf, ordered, roll_mean, roll_std, safe_div, xz

#: Weights of the signals by regime: calm, volatile, bear.
REGIME_WEIGHTS = {0: (0.6, 0.2, 0.2), 1: (0.3, 0.4, 0.3), 2: (0.1, 0.3, 0.6)}


def momentum_raw(lookback: int = 252, skip: int = 21) -> Column:
    """12-1 momentum of the closes."""
    w = ordered()
    return F.round(safe_div(F.lag("close", skip).over(w), F.lag("close", lookback).over(w)) - 1, 10)


def reversion_raw(window: int = 20, cap: float = 3.0) -> Column:
    """Minus the z-score of the price against its trailing mean, clipped."""
    z = -F.try_divide(F.col("close") - roll_mean("close", window), roll_std("close", window))
    return F.when(z.isNotNull(), F.least(F.greatest(F.round(z, 10), F.lit(-cap)), F.lit(cap)))


def volatility_raw(window: int = 60) -> Column:
    return F.round(roll_std("r", window), 10)


def across(raw: str, cap: float) -> Column:
    """z-score across the assets of a date; 0 where there is none."""
    return F.coalesce(xz(raw, cap=cap), F.lit(0.0))


def momentum(prices: DataFrame, lookback: int = 252, skip: int = 21, cap: float = 3.0) -> DataFrame:
    """12-1 momentum; 0 where the history is short."""
    return prices.withColumn("raw", momentum_raw(lookback, skip)).withColumn("momentum", across("raw", cap)).drop("raw")


def mean_reversion(prices: DataFrame, window: int = 20, cap: float = 3.0) -> DataFrame:
    """Minus the z-score of the price against its trailing mean."""
    return prices.withColumn("raw", reversion_raw(window, cap)).withColumn("mean_reversion", across("raw", cap)).drop("raw")


def _normal_score(x: DataFrame, vol: str) -> DataFrame:
    """``raw``: minus the normal score (Blom) of the average rank of ``vol`` among the date's assets that have one."""
    n = F.count(vol).over(Window.partitionBy("date"))
    p = x.withColumn("_p", (average_rank(vol, ("date",)) - 0.375) / (n + 0.25))
    return p.withColumn("raw", F.round(-norm_ppf("_p"), 10)).drop("_p")


def low_vol(rets: DataFrame, window: int = 60, cap: float = 3.0) -> DataFrame:
    """Minus the normal score of trailing volatility."""
    v = rets.withColumn("vol", volatility_raw(window)).where(F.col("vol").isNotNull())
    return _normal_score(v, "vol").withColumn("low_vol", across("raw", cap)).drop("raw", "vol")


def combined(rets: DataFrame, regimes: DataFrame, weights: dict[int, tuple[float, float, float]] = REGIME_WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Regime-weighted blend of the three signals, standardised again.

    One sort by asset for what looks back, one shuffle by date for what looks across."""
    dim = rets.sparkSession.createDataFrame([(k, *v) for k, v in weights.items()], "regime int, w_mom double, w_rev double, w_vol double")
    x = rets.select("asset", "date", momentum_raw().alias("_m"), reversion_raw(cap=cap).alias("_z"), volatility_raw().alias("_vol"))
    x = _normal_score(x, "_vol").withColumns({"momentum": across("_m", cap), "mean_reversion": across("_z", cap), "low_vol": across("raw", cap)})
    both = x.where(F.col("_vol").isNotNull()).join(regimes.select("date", "regime"), "date").join(F.broadcast(dim), "regime")
    blend = F.col("w_mom") * F.col("momentum") + F.col("w_rev") * F.col("mean_reversion") + F.col("w_vol") * F.col("low_vol")
    done = both.withColumn("raw", F.round(blend, 8)).withColumn("combined", xz("raw", cap=cap))
    return done.select("asset", "date", "regime", "momentum", "mean_reversion", "low_vol", "combined")
