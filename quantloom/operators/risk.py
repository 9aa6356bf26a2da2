"""Costs, drifted weights, exposure brakes, greeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ANNUAL, col, expanding, ordered, trailing


def trade_cost_bps(dw: str | Column, vol: str | Column, commission: float = 1.0, spread: float = 2.0, impact: float = 10.0, cap: float = 25.0) -> Column:
    """Cost in basis points of trading ``dw``: fees, spread and a square-root impact with a cap."""
    size = F.abs(col(dw))
    hit = F.least(impact * (col(vol) / 0.01) * F.sqrt(size / 0.01), F.lit(cap))
    return size * (commission + spread + hit)


def drift_weights(prices: DataFrame, every: int = 21) -> DataFrame:
    """Equal weights at each rebalance, drifted with prices in closed form: w0 P_t / P_0, scaled to 1."""
    w = ordered()
    n = prices.withColumn("k", F.floor((F.row_number().over(w) - 1) / every).cast("long"))
    p0 = F.first("close").over(Window.partitionBy("asset", "k").orderBy("date"))
    g = n.withColumn("g", F.col("close") / p0)
    return g.withColumn("w", F.col("g") / F.sum("g").over(Window.partitionBy("date"))).select("asset", "date", "k", "close", "w")


def portfolio_pnl(weights: DataFrame) -> DataFrame:
    """Return of the book by date: yesterday's weights times today's simple returns."""
    w = ordered()
    x = weights.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("wl", F.lag("w").over(w))
    return x.where("wl is not null and ret is not null").groupBy("date").agg(F.round(F.sum(F.col("wl") * F.col("ret")), 10).alias("r"))


def rolling_cvar(rets: DataFrame, window: int = 252, alpha: float = 0.95, minp: int = 50, by: tuple[str, ...] = ("u",)) -> DataFrame:
    """``rets`` with cvar over the trailing window: quantile over the frame, then the mean of the tail
    by one fold over the frame's values."""
    w = trailing(window, by)
    q = F.percentile("r", F.lit(1 - alpha)).over(w)
    x = rets.withColumn("q", q).withColumn("a", F.collect_list("r").over(w))
    tail = F.filter("a", lambda v: v <= F.col("q"))
    mean = F.aggregate(tail, F.lit(0.0), lambda s, v: s + v) / F.size(tail)
    return x.withColumn("cvar", F.when(F.size("a") >= minp, -mean)).drop("q", "a")


def exposure_brakes(rets: DataFrame, target_cvar: float = 0.02, dd_soft: float = 0.05, dd_hard: float = 0.15, floor: float = 0.25, by: tuple[str, ...] = ("u",)) -> DataFrame:
    """CVaR brake and drawdown brake, both in [floor, 1], and the smaller of them."""
    x = rolling_cvar(rets, by=by)
    w = expanding(by)
    x = x.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(w)))
    x = x.withColumn("dd", F.col("nav") / F.max("nav").over(w) - 1)
    cv = F.when(F.col("cvar") > 0, F.least(F.lit(1.0), F.greatest(F.lit(floor), target_cvar / F.col("cvar")))).otherwise(F.lit(1.0))
    slope = 1 - (1 - floor) * (-F.col("dd") - dd_soft) / (dd_hard - dd_soft)
    db = F.least(F.lit(1.0), F.greatest(F.lit(floor), slope))
    return x.select(*by, "date", "r", cv.alias("cvar_brake"), db.alias("dd_brake"), F.least(cv, db).alias("brake"))


def rolling_beta(rets: DataFrame, mkt: DataFrame, window: int = 60) -> DataFrame:
    x = rets.join(mkt.select("date", F.col("r").alias("m")), "date")
    w = trailing(window)
    b = F.try_divide(F.covar_samp("r", "m").over(w), F.var_samp("m").over(w))
    return x.select("asset", "date", F.when(F.count("r").over(w) >= window, b).alias("beta"))


def greeks(rets: DataFrame, mkt: DataFrame, window: int = 252, cost_drag: float = 0.01) -> DataFrame:
    """Delta and gamma of each asset by OLS on (1, m, m^2) over its last rows, and theta.

    Normal equations from centred moments, solved in closed form."""
    last = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    x = rets.join(mkt.select("date", F.col("r").alias("m")), "date").withColumn("rn", last).where(F.col("rn") <= window).withColumn("m2", F.col("m") * F.col("m"))
    c = x.groupBy("asset").agg(
        F.covar_pop("m", "m").alias("s11"), F.covar_pop("m", "m2").alias("s12"), F.covar_pop("m2", "m2").alias("s22"),
        F.covar_pop("r", "m").alias("sy1"), F.covar_pop("r", "m2").alias("sy2"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    delta = F.try_divide(F.col("sy1") * F.col("s22") - F.col("sy2") * F.col("s12"), det)
    gamma = F.try_divide(F.col("sy2") * F.col("s11") - F.col("sy1") * F.col("s12"), det)
    return c.select("asset", delta.alias("delta"), (2 * gamma).alias("gamma"), F.lit(-cost_drag / ANNUAL).alias("theta"))
