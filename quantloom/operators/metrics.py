"""Performance metrics of return series (simple returns in column ``r``), grouped by ``by``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ANNUAL, expanding, kurt_g2, skew_g1

ROOT = ANNUAL**0.5


def nav_end() -> Column:
    return F.exp(F.sum(F.log1p("r")))


def cagr() -> Column:
    n = F.count("r").cast("double")
    return F.when(n > 0, F.when(F.min("r") <= -1, 0.0).otherwise(F.pow(nav_end(), ANNUAL / n) - 1))


def ann_vol() -> Column:
    return F.stddev_samp("r") * ROOT


def sharpe() -> Column:
    return F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * ROOT, F.lit(0.0))


def sortino() -> Column:
    """Mean over the sample deviation of the negative returns."""
    return F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))) * ROOT, F.lit(0.0))


def drawdown_series(rets: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """``rets`` with nav and drawdown from the running maximum."""
    w = expanding(by)
    nav = rets.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(w)))
    return nav.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def max_drawdown(rets: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Per series: the deepest drawdown and the longest run of rows below the maximum."""
    dd = drawdown_series(rets, by).withColumn("under", F.round("drawdown", 12) < 0)
    isl = dd.withColumn("island", F.sum(F.when(~F.col("under"), 1).otherwise(0)).over(expanding(by)))
    runs = isl.groupBy(*by, "island").agg(F.min("drawdown").alias("low"), F.sum(F.col("under").cast("int")).alias("n"))
    return runs.groupBy(*by).agg(F.min("low").alias("max_drawdown"), F.max("n").cast("long").alias("longest_underwater"))


def var_cvar(rets: DataFrame, alpha: float = 0.95, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Per series: minus the lower quantile, and minus the mean of the returns at or below it."""
    q = F.percentile("r", F.lit(1 - alpha)).over(Window.partitionBy(*by))
    tail = rets.withColumn("q", q)
    return tail.groupBy(*by).agg((-F.max("q")).alias("var"), (-F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("cvar"))


def summary(rets: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """One row of thirteen statistics per series."""
    agg = rets.groupBy(*by).agg(
        F.count("r").alias("n"), cagr().alias("cagr"), ann_vol().alias("ann_vol"), sharpe().alias("sharpe"), sortino().alias("sortino"),
        skew_g1("r").alias("skew"), kurt_g2("r").alias("kurt"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"),
        (nav_end() - 1).alias("total_return"),
    )
    out = agg.join(max_drawdown(rets, by), list(by)).join(var_cvar(rets, by=by), list(by))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(F.lit(0.0)))


def monthly_table(rets: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    keys = [*by, F.year("date").alias("year"), F.month("date").alias("month")]
    return rets.groupBy(*keys).agg((nav_end() - 1).alias("ret"))
