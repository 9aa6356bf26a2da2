"""Pairs of assets: correlations, unit-root statistics, covariance with shrinkage.

A pair is a row (a, b) with a < b; series meet by a join on the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, corr_pop


def pair_rows(x: DataFrame, value: str = "r", same: bool = False) -> DataFrame:
    """date, a, b, x, y for all pairs of assets; with ``same`` also a = b and both orders' upper half."""
    left = x.select("date", F.col("asset").alias("a"), F.col(value).alias("x"))
    right = x.select("date", F.col("asset").alias("b"), F.col(value).alias("y"))
    return left.join(right, "date").where(F.col("a") <= F.col("b") if same else F.col("a") < F.col("b"))


def pair_correlation(rets: DataFrame) -> DataFrame:
    return pair_rows(rets).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), corr_pop("x", "y").alias("corr"))


def top_pairs(rets: DataFrame, n: int = 120, least: float = -1.0) -> DataFrame:
    """Candidates by correlation, ties by name descending."""
    c = pair_correlation(rets).withColumn("corr", F.round("corr", 8)).where(F.col("corr") >= least)
    return c.orderBy(F.desc("corr"), F.desc("a"), F.desc("b")).limit(n)


def greedy_disjoint(candidates: list[tuple[str, str]], n: int) -> list[tuple[str, str]]:
    """First n pairs in order that share no asset with an earlier pick."""
    used: set[str] = set()
    out = []
    for a, b in candidates:
        if len(out) < n and not {a, b} & used:
            out.append((a, b))
            used |= {a, b}
    return out


def adf_tstat(prices: DataFrame) -> DataFrame:
    """Per pair: OLS of ln a on ln b, and the t-statistic of rho in de = rho e(-1), no constant."""
    x = pair_rows(prices.withColumn("l", F.log("close")), "l")
    by = Window.partitionBy("a", "b")
    fit = x.withColumn("beta", F.covar_pop("x", "y").over(by) / F.var_pop("y").over(by)).withColumn(
        "alpha", F.avg("x").over(by) - F.col("beta") * F.avg("y").over(by)
    )
    e = fit.withColumn("e", F.round(F.col("x") - F.col("alpha") - F.col("beta") * F.col("y"), 10))
    lag = e.withColumn("e1", F.lag("e").over(by.orderBy("date"))).where("e1 is not null").withColumn("de", F.col("e") - F.col("e1"))
    s = lag.groupBy("a", "b").agg(
        F.max("beta").alias("beta"), F.count(F.lit(1)).alias("n"), F.sum(F.col("e1") * F.col("e1")).alias("sxx"),
        F.sum(F.col("e1") * F.col("de")).alias("sxy"), F.sum(F.col("de") * F.col("de")).alias("syy"),
    )
    rho = F.try_divide(F.col("sxy"), F.col("sxx"))
    s2 = (F.col("syy") - rho * F.col("sxy")) / (F.col("n") - 1)
    return s.select("a", "b", "beta", F.try_divide(rho, F.sqrt(F.try_divide(s2, F.col("sxx")))).alias("tstat"))


def spearman_pairs(rets: DataFrame) -> DataFrame:
    """Rank correlation per pair over its common dates, and the Gaussian correlation it implies."""
    x = pair_rows(rets).withColumn("rx", average_rank("x", ("a", "b"))).withColumn("ry", average_rank("y", ("a", "b")))
    s = x.groupBy("a", "b").agg(corr_pop("rx", "ry").alias("spearman"))
    return s.withColumn("gauss_rho", 2 * F.sin(F.lit(3.141592653589793) * F.col("spearman") / 6))


def tail_dependence(rets: DataFrame, q: float = 0.05) -> DataFrame:
    """Share of days on which both are at or below their lower quantile, over q."""
    by = Window.partitionBy("a", "b")
    x = pair_rows(rets).withColumn("qx", F.percentile("x", F.lit(q)).over(by)).withColumn("qy", F.percentile("y", F.lit(q)).over(by))
    both = ((F.col("x") <= F.col("qx")) & (F.col("y") <= F.col("qy"))).cast("double")
    return x.groupBy("a", "b").agg((F.avg(both) / q).alias("lower_tail"))


def exceedance_asymmetry(rets: DataFrame, q: float = 0.1, least: int = 10) -> DataFrame:
    """Correlation in the joint lower tail less that in the joint upper tail."""
    by = Window.partitionBy("a", "b")
    x = pair_rows(rets)
    for c in ("x", "y"):
        x = x.withColumn(f"lo{c}", F.percentile(c, F.lit(q)).over(by)).withColumn(f"hi{c}", F.percentile(c, F.lit(1 - q)).over(by))
    lo = (F.col("x") <= F.col("lox")) & (F.col("y") <= F.col("loy"))
    hi = (F.col("x") >= F.col("hix")) & (F.col("y") >= F.col("hiy"))
    s = x.groupBy("a", "b").agg(
        F.count(F.when(lo, 1)).alias("n_lo"), F.count(F.when(hi, 1)).alias("n_hi"),
        corr_pop(F.when(lo, F.col("x")), F.when(lo, F.col("y"))).alias("c_lo"), corr_pop(F.when(hi, F.col("x")), F.when(hi, F.col("y"))).alias("c_hi"),
    )
    return s.select("a", "b", "n_lo", "n_hi", F.when((F.col("n_lo") > least) & (F.col("n_hi") > least), F.col("c_lo") - F.col("c_hi")).alias("asymmetry"))


def ewma_cov(rets: DataFrame, halflife: float = 63.0, window: int = 252) -> DataFrame:
    """Exponentially weighted covariance of the last rows, weights scaled to 1; a <= b."""
    age = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date"))) - 1
    x = rets.withColumn("age", age).where(F.col("age") < window)
    p = pair_rows(x, "r", same=True).join(x.select("date", "asset", "age").withColumnRenamed("asset", "a"), ["date", "a"])
    wt = F.pow(F.lit(0.5), F.col("age") / halflife)
    s = p.withColumn("w", wt).groupBy("a", "b").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"),
    )
    return s.select("a", "b", (F.col("sxy") / F.col("w") - F.col("sx") / F.col("w") * F.col("sy") / F.col("w")).alias("cov"))


def constant_correlation(cov: DataFrame) -> DataFrame:
    """Shrinkage target: own variances and the mean off-diagonal correlation."""
    v = cov.where("a = b").select(F.col("a").alias("k"), F.col("cov").alias("v"))
    x = cov.join(v.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    mean = x.where("a < b").agg(F.avg(F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("rho"))
    return x.join(F.broadcast(mean)).select(
        "a", "b", "cov", F.when(F.col("a") == F.col("b"), F.col("va")).otherwise(F.col("rho") * F.sqrt(F.col("va") * F.col("vb"))).alias("target")
    )


def shrinkage_intensity(rets: DataFrame, window: int = 252) -> DataFrame:
    """Ledoit-Wolf intensity on the last rows with equal weights: pi over gamma over T, clipped to [0, 1]."""
    age = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    x = rets.withColumn("age", age).where(F.col("age") <= window)
    x = x.withColumn("d", F.col("r") - F.avg("r").over(Window.partitionBy("asset")))
    p = pair_rows(x, "d", same=True).withColumn("xy", F.col("x") * F.col("y"))
    s = p.groupBy("a", "b").agg(F.avg("xy").alias("cov"), F.var_pop("xy").alias("pi"), F.count(F.lit(1)).alias("t"))
    c = constant_correlation(s.select("a", "b", "cov")).join(s.select("a", "b", "pi", "t"), ["a", "b"])
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    gap = F.col("cov") - F.col("target")
    agg = c.agg(F.sum(twice * F.col("pi")).alias("pi"), F.sum(twice * gap * gap).alias("gamma"), F.max("t").alias("t"))
    raw = F.try_divide(F.col("pi"), F.col("gamma") * F.col("t"))
    return agg.select("pi", "gamma", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("delta"))
