"""Forecast comparison, overfitting, regime persistence, classification rules."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import expanding, norm_cdf


def hac_test(x: DataFrame, a: str, b: str, h: int = 5, by: str = "asset") -> DataFrame:
    """Mean of a - b over its Newey-West deviation (Bartlett weights to lag h-1), two-sided normal p.

    With losses this is Diebold and Mariano's test, with log scores Amisano and Giacomini's."""
    w = Window.partitionBy(by)
    d = x.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b)).withColumn("m", F.avg("d").over(w)).withColumn("e", F.col("d") - F.col("m"))
    lags = d
    for k in range(1, h):
        lags = lags.withColumn(f"e{k}", F.lag("e", k).over(w.orderBy("date")))
    g = lags.groupBy(by).agg(F.max("m").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, h)])
    s = F.col("g0")
    for k in range(1, h):
        s = s + 2 * (1 - k / h) * F.col(f"g{k}")
    t = g.withColumn("s", F.greatest(s / F.col("n"), F.lit(1e-18))).withColumn("stat", F.col("mean") / F.sqrt(F.col("s") / F.col("n")))
    t = t.withColumn("nabs", -F.abs("stat"))
    return t.select(by, "mean", "stat", (2 * norm_cdf("nabs")).alias("p"))


def cscv_pbo(x: DataFrame, blocks: int = 8) -> DataFrame:
    """Probability of backtest overfitting over all half-half splits of blocks.

    ``x``: t, variant, r. Sums per block and variant are enough for every split's Sharpe
    ratios; the splits are a small dimension. Returns the number of splits, the share of
    splits whose in-sample winner ranks below the median out of sample, and the mean logit."""
    spark = x.sparkSession
    n = x.groupBy("variant").agg(F.max("t").alias("hi")).agg(F.max("hi").alias("hi"))
    b = x.join(F.broadcast(n)).withColumn("block", F.least(F.floor(F.col("t") * blocks / (F.col("hi") + 1)), F.lit(blocks - 1)).cast("int"))
    stats = b.groupBy("block", "variant").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    splits = spark.createDataFrame(
        [(k, j, int(j in c)) for k, c in enumerate(combinations(range(blocks), blocks // 2)) for j in range(blocks)], "combo int, block int, inside int"
    )
    per = stats.join(F.broadcast(splits), "block").groupBy("combo", "variant", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    sr = per.select("combo", "variant", "inside", F.round(F.coalesce(F.try_divide(mean, sd), F.lit(0.0)), 10).alias("sr"))
    wide = sr.where("inside = 1").select("combo", "variant", F.col("sr").alias("si")).join(sr.where("inside = 0").select("combo", "variant", F.col("sr").alias("so")), ["combo", "variant"])
    c = Window.partitionBy("combo")
    r = wide.withColumn("best", F.row_number().over(c.orderBy(F.desc("si"), "variant"))).withColumn("rk", F.rank().over(c.orderBy("so"))).withColumn("nv", F.count(F.lit(1)).over(c))
    w = r.where("best = 1").withColumn("w", F.col("rk") / (F.col("nv") + 1))
    return w.agg(F.count(F.lit(1)).alias("splits"), F.avg((F.col("w") < 0.5).cast("double")).alias("pbo"), F.avg(F.log(F.col("w") / (1 - F.col("w")))).alias("logit"))


def transition_matrix(x: DataFrame, state: str = "regime", pseudo: float = 1.0, states: int = 3) -> DataFrame:
    """Transition probabilities between consecutive rows, with a pseudo-count in each cell."""
    y = x.withColumn("to", F.lead(state).over(Window.partitionBy("u").orderBy("date"))).where("to is not null")
    c = y.groupBy(F.col(state).alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    spark = x.sparkSession
    grid = spark.createDataFrame([(i, j) for i in range(states) for j in range(states)], "from int, to int")
    full = grid.join(c, ["from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudo)
    return full.select("from", "to", (F.col("n") / F.sum("n").over(Window.partitionBy("from"))).alias("p"))


def dwell(x: DataFrame, state: str = "regime") -> DataFrame:
    """Runs of equal states: island, state, first date, rows."""
    w = Window.partitionBy("u").orderBy("date")
    y = x.withColumn("chg", (F.coalesce(F.lag(state).over(w) != F.col(state), F.lit(True))).cast("int")).withColumn("island", F.sum("chg").over(expanding(("u",))))
    return y.groupBy("u", "island").agg(F.max(state).alias(state), F.min("date").alias("start"), F.count(F.lit(1)).alias("rows"))


def persistence(x: DataFrame, state: str = "regime") -> DataFrame:
    """Switches a year and the median dwell in rows."""
    d = dwell(x, state)
    return d.groupBy("u").agg(((F.count(F.lit(1)) - 1) * 252.0 / F.sum("rows")).alias("switches_per_year"), F.percentile("rows", F.lit(0.5)).alias("median_dwell"))


def crash_latency(x: DataFrame, starts: DataFrame, stress: int = 2, cap: int = 60, state: str = "regime") -> DataFrame:
    """Rows from each start date to the first of two consecutive rows in the stressed state, at most ``cap``."""
    w = Window.partitionBy("u").orderBy("date")
    y = x.withColumn("rn", F.row_number().over(w)).withColumn("hit", (F.col(state) >= stress) & (F.lead(state).over(w) >= stress))
    s = starts.join(y.select("date", F.col("rn").alias("rn0")), F.col("start") == F.col("date")).select("start", "rn0")
    j = s.join(y.where("hit").select("rn"), (F.col("rn") >= F.col("rn0")) & (F.col("rn") < F.col("rn0") + cap), "left")
    return j.groupBy("start").agg(F.coalesce(F.min(F.col("rn") - F.col("rn0")), F.lit(cap)).cast("long").alias("latency"))


def histogram(x: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins; the largest value belongs to the last."""
    e = x.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return x.join(F.broadcast(e)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def classify(vr_p: Column, trend_p: Column, alpha: float = 0.05) -> Column:
    """Whether a law drifts, varies by regime, or is constant."""
    return F.when(trend_p < alpha, "DRIFTING").when(vr_p < alpha, "REGIME-VARYING").otherwise("CONSTANT")


def contrast(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column, z_cut: float = 1.645) -> Column:
    """Label of the difference of two estimates."""
    z = F.try_divide(mean_a - mean_b, F.sqrt(sd_a * sd_a + sd_b * sd_b))
    return F.when(mean_a * mean_b < 0, F.when(F.abs(z) > z_cut, "INVERTED").otherwise("SAME")).when(z > z_cut, "STRONGER").when(z < -z_cut, "WEAKER").otherwise("SAME")
