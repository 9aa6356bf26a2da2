"""Scaling laws, tail laws, clocks, and lead-lag kernels of return panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import corr_pop, guarded, kurt_g2, ordered, safe_div, safe_ln, trailing

LAGS = (1, 2, 3, 4, 5, 7, 9, 11, 15, 19, 24, 32, 41, 50)
QS = (0.5, 1.0, 1.5, 2.0, 3.0)


def scaling_moments(gk: DataFrame, lags: tuple[int, ...] = LAGS, qs: tuple[float, ...] = QS) -> DataFrame:
    """asset, delta, q, m: mean absolute increments of log volatility over ``delta`` rows, to the power q.

    All lags are leads of one sorted window, unpivoted by one explode: one shuffle."""
    x = gk.where("gk_var is not null").select("asset", "date", (0.5 * F.log("gk_var")).alias("l"))
    inc = F.array(*[F.struct(F.lit(d).alias("delta"), F.abs(F.lead("l", d).over(ordered()) - F.col("l")).alias("i")) for d in lags])
    flat = x.withColumn("inc", inc).select("asset", F.explode("inc").alias("z")).where("z.i is not null")
    sums = flat.groupBy("asset", F.col("z.delta").alias("delta")).agg(*[F.avg(F.pow("z.i", F.lit(q))).alias(f"q{k}") for k, q in enumerate(qs)])
    rows = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{k}").alias("m")) for k, q in enumerate(qs)])
    return sums.select("asset", "delta", F.explode(rows).alias("s")).select("asset", "delta", "s.q", "s.m")


def hurst(gk: DataFrame, lags: tuple[int, ...] = LAGS, qs: tuple[float, ...] = QS) -> DataFrame:
    """H per asset: slopes of ln m on ln delta by q, then a line through the origin over q."""
    z = scaling_moments(gk, lags, qs).groupBy("asset", "q").agg(F.regr_slope(safe_ln("m"), F.log("delta")).alias("zeta"))
    return z.groupBy("asset").agg(F.try_divide(F.sum(F.col("q") * F.col("zeta")), F.sum(F.col("q") * F.col("q"))).alias("hurst"))


def subwindow_hurst(gk: DataFrame, rows: int = 1000) -> DataFrame:
    """H in windows of ``rows`` rows that overlap by half."""
    half = rows // 2
    n = gk.where("gk_var is not null").withColumn("k", F.floor((F.row_number().over(ordered()) - 1) / half).cast("int"))
    both = n.withColumn("w", F.explode(F.array("k", F.col("k") - 1))).where("w >= 0")
    full = both.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("asset", "w"))).where(F.col("size") >= rows)
    keyed = full.withColumn("asset", F.concat_ws("#", "asset", F.col("w").cast("string")))
    h = hurst(keyed)
    return h.select(F.substring_index("asset", "#", 1).alias("asset"), F.substring_index("asset", "#", -1).cast("int").alias("window"), "hurst")


def standardized(bars: DataFrame, smooth: int = 1, lag: int = 0) -> DataFrame:
    """``bars`` (with gk_var) plus r and z = r over the root of the smoothed, lagged variance."""
    v = F.avg("gk_var").over(trailing(smooth)) if smooth > 1 else F.col("gk_var")
    x = bars.withColumn("r", F.round(safe_ln(safe_div("close", F.lag("close").over(ordered()))), 10)).withColumn("v", v)
    if lag:
        x = x.withColumn("v", F.lag("v", lag).over(ordered()))
    return x.withColumn("z", F.round(safe_div("r", F.sqrt("v")), 8))


def trimmed(x: DataFrame, value: str, sigmas: float = 12.0) -> DataFrame:
    """Rows within so many deviations of the mean of the asset."""
    m, s = F.avg(value).over(Window.partitionBy("asset")), F.stddev_samp(value).over(Window.partitionBy("asset"))
    return x.where(F.col(value).isNotNull()).withColumn("_m", m).withColumn("_s", s).where(F.abs(F.col(value) - F.col("_m")) < sigmas * F.col("_s")).drop("_m", "_s")


def deformed_kurtosis(bars: DataFrame) -> DataFrame:
    """Excess kurtosis per asset of raw returns and of returns in units of their volatility."""
    x = standardized(bars)
    raw = trimmed(x, "r").groupBy("asset").agg(kurt_g2("r").alias("kurt_raw"))
    return raw.join(trimmed(x, "z").groupBy("asset").agg(kurt_g2("z").alias("kurt_deformed")), "asset")


def market_clock_deformation(bars: DataFrame) -> DataFrame:
    """Kurtosis per asset: raw, by the market's volatility, by its own."""
    x = standardized(bars)
    mkt = x.groupBy("date").agg(F.avg("v").alias("mv"))
    y = x.join(mkt, "date").withColumn("zm", F.round(safe_div("r", F.sqrt("mv")), 8))
    out = trimmed(y, "r").groupBy("asset").agg(kurt_g2("r").alias("kurt_raw"))
    for c, name in (("zm", "kurt_market"), ("z", "kurt_own")):
        out = out.join(trimmed(y, c).groupBy("asset").agg(kurt_g2(c).alias(name)), "asset")
    return out


def logvol_signal_variance(gk: DataFrame) -> DataFrame:
    """Variance of persistent log volatility: c1^2 / c2 from autocovariances at lags 1 and 2."""
    x = gk.where("gk_var is not null").select("asset", "date", (0.5 * F.log("gk_var")).alias("l")).withColumn("d", F.col("l") - F.avg("l").over(Window.partitionBy("asset")))
    s = x.withColumn("d1", F.lag("d", 1).over(ordered())).withColumn("d2", F.lag("d", 2).over(ordered())).groupBy("asset").agg(
        F.avg(F.col("d") * F.col("d1")).alias("c1"), F.avg(F.col("d") * F.col("d2")).alias("c2"), F.var_pop("d").alias("c0")
    )
    raw = F.when((F.col("c1") > 0) & (F.col("c2") > 0), F.least(F.col("c1") * F.col("c1") / F.col("c2"), F.col("c0")))
    return s.select("asset", F.coalesce(raw, F.greatest("c1", F.lit(0.0))).alias("s2"))


def kurtosis_law(bars: DataFrame) -> DataFrame:
    """Kurtosis 3 exp(4 s2) that the variance of log volatility implies, beside the realised one."""
    s2 = logvol_signal_variance(bars)
    k = trimmed(standardized(bars), "r").groupBy("asset").agg((kurt_g2("r") + 3).alias("realised"))
    return s2.join(k, "asset").withColumn("implied", 3 * F.exp(4 * F.col("s2")))


def mrw_lambda2(rets: DataFrame, deltas: tuple[int, ...] = (1, 2, 4, 8, 16, 32), qs: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Multifractal curvature: zeta(q) over non-overlapping blocks, fitted as q H - lambda2 q (q - 2) / 2."""
    x = rets.withColumn("d", F.col("r") - F.avg("r").over(Window.partitionBy("asset"))).withColumn("rn", F.row_number().over(ordered()) - 1)
    one = x.select("asset", "rn", "d", F.explode(F.array(*map(F.lit, deltas))).alias("delta"))
    blocks = one.groupBy("asset", "delta", F.floor(F.col("rn") / F.col("delta")).alias("b")).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n")).where("n = delta")
    m = blocks.groupBy("asset", "delta").agg(*[F.avg(F.pow(F.abs("s"), F.lit(q))).alias(f"q{k}") for k, q in enumerate(qs)])
    rows = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{k}").alias("m")) for k, q in enumerate(qs)])
    z = m.select("asset", "delta", F.explode(rows).alias("s")).groupBy("asset", F.col("s.q").alias("q")).agg(F.regr_slope(F.log("s.m"), F.log("delta")).alias("zeta"))
    f1, f2 = F.col("q"), -F.col("q") * (F.col("q") - 2) / 2
    s = z.groupBy("asset").agg(
        F.sum(f1 * f1).alias("a"), F.sum(f1 * f2).alias("b"), F.sum(f2 * f2).alias("c"), F.sum(f1 * F.col("zeta")).alias("u"), F.sum(f2 * F.col("zeta")).alias("v")
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return s.select("asset", ((F.col("u") * F.col("c") - F.col("v") * F.col("b")) / det).alias("h"), ((F.col("v") * F.col("a") - F.col("u") * F.col("b")) / det).alias("lambda2"))


def lag_corr(x: DataFrame, a: Column, b: Column, taus: range) -> DataFrame:
    """corr(a_t, b_{t+tau}) per asset and tau; all leads share one window."""
    y = x.select("asset", "date", a.alias("a"), b.alias("b"))
    arr = F.array(*[F.struct(F.lit(t).alias("tau"), F.lead("b", t).over(ordered()).alias("y")) for t in taus])
    return y.withColumn("arr", arr).select("asset", "a", F.explode("arr").alias("z")).groupBy("asset", F.col("z.tau").alias("tau")).agg(corr_pop("a", "z.y").alias("c"))


def leverage_kernel(x: DataFrame, tau_max: int = 60) -> DataFrame:
    """corr(r_t, v_{t+tau}) for tau = 1..tau_max."""
    return lag_corr(x.where("r is not null and gk_var is not null"), F.col("r"), F.col("gk_var"), range(1, tau_max + 1))


def leverage_effect(x: DataFrame, tau_max: int = 10) -> DataFrame:
    return leverage_kernel(x, tau_max).groupBy("asset").agg(F.avg("c").alias("leverage"))


def zumbach(x: DataFrame, taus: range = range(1, 21)) -> DataFrame:
    """Sum over tau of corr(r2_t, v_{t+tau}) - corr(v_t, r2_{t+tau})."""
    y = x.where("r is not null and gk_var is not null").withColumn("r2", F.col("r") * F.col("r"))
    ab = lag_corr(y, F.col("r2"), F.col("gk_var"), taus).withColumnRenamed("c", "c1")
    ba = lag_corr(y, F.col("gk_var"), F.col("r2"), taus).withColumnRenamed("c", "c2")
    return ab.join(ba, ["asset", "tau"]).groupBy("asset").agg(F.sum(F.col("c1") - F.col("c2")).alias("zumbach"))


def weekly_logvol(gk: DataFrame, week: int = 5) -> DataFrame:
    """Means of log volatility over whole blocks of ``week`` rows."""
    x = gk.where("gk_var is not null").withColumn("b", F.floor((F.row_number().over(ordered()) - 1) / week).cast("long"))
    g = x.groupBy("asset", "b").agg(F.avg(0.5 * F.log("gk_var")).alias("logvol"), F.max("date").alias("date"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == week).select("asset", "b", "date", F.round("logvol", 10).alias("logvol"))


def cascade_moments(gk: DataFrame, week: int = 5) -> DataFrame:
    """Kurtosis and autocorrelations of the innovations of weekly log volatility."""
    w = Window.partitionBy("asset").orderBy("b")
    x = weekly_logvol(gk, week).withColumn("i", F.col("logvol") - F.lag("logvol").over(w)).where("i is not null")
    x = x.withColumn("a", F.abs("i")).withColumn("i1", F.lag("i", 1).over(w)).withColumn("a1", F.lag("a", 1).over(w)).withColumn("a5", F.lag("a", 5).over(w))
    return x.groupBy("asset").agg(
        F.count("i").alias("n"), kurt_g2("i").alias("kurt"), corr_pop("i", "i1").alias("ac1"), corr_pop("a", "a1").alias("abs_ac1"), corr_pop("a", "a5").alias("abs_ac5")
    )


def joint_tail_days(rets: DataFrame, q: float = 0.05, frac: float = 0.25, window: int = 504, minp: int = 252) -> DataFrame:
    """Dates on which at least ``frac`` of the assets fall below their own trailing quantile (past rows only)."""
    w = ordered().rowsBetween(-window, -1)
    x = rets.withColumn("q", guarded(F.percentile("r", F.lit(q)), "r", w, minp)).where("q is not null")
    return x.groupBy("date").agg(F.avg((F.col("r") < F.col("q")).cast("double")).alias("share")).withColumn("joint", (F.col("share") >= frac).cast("int"))


def ks_two_sample(x: DataFrame, group: str, value: str, pairs: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance for the given pairs (a, b) of groups.

    Both samples of a pair are stacked and counted up in value order; ties count together."""
    s = x.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # a group goes to each pair that it is in, by an equi-join
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.lit(1).alias("first")), F.struct(F.col("b").alias("g"), F.lit(0).alias("first")))).alias("z"), "a", "b")
    both = s.join(sides.select("z.*", "a", "b"), "g")
    grouped = both.groupBy("a", "b", "v").agg(F.sum(F.col("n") * F.col("first")).alias("na"), F.sum(F.col("n") * (1 - F.col("first"))).alias("nb"))
    by = Window.partitionBy("a", "b")
    run = by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("na").over(run) / F.sum("na").over(by) - F.sum("nb").over(run) / F.sum("nb").over(by))
    return grouped.withColumn("gap", gap).groupBy("a", "b").agg(F.max("gap").alias("ks"))
