"""Events and information: crash labels, early-warning indicators, AUC, mutual information, entropy production, exceedances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, corr_pop, ordered, past_only, safe_div, safe_ln
from .expanding import expanding_quantiles


def crash_labels(prices: DataFrame, horizon: int = 20, q: float = 0.05, min_history: int = 504, lower: bool = True, causal: bool = False) -> DataFrame:
    """fwd: log return over the next ``horizon`` rows; label 1 where it lies beyond the expanding quantile of earlier ones.

    The threshold at t uses forward returns up to row t-1, which end after t; ``causal`` takes
    only those that have ended by t. The last rows have no label."""
    lag = horizon if causal else 1
    x = prices.withColumn("fwd", F.round(safe_ln(safe_div(F.lead("close", horizon).over(ordered()), "close")), 10))
    x = expanding_quantiles(x, "fwd", {"threshold": q if lower else 1 - q}, lag=lag, least=min_history)
    hit = F.col("fwd") < F.col("threshold") if lower else F.col("fwd") > F.col("threshold")
    return x.withColumn("label", F.when(F.col("fwd").isNotNull() & F.col("threshold").isNotNull(), hit.cast("int")))


def jumps_to_labels(x: DataFrame, horizon: int = 20, jump: str = "jump") -> DataFrame:
    """1 if a jump falls into the next ``horizon`` rows; the last rows have none."""
    w = ordered().rowsBetween(1, horizon)
    return x.withColumn("label", F.when(F.count(jump).over(w) >= horizon, F.max(jump).over(w)))


def ews_indicators(x: DataFrame, state: str = "state", ret: str = "r", window: int = 60) -> DataFrame:
    """Over the ``window`` rows before each: variance and skewness of the state, its lag-1 and lag-2
    autocorrelation and AR(1) coefficient, variance of returns, kappa = -ln phi."""
    y = x.withColumn("s1", F.lag(state, 1).over(ordered())).withColumn("s2", F.lag(state, 2).over(ordered()))
    w = past_only(window)
    n = F.count(state).over(w)
    var, cov = F.var_pop(state).over(w), F.covar_pop(state, "s1").over(w)
    full = lambda c: F.when(n >= window, c)
    phi = F.try_divide(cov, F.var_pop("s1").over(w))
    return y.select(
        "asset", "date", full(var).alias("state_var"), full(F.skewness(state).over(w)).alias("state_skew"),
        full(F.corr(state, "s1").over(w)).alias("ac1"), full(F.corr(state, "s2").over(w)).alias("ac2"), full(phi).alias("phi"),
        full(F.var_samp(ret).over(w)).alias("ret_var"),
    ).withColumn("kappa", F.when(F.col("phi") > 0, -F.log(F.least("phi", F.lit(0.9999)))))


def auc(x: DataFrame, score: str, label: str, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Mann-Whitney area with average ranks."""
    r = x.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("rk", average_rank(score, by))
    s = r.groupBy(*by).agg(F.sum((F.col(label) == 1).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col(label) == 1, F.col("rk"))).alias("s"))
    return s.select(*by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def terciles(x: DataFrame, value: str, name: str, by: tuple[str, ...] = ("asset",), k: int = 3) -> DataFrame:
    """Bucket 0..k-1 by the order of values (first come first), equal sizes."""
    w = Window.partitionBy(*by)
    rn = F.row_number().over(w.orderBy(value, "date"))
    return x.withColumn(name, F.floor((rn - 1) * k / F.count(F.lit(1)).over(w)).cast("int"))


def stratified_lift(x: DataFrame, signal: str, control: str, label: str, stratum: int = 1) -> DataFrame:
    """Event rate in the top and the bottom third of the signal within a middle third of the control."""
    y = terciles(x.where(F.col(signal).isNotNull() & F.col(control).isNotNull() & F.col(label).isNotNull()), control, "c")
    z = terciles(y.where(F.col("c") == stratum), signal, "s")
    rate = lambda k: F.avg(F.when(F.col("s") == k, F.col(label).cast("double")))
    return z.groupBy("asset").agg(rate(2).alias("top"), rate(0).alias("bottom")).withColumn("lift", F.try_divide("top", "bottom"))


def precursor_shift(x: DataFrame, signal: str, label: str, window: int = 20) -> DataFrame:
    """Mean standardised signal in the rows before an onset (label turning 1), and elsewhere."""
    z = x.where(F.col(signal).isNotNull()).withColumn("z", F.try_divide(F.col(signal) - F.avg(signal).over(Window.partitionBy("asset")), F.stddev_pop(signal).over(Window.partitionBy("asset"))))
    onset = ((F.col(label) == 1) & (F.coalesce(F.lag(label).over(ordered()), F.lit(0)) == 0)).cast("int")
    y = z.withColumn("on", F.coalesce(onset, F.lit(0))).withColumn("pre", F.coalesce(F.max("on").over(ordered().rowsBetween(1, window)), F.lit(0)))
    return y.groupBy("asset").agg(F.avg(F.when(F.col("pre") == 1, F.col("z"))).alias("before"), F.avg(F.when(F.col("pre") == 0, F.col("z"))).alias("elsewhere"), F.sum("on").alias("onsets"))


def discrete_mi(x: DataFrame, a: str, b: str, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Plug-in mutual information in nats, less the Miller-Madow bias (kj - kx - ky + 1) / 2N."""
    c = x.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    tot = F.sum("n").over(w)
    na, nb = F.sum("n").over(Window.partitionBy(*by, "a")), F.sum("n").over(Window.partitionBy(*by, "b"))
    t = c.withColumn("tot", tot).withColumn("na", na).withColumn("nb", nb)
    t = t.withColumn("term", F.col("n") / F.col("tot") * F.log(F.col("n") * F.col("tot") / (F.col("na") * F.col("nb"))))
    g = t.groupBy(*by).agg(
        F.sum("term").alias("plugin"), F.count(F.lit(1)).alias("kj"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"), F.max("tot").alias("n")
    )
    return g.select(*by, (F.col("plugin") - (F.col("kj") - F.col("ka") - F.col("kb") + 1) / (2 * F.col("n"))).alias("mi"))


def symbolize(x: DataFrame, value: str, bins: int = 3) -> DataFrame:
    """Symbol of each value by the quantiles of its asset; a value on an edge goes up."""
    y = x.where(F.col(value).isNotNull())
    sym = F.lit(0)
    for k in range(1, bins):
        y = y.withColumn(f"_e{k}", F.percentile(value, F.lit(k / bins)).over(Window.partitionBy("asset")))
        sym = sym + (F.col(value) >= F.col(f"_e{k}")).cast("int")
    return y.withColumn("symbol", sym).drop(*[f"_e{k}" for k in range(1, bins)])


def ngram_entropy_production(x: DataFrame, n: int = 3, bins: int = 3, alpha: float = 0.5) -> DataFrame:
    """Divergence of forward from reversed n-grams of ``symbol`` in bits per step, alpha added to every cell."""
    code, back = F.lit(0), F.lit(0)
    for k in range(n):
        s = F.lead("symbol", k).over(ordered())
        code = code * bins + s
        back = back + s * F.lit(bins**k)
    grams = x.select("asset", code.alias("f"), back.alias("b")).where("f is not null")
    f = grams.groupBy("asset", F.col("f").alias("c")).agg(F.count(F.lit(1)).alias("nf"))
    b = grams.groupBy("asset", F.col("b").alias("c")).agg(F.count(F.lit(1)).alias("nb"))
    cells = x.select("asset").distinct().select("asset", F.explode(F.sequence(F.lit(0), F.lit(bins**n - 1))).alias("c"))
    full = cells.join(f, ["asset", "c"], "left").join(b, ["asset", "c"], "left").na.fill(0, ["nf", "nb"])
    tot = F.sum("nf").over(Window.partitionBy("asset")) + alpha * bins**n
    p, q = (F.col("nf") + alpha) / tot, (F.col("nb") + alpha) / tot
    return full.withColumn("t", p * F.log2(p / q)).groupBy("asset").agg((F.sum("t") / n).alias("ep"))


def exceedances(x: DataFrame, value: str, q: float = 0.95) -> DataFrame:
    """Rows whose absolute value is above its quantile, with their position."""
    y = x.where(F.col(value).isNotNull()).withColumn("pos", F.row_number().over(ordered()) - 1).withColumn("_q", F.percentile(F.abs(value), F.lit(q)).over(Window.partitionBy("asset")))
    return y.where(F.abs(F.col(value)) > F.col("_q")).select("asset", "date", F.col("pos").cast("long").alias("pos"))


def real_range_audit(bars: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of bars with a genuine range per asset, and whether the asset passes."""
    g = bars.groupBy("asset").agg(F.avg((F.col("high") > F.col("low")).cast("double")).alias("share"))
    return g.withColumn("passed", (F.col("share") > least).cast("int"))


def autocorr(x: DataFrame, value: str, lag: int) -> DataFrame:
    return x.withColumn("_l", F.lag(value, lag).over(ordered())).groupBy("asset").agg(corr_pop(value, "_l").alias("acf"))


def sharpe_ceiling(mi_nats: Column) -> Column:
    """Annual Sharpe ratio that so many nats a day allow in a Gaussian channel."""
    return F.sqrt(F.exp(2 * mi_nats) - 1) * (252**0.5)


def bits_consumed(sharpe: Column) -> Column:
    return 0.5 * F.log2(1 + sharpe * sharpe / 252)


def causal_features(rets: DataFrame) -> DataFrame:
    """Sign, sign of the trailing 21-row sum, tercile of volatility, sign of the next return."""
    w21 = ordered().rowsBetween(-20, 0)
    y = rets.withColumn("sg", F.signum("r").cast("int")).withColumn("mom", F.when(F.count("r").over(w21) >= 21, F.signum(F.round(F.sum("r").over(w21), 8)).cast("int")))
    y = y.withColumn("vol", F.round(F.sqrt(F.avg(F.col("r") * F.col("r")).over(w21)), 10)).withColumn("next", F.signum(F.lead("r").over(ordered())).cast("int"))
    return terciles(y.where("mom is not null and next is not null"), "vol", "volt")
