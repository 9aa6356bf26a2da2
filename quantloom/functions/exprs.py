"""Column builders: guarded windows, ranks, moments, and the normal distribution.

Missing values are NULL. A rolling value is NULL until its window holds ``minp``
observations; divisions by zero and logarithms of non-positive numbers are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ANNUAL = 252
BY = ("asset",)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered(by: tuple[str, ...] = BY, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def trailing(n: int, by: tuple[str, ...] = BY, order: str = "date") -> WindowSpec:
    """The last n rows with the current one."""
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def past_only(n: int, by: tuple[str, ...] = BY, order: str = "date") -> WindowSpec:
    """The n rows before the current one."""
    return ordered(by, order).rowsBetween(-n, -1)


def forward(n: int, by: tuple[str, ...] = BY, order: str = "date") -> WindowSpec:
    """The n rows after the current one."""
    return ordered(by, order).rowsBetween(1, n)


def expanding(by: tuple[str, ...] = BY, order: str = "date", lag: int = 0) -> WindowSpec:
    """All rows up to ``lag`` rows before the current one."""
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, -lag)


def guarded(agg: Column, x: str | Column, w: WindowSpec, minp: int) -> Column:
    """``agg`` over the window where it holds ``minp`` values of x."""
    return F.when(F.count(col(x)).over(w) >= minp, agg.over(w))


def roll_mean(x, n: int, minp: int | None = None, by=BY, order="date") -> Column:
    return guarded(F.avg(col(x)), x, trailing(n, by, order), minp or n)


def roll_std(x, n: int, minp: int | None = None, by=BY, order="date") -> Column:
    return guarded(F.stddev_samp(col(x)), x, trailing(n, by, order), minp or n)


def safe_div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_ln(x) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def log_return(price="close", by=BY, order="date", k: int = 1) -> Column:
    return safe_ln(safe_div(price, F.lag(col(price), k).over(ordered(by, order))))


def clip(x, low: float, high: float) -> Column:
    """Null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def xz(x, by: tuple[str, ...] = ("date",), cap: float = 3.0) -> Column:
    """Cross-sectional z-score, clipped; 0 where the spread vanishes."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(col(x)).over(w)
    z = (col(x) - F.avg(col(x)).over(w)) / F.when(sd >= 1e-12, sd)
    return F.when(col(x).isNotNull(), F.coalesce(clip(z, -cap, cap), F.lit(0.0)))


def average_rank(x, by: tuple[str, ...]) -> Column:
    """Rank with ties at their mean."""
    x = col(x)
    first = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), first + (ties - 1) / 2.0)


def skew_g1(x) -> Column:
    """Bias-corrected skewness (aggregate)."""
    x = col(x)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(x) -> Column:
    """Bias-corrected excess kurtosis (aggregate)."""
    x = col(x)
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def corr_pop(x, y) -> Column:
    """Correlation, null where a side is constant (aggregate)."""
    return F.nanvl(F.corr(col(x), col(y)), F.lit(None).cast("double"))


# fixed values: coefficients of Acklam's inverse normal and of Zelen and Severo's normal distribution
PPF_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
PPF_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
PPF_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_ppf_sql(p: str) -> str:
    """Inverse of the normal distribution as SQL text, for both engines."""
    horner = lambda cs, x: __import__("functools").reduce(lambda a, c: f"({a}*{x}+({c!r}))", cs[1:], f"({cs[0]!r})")
    low = f"sqrt(-2*ln({p}))"
    high = f"sqrt(-2*ln(1-({p})))"
    q = f"(({p})-0.5)"
    r = f"({q}*{q})"
    return (
        f"(case when {p} is null or {p}<=0 or {p}>=1 then null when {p}<0.02425 then {horner(PPF_C, low)}/{horner(PPF_D, low)}"
        f" when {p}<=0.97575 then {horner(PPF_A, r)}*{q}/{horner(PPF_B, r)} else -{horner(PPF_C, high)}/{horner(PPF_D, high)} end)"
    )


def norm_cdf_sql(x: str) -> str:
    """Normal distribution function as SQL text, absolute error below 1e-7."""
    t = f"(1/(1+0.2316419*abs({x})))"
    poly = "+".join(f"({c!r})*power({t},{k})" for k, c in enumerate(CDF, 1))
    tail = f"(exp(-({x})*({x})/2)/2.5066282746310002*({poly}))"
    return f"(case when {x} is null then null when {x}>=0 then 1-{tail} else {tail} end)"


def norm_ppf(c: str) -> Column:
    return F.expr(norm_ppf_sql(c))


def norm_cdf(c: str) -> Column:
    return F.expr(norm_cdf_sql(c))
