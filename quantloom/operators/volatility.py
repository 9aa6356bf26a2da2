"""Range and close-to-close variance, and volatility losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ANNUAL, col, guarded, log_return, ordered, safe_div, safe_ln, trailing

#: 2 ln 2 - 1
GK = 0.3862943611198906


def gk_variance(bars: DataFrame, overnight: bool = True) -> DataFrame:
    """``bars`` with gk_var: Garman-Klass variance plus the squared overnight return; null where not positive."""
    hl, co = safe_ln(safe_div("high", "low")), safe_ln(safe_div("close", "open"))
    v = 0.5 * hl * hl - GK * co * co
    if overnight:
        gap = safe_ln(safe_div("open", F.lag("close").over(ordered())))
        v = v + gap * gap
    v = F.round(v, 10)
    return bars.withColumn("gk_var", F.when(v > 0, v))


def realized_vol(x: DataFrame, window: int = 10, annual: bool = True) -> DataFrame:
    """``x`` with realized_vol, the root of the trailing mean of gk_var (half a window at least)."""
    m = guarded(F.avg("gk_var"), "gk_var", trailing(window), max(2, window // 2))
    return x.withColumn("realized_vol", F.sqrt(m) * ((ANNUAL**0.5) if annual else 1.0))


def c2c_variance(prices: DataFrame) -> DataFrame:
    r = log_return("close")
    return prices.withColumn("c2c_var", r * r)


def qlike(rv: str | Column, f: str | Column) -> Column:
    """x - ln x - 1 of the ratio of realised to forecast variance."""
    x = F.greatest(col(rv), F.lit(1e-12)) / F.greatest(col(f), F.lit(1e-12))
    return F.when(col(rv).isNotNull() & col(f).isNotNull(), x - F.log(x) - 1)
