"""Panels in long form: bars (asset, date, open, high, low, close, volume) and prices.

Bars come from ticks by aggregation in tick order; panels of closes from bars or daily
means. All operators partition by asset, so each stage shuffles once on that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.exprs import log_return, ordered, roll_mean, trailing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_bars(ticks: DataFrame, asset: Column, date: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """Bars per asset and date: first, highest, lowest and last price in ``order``, and volume."""
    t = ticks.select(asset.alias("asset"), date.alias("date"), price.alias("p"), order.alias("o"), volume.alias("v"))
    return t.groupBy("asset", "date").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"),
    )


def _line_order() -> Column:
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def bars_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six assets (return flag and line status) by ship date."""
    li = table(spark, sf_dir, "lineitem")
    return make_bars(
        li, F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"), F.col("l_extendedprice"), _line_order(), F.col("l_quantity")
    )


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by hour."""
    ev = table(spark, sf_dir, "events")
    return make_bars(ev, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.struct("ts", "event_id"), F.lit(1.0))


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by ship date, over a join with the parts."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return make_bars(li, F.col("p_brand"), F.col("l_shipdate"), F.col("l_extendedprice"), _line_order(), F.col("l_quantity"))


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations by week of order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return make_bars(o, F.col("c_nationkey").cast("string"), F.date_trunc("week", "o_orderdate"), F.col("o_totalprice"), F.struct("o_orderkey"), F.lit(1.0))


def daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.col("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("px"))


def panel_flag(spark: SparkSession, sf_dir: str, smooth: int = 20) -> DataFrame:
    """Smoothed closes of the six assets: the default price of return-based operators."""
    p = daily_mean(spark, sf_dir).withColumn("close", F.round(roll_mean("px", smooth), 3))
    return p.where(F.col("close").isNotNull()).select("asset", "date", "close")


def returns(prices: DataFrame) -> DataFrame:
    """Prices with log returns; the first row of an asset has none and goes."""
    r = prices.withColumn("r", F.round(log_return("close"), 10))
    return r.where(F.col("r").isNotNull())


def market(rets: DataFrame) -> DataFrame:
    """Equal-weight proxy by date."""
    return rets.groupBy("date").agg(F.round(F.avg("r"), 12).alias("r"))


def clean_panel(
    prices: DataFrame, min_coverage: float = 0.95, max_ffill: int = 3, bad_tick: float = 0.6, price: str = "close"
) -> DataFrame:
    """Coverage filter, bounded forward fill on the spine of dates, complete dates only, bad ticks flattened.

    Returns asset, date, close. The dates of the panel are its spine; an asset stays if it
    has a price on at least ``min_coverage`` of them.
    """
    p = prices.where(F.col(price).isNotNull()).select("asset", "date", F.col(price).alias("close"))
    # the dates of the panel as one row: a calendar has some thousands, whatever the assets
    spine = p.select("date").distinct().agg(F.collect_list("date").alias("dates"))
    sizes = p.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(spine))
    kept = sizes.where(F.col("n") >= min_coverage * F.size("dates"))
    grid = kept.select("asset", F.explode("dates").alias("date")).join(p, ["asset", "date"], "left")
    filled = grid.withColumn("close", F.last("close", ignorenulls=True).over(ordered().rowsBetween(-max_ffill, 0)))
    n_assets = kept.agg(F.count(F.lit(1)).alias("n_assets"))
    whole = filled.where("close is not null").groupBy("date").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n_assets), F.col("n") == F.col("n_assets")).select("date")
    full = filled.join(whole, "date", "left_semi").select("asset", "date", "close")
    return flatten_bad_ticks(full, bad_tick)


def flatten_bad_ticks(prices: DataFrame, bad_tick: float) -> DataFrame:
    """Moves of more than ``bad_tick`` become 0 and the price path is rebuilt from the rest."""
    w = ordered()
    r = F.col("close") / F.lag("close").over(w) - 1
    step = prices.withColumn("s", F.when(F.abs(r) > bad_tick, F.lit(0.0)).otherwise(F.coalesce(F.log1p(r), F.lit(0.0))))
    grown = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return step.select("asset", "date", (first * F.exp(grown)).alias("close"))


def regimes_by_vol(rets: DataFrame, n: int = 20, least: int = 60) -> DataFrame:
    """A plain rule beside the model regimes: trailing volatility against the terciles of all earlier
    days (0 calm, 2 stressed); the middle one before ``least`` of them. Later days change nothing."""
    from .operators.expanding import expanding_quantiles

    vol = rets.withColumn("vol", F.round(F.sqrt(F.avg(F.col("r") * F.col("r")).over(trailing(n, ("u",)))), 10))
    cut = expanding_quantiles(vol.select("u", "date", "r", "vol"), "vol", {"a": 1 / 3, "b": 2 / 3}, by="u", least=least)
    kind = F.when(F.col("a").isNull(), 1).when(F.col("vol") > F.col("b"), 2).when(F.col("vol") > F.col("a"), 1).otherwise(0)
    return cut.select("date", "r", kind.cast("int").alias("regime"))
