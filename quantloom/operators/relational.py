"""Joins and set operations on panels: as-of, bounded as-of, range re-anchoring, upsert, band and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: tuple[str, ...], value: str, on: str = "date", limit: int | None = None) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's time.

    Both sides are stacked and carried forward in one sorted window per key: a single
    shuffle, no inequality join. With ``limit`` a value reaches its own and that many
    further rows of ``left``, as a bounded forward fill. ``right`` has one row per key and time."""
    names = left.columns
    lhs = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    rhs = right.select(*[F.col(c) if c in (*by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = lhs.unionByName(rhs).withColumn("_n", F.sum("_side").over(w))  # rows of left so far
    last = F.last(F.when(F.col("_v").isNotNull(), F.struct("_v", "_n")), ignorenulls=True).over(w)
    near = F.lit(True) if limit is None else F.col("_n") - F.col("_last._n") <= limit + 1
    return both.withColumn("_last", last).where("_side = 1").select(*names, F.when(near, F.col("_last._v")).alias(value))


def reanchor(bars: DataFrame, events: DataFrame, price: str = "close") -> DataFrame:
    """Prices times the product of the factors of all later events of the asset (date < event date).

    The factors of an asset are few and are gathered per asset; a bar's product is one fold."""
    ev = events.groupBy("asset").agg(F.collect_list(F.struct("event_date", "factor")).alias("_ev"))
    f = F.aggregate(F.coalesce("_ev", F.array().cast(ev.schema["_ev"].dataType)), F.lit(1.0), lambda a, x: F.when(x["event_date"] > F.col("date"), a * x["factor"]).otherwise(a))
    return bars.join(ev, "asset", "left").withColumn("factor", f).withColumn("adjusted", F.col(price) * F.col("factor")).drop("_ev")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("asset", "date")) -> DataFrame:
    """Union in which the newer of two rows with equal keys stays."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_v")


def full_outer_default(a: DataFrame, b: DataFrame, keys: tuple[str, ...], default: float = 0.0) -> DataFrame:
    """Outer join whose missing numbers are ``default``."""
    out = a.join(b, list(keys), "full_outer")
    return out.select(*[F.col(c) if c in keys else F.coalesce(F.col(c), F.lit(default)).alias(c) for c in out.columns])


def nearest_bin(x: DataFrame, value: str, bins: DataFrame, center: str, width: float) -> DataFrame:
    """Equi-join on the rounded number of the bin: no inequality."""
    key = lambda c: F.floor(F.col(c) / width + 0.5).cast("long")
    return x.withColumn("_k", key(value)).join(F.broadcast(bins.withColumn("_k", key(center))), "_k", "left").drop("_k")


def decimate(x: DataFrame, value: str, buckets: int = 300, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """First row of each bucket's minimum, maximum and last value: a plot keeps its extremes."""
    w = Window.partitionBy(*by)
    rn = F.row_number().over(w.orderBy("date")) - 1
    y = x.withColumn("b", F.floor(rn * buckets / F.count(F.lit(1)).over(w)).cast("int"))
    g = y.groupBy(*by, "b").agg(
        F.array_distinct(F.array(F.min_by("date", F.struct(value, "date")), F.max_by("date", F.struct(F.col(value), -F.unix_timestamp("date"))), F.max("date"))).alias("ds")
    )
    keep = g.select(*by, F.explode("ds").alias("date"))
    return x.join(keep, [*by, "date"], "left_semi")
