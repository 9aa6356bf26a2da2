"""Sources and sinks: wide and long CSV, JSON lines, snapshots; all by Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import LEDGER

BARS = "date date, asset string, open double, high double, low double, close double"


def wide_csv(spark: SparkSession, path: str, value: str = "close", date: str = "date") -> DataFrame:
    """A wide file (dates by assets, gzip or not) as long rows; empty cells go."""
    x = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = [c for c in x.columns if c != date]
    long = x.unpivot([date], cols, "asset", value)
    return long.select(F.to_date(date).alias("date"), "asset", F.expr(f"try_cast({value} as double)").alias(value)).where(F.col(value).isNotNull())


def ohlc_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Four wide files joined to bars."""
    out = None
    for field, path in paths.items():
        one = wide_csv(spark, path, field)
        out = one if out is None else out.join(one, ["date", "asset"])
    return out


def bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(BARS).csv(path)


def append_bars(bars: DataFrame, path: str) -> None:
    """Append; readers keep the last row of a date, so a repeated append does no harm."""
    bars.selectExpr("cast(date as date) date", "asset", "open", "high", "low", "close").write.mode("append").option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows with keys in order; null fields are left out."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def write_genesis(bars: DataFrame, path: str) -> DataFrame:
    """Partitioned snapshot and one row of metadata: digest, span, number of assets."""
    bars.write.mode("errorifexists").parquet(f"{path}/bars")
    line = F.concat_ws("|", "asset", F.date_format("date", "yyyy-MM-dd"), F.format_string("%.6f", "close"))
    meta = bars.agg(
        F.lower(F.hex(F.bit_xor(F.xxhash64(line)))).alias("close_digest"), F.array(F.min("date"), F.max("date")).alias("span"), F.countDistinct("asset").cast("int").alias("n_tickers")
    )
    meta.write.mode("errorifexists").json(f"{path}/meta")
    return meta


def reconstruct(spark: SparkSession, genesis: str, bars: str | None = None, ledger: str | None = None) -> DataFrame:
    """Genesis and later bars (the last row of a date stays), re-anchored by the factors of later events."""
    from ..operators.relational import reanchor, upsert

    x = spark.read.parquet(f"{genesis}/bars").select("asset", F.to_date("date").alias("date"), "close")
    if bars:
        new = bars_csv(spark, bars).select("asset", "date", "close").withColumn("_n", F.monotonically_increasing_id())
        w = Window.partitionBy("asset", "date").orderBy(F.desc("_n"))
        x = upsert(x, new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_n"))
    if ledger:
        ev = read_ledger(spark, ledger).where("status = 'REANCHOR'").select(F.col("date").alias("event_date"), F.explode("factors").alias("asset", "factor"))
        x = reanchor(x, ev).select("asset", "date", F.col("adjusted").alias("close"))
    return x
