"""The live ledger: canonical digests, adjustment detection, and the three congruence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .volatility import qlike

#: Schema of the ledger: LIVE rows carry weights, GAP rows a reason, REANCHOR rows factors.
LEDGER = (
    "date date, status string, as_of date, regime string, forecast_vol_ann double, exposure double, weights map<string,double>,"
    " input_digest string, code_version string, reason string, factors map<string,double>"
)


def digest(prices: DataFrame, by: str = "asset") -> DataFrame:
    """SHA-256 (16 hex digits) of each asset's closes in order of date, written with 8 decimals.

    A row's text is hashed by itself first; the digest is over the row hashes, so what is
    gathered per asset is short."""
    line = F.concat_ws("|", F.col(by), F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.format_string("%.6f", F.round("close", 6)))
    h = prices.select(by, "date", F.substring(F.sha2(line, 256), 1, 16).alias("h"))
    return h.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "h"))), lambda x: x["h"]), ""), 256).alias("d")).select(
        by, F.substring("d", 1, 16).alias("digest")
    )


def detect_adjustment(recent: DataFrame, recon: DataFrame, tol: float = 0.005, overlap: int = 5, least: int = 3) -> DataFrame:
    """Assets whose last common closes stand in a steady ratio other than 1, with the ratio."""
    j = recent.select("asset", "date", F.col("close").alias("new")).join(recon.select("asset", "date", F.col("close").alias("old")), ["asset", "date"])
    rn = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    s = j.withColumn("rn", rn).where(F.col("rn") <= overlap).withColumn("q", F.col("new") / F.col("old")).groupBy("asset").agg(
        F.avg("q").alias("factor"), F.stddev_samp("q").alias("sd"), F.count(F.lit(1)).alias("n")
    )
    return s.where((F.abs(F.col("factor") - 1) > tol) & (F.col("sd") < tol) & (F.col("n") >= least)).select("asset", F.round("factor", 8).alias("factor"))


def l1_reproduce(stored: DataFrame, recomputed: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Per date: the largest difference of stored and recomputed weights (missing counts as 0), and whether it passes."""
    a = stored.select("date", "asset", F.col("w").alias("w1"))
    b = recomputed.select("date", "asset", F.col("w").alias("w2"))
    d = F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w2", F.lit(0.0)))
    g = a.join(b, ["date", "asset"], "full_outer").groupBy("date").agg(F.max(d).alias("max_diff"))
    return g.withColumn("ok", (F.col("max_diff") <= tol).cast("int"))


def l2_tracking(ledger: DataFrame, realised: DataFrame, window: int = 90, least: int = 20) -> DataFrame:
    """Trailing mean QLIKE of the next day's squared return against the ledger's forecast variance."""
    w = Window.partitionBy("u").orderBy("date")
    nxt = realised.withColumn("rv", F.lead(F.col("r") * F.col("r")).over(w)).select("date", "u", "rv")
    j = ledger.join(nxt, "date").where("rv is not null").withColumn("loss", F.round(qlike("rv", "forecast_var"), 10))
    f = w.rowsBetween(-(window - 1), 0)
    return j.select("date", "loss", F.when(F.count("loss").over(f) >= least, F.avg("loss").over(f)).alias("mean_qlike"))


def l3_bands(ledger: DataFrame, floor: float = 0.0, cap: float = 1.0) -> DataFrame:
    """Counts of rows by status, and of exposures outside the band."""
    out = (F.col("exposure") < floor) | (F.col("exposure") > cap)
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(out, F.lit(False)).cast("int")).cast("long").alias("violations"))


def recommend(weights: DataFrame, exposure: float, notional: float = 100_000.0, least: float = 0.005) -> DataFrame:
    """Whole-dollar allocation of the latest target weights above ``least``, and cash."""
    last = weights.withColumn("rk", F.dense_rank().over(Window.partitionBy("u").orderBy(F.desc("date")))).where("rk = 1")
    rows = last.where(F.col("w") > least).select("asset", F.round(F.col("w") * exposure * notional, 0).alias("dollars"))
    cash = rows.agg((notional - F.coalesce(F.sum("dollars"), F.lit(0.0))).alias("dollars")).select(F.lit("CASH").alias("asset"), "dollars")
    return rows.unionByName(cash)
