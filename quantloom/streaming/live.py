"""Streams: bar ingest, stateful recursions with the batch step functions, and the live ledger.

The fields of each step object of the kernels (EWMA, EWM moments, Kalman, hysteresis,
Hedge) are the state of its key, so a stream gives what the batch gives."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.volmodels import Ewma, EwmMoments


def read_bars(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet bars as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def idempotent(bars: DataFrame, delay: str = "7 days") -> DataFrame:
    """Rows once per asset and date, with a bound on the state."""
    return bars.withWatermark("date", delay).dropDuplicatesWithinWatermark(["asset", "date"])


def stateful(x: DataFrame, make: Callable[[], object], step: Callable[[object, pd.Series], tuple], schema: str, key: str = "asset") -> DataFrame:
    """``step(state, row)`` on each key's rows in the order of their dates within a micro-batch.

    The schema is that of the returned tuples; key and date are put in front."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        obj = make()
        if state.exists:
            vars(obj).update(pickle.loads(state.get[0]))
        rows = pd.concat(list(batches)).sort_values("date", kind="stable")
        out = [(k[0], r["date"], *step(obj, r)) for _, r in rows.iterrows()]
        state.update((pickle.dumps(vars(obj)),))
        yield pd.DataFrame(out, columns=names)

    kind = f"`{key}` {x.schema[key].dataType.simpleString()}, date timestamp, {schema}"
    names = [c.split()[0].strip("`") for c in kind.split(", ")]
    return x.groupBy(key).applyInPandasWithState(run, kind, "state binary", "append", "NoTimeout")


def ewma_stream(x: DataFrame, lam: float = 0.94, key: str = "asset") -> DataFrame:
    """Variance after each row."""
    return stateful(x, lambda: Ewma(lam), lambda m, r: (m.step(float(r["r"])),), "s2 double", key)


def ewm_stream(x: DataFrame, halflife: float = 21.0, key: str = "asset") -> DataFrame:
    return stateful(x, lambda: EwmMoments(halflife), lambda m, r: m.step(float(r["r"])), "ewm_mean double, ewm_std double", key)


def run_to_end(x: DataFrame, folder: str) -> DataFrame:
    """What the stream has put out by the end of its input; output and checkpoint in a folder of the run's own."""
    w = x.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck")
    w.trigger(availableNow=True).start().awaitTermination()
    return x.sparkSession.read.schema(x.schema).parquet(f"{folder}/out")


def tumbling_bars(ticks: DataFrame, width: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Bars of event-time windows; late ticks beyond the delay go."""
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("asset"))
    a = g.agg(F.min_by("value", F.struct("ts", "value")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "value")).alias("close"), F.count(F.lit(1)).alias("n"))
    return a.select("asset", F.col("w.start").alias("date"), "open", "high", "low", "close", "n")


def emit_rows(batch: DataFrame, recommend: Callable[[DataFrame], DataFrame], calendar: DataFrame, min_assets: int) -> DataFrame:
    """One ledger row per expected day: LIVE with weights where enough assets have a bar, else GAP; never a stale row."""
    seen = batch.groupBy("date").agg(F.countDistinct("asset").alias("n"))
    days = calendar.join(seen, "date", "left").withColumn("live", F.coalesce(F.col("n") >= min_assets, F.lit(False)))
    w = recommend(batch).groupBy("date").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "w")))).alias("weights"))
    x = days.join(w, "date", "left")
    return x.select(
        F.to_date("date").alias("date"), F.when(F.col("live"), "LIVE").otherwise("GAP").alias("status"), F.when(F.col("live"), F.col("weights")).alias("weights"),
        F.when(~F.col("live"), F.concat(F.lit("bars of "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" assets"))).alias("reason"),
    )


def ledger_stream(bars: DataFrame, path: str, checkpoint: str, recommend: Callable[[DataFrame], DataFrame], min_assets: int):
    """Append a ledger row for each day of a micro-batch. A batch that is run again writes to the
    same folder of its id, so no row is doubled."""

    def each(batch: DataFrame, batch_id: int) -> None:
        days = batch.select("date").distinct()
        emit_rows(batch, recommend, days, min_assets).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
