"""Engine behaviour: entry, models in Spark, causality, streams equal to batches, sources, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom import panels as P
from quantloom.kernels import volmodels as M
from quantloom.operators import events, ledger, models, relational, resample, risk
from quantloom.plans import registry, t3
from quantloom.sources import files
from quantloom.streaming import live

SF = "/root/testdata/sf0.001"


def prices(spark, n=120, assets=3, seed=0):
    g = np.random.default_rng(seed)
    px = 100 * np.exp(np.cumsum(0.01 * g.standard_normal((n, assets)), axis=0))
    rows = [(f"a{k}", f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", float(px[i, k])) for i in range(n) for k in range(assets)]
    return spark.createDataFrame(rows, "asset string, d string, close double").select("asset", F.to_timestamp("d").alias("date"), "close")


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["asset", "date", "close", "r", "gk_var", "realized_vol", "drawdown", "z"] and out.count() > 0


@pytest.mark.parametrize("name", ["bars_daily", "perf_summary", "pair_correlation", "asof_regime_join", "histogram", "ks_two_sample"])
def test_queries_on_the_smallest_data(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["ewma_riskmetrics", "exposure_full", "hrp_weights", "kalman_pairs", "hedge_ensemble", "bootstrap_sharpe_ci", "permutation_mi", "variance_ratio", "hawkes_recovery", "minvar_bakeoff", "statarb_sleeve", "ewma_stream"])
def test_model_queries_run(spark, name):
    assert t3.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def prefix_equal(full, part, keys, values):
    a, b = (x.select(*keys, *values).toPandas().set_index(keys).sort_index() for x in (full, part))
    assert np.allclose(a.loc[b.index].to_numpy(float), b.to_numpy(float), equal_nan=True)


def test_causality_by_prefix(spark):
    """A causal operator gives the same rows whether or not the future is there."""
    p = prices(spark)
    r = P.returns(p)
    early = r.where("date < '2020-04-01'")
    prefix_equal(models.ewma_variance(r), models.ewma_variance(early), ["asset", "date"], ["s2"])
    prefix_equal(models.ewm_moments(r), models.ewm_moments(early), ["asset", "date"], ["ewm_mean"])
    e = lambda x: events.ews_indicators(x.withColumn("state", F.log("close")), window=20)
    prefix_equal(e(r), e(early), ["asset", "date"], ["ac1", "phi"])
    u = lambda x: risk.exposure_brakes(x.where("asset = 'a0'").withColumn("u", F.lit("x")))
    prefix_equal(u(r), u(early), ["date"], ["brake"])


def test_clean_panel_fills_and_drops(spark):
    p = prices(spark, 60)
    gone = p.where(~((F.col("asset") == "a1") & (F.dayofmonth("date").isin(5, 6))) & ~((F.col("asset") == "a2") & (F.month("date") == 1)))
    out = P.clean_panel(gone, 0.9, 3)
    assert {r[0] for r in out.select("asset").distinct().collect()} == {"a0", "a1"}
    assert out.groupBy("asset").count().select("count").distinct().count() == 1 and out.where("asset = 'a1'").count() == 60


def test_asof_limits_and_reanchor(spark):
    left = spark.createDataFrame([("x", 1), ("x", 5), ("x", 9), ("y", 5)], "k string, date int")
    right = spark.createDataFrame([("x", 2, 7.0), ("x", 5, 8.0)], "k string, date int, v double")
    got = {(r["k"], r["date"]): r["v"] for r in relational.asof_join(left, right, ("k",), "v").collect()}
    assert got == {("x", 1): None, ("x", 5): 8.0, ("x", 9): 8.0, ("y", 5): None}


def test_detect_adjustment_and_emit(spark):
    p = prices(spark, 30)
    new = p.withColumn("close", F.when(F.col("asset") == "a1", F.col("close") / 2).otherwise(F.col("close")))
    assert [(r["asset"], r["factor"]) for r in ledger.detect_adjustment(new, p).collect()] == [("a1", 0.5)]
    day = F.col("date").isin(*[r["date"] for r in p.select("date").distinct().orderBy("date").limit(3).collect()])
    batch = p.where(day & ~((F.dayofmonth("date") == 2) & (F.col("asset") == "a0")))
    rows = live.emit_rows(batch, lambda b: b.select("date", "asset", F.lit(0.5).alias("w")), batch.select("date").distinct(), 3).orderBy("date").collect()
    assert [r["status"] for r in rows] == ["LIVE", "GAP", "LIVE"] and rows[1]["weights"] is None and rows[1]["reason"]


def test_stream_equals_batch(spark, tmp_path):
    r = P.returns(prices(spark)).select("asset", "date", "r")
    days = sorted(x["date"] for x in r.select("date").distinct().collect())
    for k in range(3):
        lo, hi = days[k * len(days) // 3], days[min((k + 1) * len(days) // 3, len(days) - 1)]
        part = r.where((F.col("date") >= lo) & ((F.col("date") < hi) if k < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    x = live.read_bars(spark, str(tmp_path / "in"), "asset string, date timestamp, r double")
    live.ewm_stream(x).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index(["asset", "date"]).sort_index()
    want = models.ewm_moments(r).toPandas().set_index(["asset", "date"]).sort_index()
    assert len(got) == len(want) and np.allclose(got, want, equal_nan=True)


def test_files_round_trip(spark, tmp_path):
    p = prices(spark, 20)
    bars = p.select("asset", F.to_date("date").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")])
    files.write_genesis(bars, str(tmp_path / "g"))
    files.append_bars(bars.where("asset = 'a0'").limit(1).withColumn("close", F.lit(1.0)), str(tmp_path / "b"))
    led = spark.createDataFrame([("2020-01-10", "REANCHOR", {"a1": 0.5})], "date string, status string, factors map<string,double>").withColumn("date", F.to_date("date"))
    files.append_ledger(led, str(tmp_path / "l"))
    out = files.reconstruct(spark, str(tmp_path / "g"), str(tmp_path / "b"), str(tmp_path / "l"))
    assert out.count() == bars.count() and out.where("close = 1").count() == 1
    a1 = out.join(bars.select("asset", "date", F.col("close").alias("was")), ["asset", "date"]).where("asset = 'a1'").withColumn("q", F.round(F.col("close") / F.col("was"), 6))
    assert {(r["date"].day < 10, r["q"]) for r in a1.collect()} == {(True, 0.5), (False, 1.0)}
    wide = tmp_path / "w.csv"
    wide.write_text("date,x,y\n2020-01-01,1.5,\n2020-01-02,2.5,3\n")
    assert files.wide_csv(spark, str(wide)).count() == 3


def test_fan_out_does_not_depend_on_partitions(spark):
    m = P.returns(prices(spark)).where("asset = 'a0'").withColumn("u", F.lit("x"))
    a = resample.sharpe_draws(m, draws=20, chunks=2).orderBy("draw").select("sharpe").collect()
    b = resample.sharpe_draws(m.repartition(5), draws=20, chunks=5).orderBy("draw").select("sharpe").collect()
    assert a == b
    best, dsr = resample.deflated_sharpe(np.random.default_rng(0).standard_normal(2000) * 0.01, 100, 0.02)
    assert best > 0 and 0 <= dsr < 0.5


def test_garch_step_is_the_batch_filter():
    r = np.random.default_rng(1).standard_normal(300) * 0.01
    m = M.GjrGarch()
    m.level, m.alpha, m.gamma, m.beta = 1e-4, 0.05, 0.05, 0.9
    v = m.variances(r)
    assert all(abs(m.step(v[i], r[i]) - v[i + 1]) < 1e-18 for i in range(300))


def test_plans_push_down_and_avoid_python(spark):
    plan = registry.QUERIES["perf_summary"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    scan = registry.QUERIES["bars_brand"](spark, SF)._jdf.queryExecution().toString()
    assert "l_discount" not in scan.split("== Physical Plan ==")[1]
