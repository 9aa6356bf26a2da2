"""The trading system, books, expanding quantiles and intervals against plain loops; causality by prefix."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import panels as P
from quantloom.kernels import worlds as W
from quantloom.operators import expanding, laws, models, relational, resample
from quantloom.plans import book, registry, system


def panel(spark, n=420, assets=4, seed=3, calm=0):
    g = np.random.default_rng(seed)
    sd = np.where(np.arange(n) // 90 % 2, 0.02, 0.008)[:, None] * (1 + np.arange(assets) / 3)
    sd[n - calm :] *= 8
    px = 100 * np.exp(np.cumsum(sd * (0.5 * g.standard_normal((n, 1)) + g.standard_normal((n, assets))), axis=0))
    days = pd.date_range("2000-01-01", periods=n)
    rows = pd.DataFrame({"asset": np.tile([f"a{k}" for k in range(assets)], n), "date": np.repeat(days, assets), "close": px.ravel()})
    return spark.createDataFrame(rows).withColumn("date", F.col("date").cast("timestamp"))


CFG = system.SystemConfig(every=21, window=120, refit=21, first=150, target_vol=0.15)


def run(spark, prices):
    r = P.returns(prices)
    gk = r.withColumn("gk_var", F.col("r") * F.col("r") + 1e-8).select("asset", "date", "gk_var")
    m = P.market(r).withColumn("u", F.lit("m"))
    return r, gk, system.run_system(r, gk, P.regimes_by_vol(m).withColumn("u", F.lit("m")), CFG)


def test_system_book_and_exposure_by_hand(spark):
    r, gk, got = run(spark, panel(spark))
    wide = r.toPandas().pivot(index="date", columns="asset", values="r")
    w = got["daily"].toPandas().pivot(index="date", columns="asset", values="weight").reindex(wide.index)
    assert np.allclose(w.dropna().sum(1), 1)
    vols = system.asset_vol(gk, CFG).toPandas().pivot(index="date", columns="asset", values="forecast").reindex(wide.index).shift(1)
    e = got["exposure"].toPandas().set_index("date").sort_index()
    raw, vol = [], np.nan
    for t in e.index:
        i = wide.index.get_loc(t)
        d, x = vols.iloc[i].to_numpy(), w.iloc[i].to_numpy()
        if np.isfinite(d).all():
            c = np.corrcoef(wide.iloc[max(0, i - CFG.window) : i].to_numpy().T)
            vol = np.sqrt((d * x) @ c @ (d * x))
        assert (np.isnan(vol) and pd.isna(e.loc[t, "vol"])) or abs(vol - e.loc[t, "vol"]) < 1e-9
        past = e.loc[:t, "r"].to_numpy()
        tail = past[-252:]
        cvar = -tail[tail <= np.quantile(tail, 0.05)].mean() if len(tail) >= 50 else np.nan
        nav = np.cumprod(1 + past)
        dd = nav[-1] / nav.max() - 1
        parts = [min(1, CFG.target_vol / vol) if vol == vol else 1, min(1, CFG.cvar_target / cvar) if cvar == cvar and cvar > 0 else 1]
        parts.append(1 - min(max((-dd - CFG.dd_start) / (CFG.dd_floor - CFG.dd_start), 0), 1) * (1 - CFG.floor))
        raw.append(min(parts))
    assert np.allclose(e["raw"], raw, atol=1e-9)
    assert np.allclose(e["exposure"], pd.Series(raw).ewm(span=CFG.smooth).mean().clip(0, 1))
    net = got["net"].toPandas().set_index("date").sort_index()
    assert np.allclose(net["applied"], np.concatenate([[1.0], e["exposure"].to_numpy()[:-1]])) and np.allclose(net["net"], net["r"] * net["applied"] - net["cost"])


def test_system_does_not_look_ahead(spark):
    cut = pd.Timestamp("2000-01-01") + pd.Timedelta(days=379)
    a, b = (run(spark, p)[2]["net"].where(F.col("date") < F.lit(cut)).toPandas().set_index("date").sort_index() for p in (panel(spark), panel(spark, calm=40)))
    assert len(a) > 200 and np.allclose(a[["net", "applied"]], b[["net", "applied"]])


def test_allocation_is_whole_dollars(spark):
    got = {x["asset"]: x["dollars"] for x in system.allocation(run(spark, panel(spark))[2], 10_000).collect()}
    assert abs(sum(got.values()) - 10_000) < 1e-6 and all(v == round(v) for k, v in got.items() if k != "CASH")


def test_book_without_weights_holds_cash(spark):
    r = P.returns(panel(spark, 60, 2))
    at = r.agg(F.min("date").alias("at"))
    trades = at.crossJoin(r.select("asset").distinct()).select(F.lit(1).alias("k"), "at", "asset", F.lit(0.0).alias("w"), F.lit(0.0).alias("dw"))
    got = book.daily_weights(trades, r)
    assert got.count() > 0 and got.where("weight <> 0 or weight is null").count() == 0


def test_expanding_quantiles_are_percentiles_of_the_past(spark):
    g = np.random.default_rng(5)
    rows = [(a, i, None if g.random() < 0.1 else float(np.round(g.standard_normal(), 1))) for a in ("x", "y") for i in range(80)]
    df = spark.createDataFrame(rows, "asset string, date int, v double")
    got = expanding.expanding_quantiles(df, "v", {"lo": 0.2, "hi": 1 / 3}, lag=3, least=5).collect()
    for r in got:
        past = [v for a, i, v in rows if a == r["asset"] and i <= r["date"] - 3 and v is not None]
        for name, q in (("lo", 0.2), ("hi", 1 / 3)):
            assert (r[name] is None) == (len(past) < 5)
            assert r[name] is None or abs(r[name] - np.quantile(past, q)) < 1e-12


def test_regimes_by_volatility_are_causal(spark):
    a, b = (P.regimes_by_vol(P.market(P.returns(panel(spark, calm=c))).withColumn("u", F.lit("m"))).orderBy("date").toPandas() for c in (0, 60))
    assert (a["regime"][:355] == b["regime"][:355]).all() and set(a["regime"]) == {0, 1, 2}


def test_bounded_asof_counts_rows_of_the_left(spark):
    left = spark.createDataFrame([("k", i) for i in (1, 2, 4, 6, 8, 9)], "u string, date int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 3, "b"), ("k", 3, "b"), ("k", 7, None)], "u string, date int, v string").dropDuplicates()
    got = [(r["date"], r["v"]) for r in relational.asof_join(left, right, ("u",), "v", limit=1).orderBy("date").collect()]
    assert got == [(1, None), (2, "a"), (4, "b"), (6, "b"), (8, None), (9, None)]


def test_ks_distance_by_hand(spark):
    g = np.random.default_rng(8)
    x = {k: np.round(g.standard_normal(60) + s, 1) for k, s in (("a", 0), ("b", 0.5), ("c", -1))}
    df = spark.createDataFrame([(k, float(v)) for k, xs in x.items() for v in xs], "g string, v double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    for r in laws.ks_two_sample(df, "g", "v", pairs).collect():
        at = np.union1d(x[r["a"]], x[r["b"]])
        f = lambda k: (x[k][:, None] <= at).mean(0)  # noqa: B023, E731
        assert abs(r["ks"] - np.abs(f(r["a"]) - f(r["b"])).max()) < 1e-12


def test_intervals_hold_their_statistic(spark):
    r, v = W.gjr_returns(1500, W.rng_of(1))
    days = pd.date_range("2000-01-01", periods=1500)
    x = spark.createDataFrame(pd.DataFrame({"asset": "g", "date": days, "r": r, "gk_var": v}))
    z = resample.zumbach_interval(x, draws=60).first()
    want = laws.zumbach(x).first()["zumbach"]
    assert abs(z["zumbach"] - want) < 1e-9 and z["lo"] <= z["hi"] and 0 <= z["positive"] <= 1
    h = resample.hurst_interval(x, draws=20).first()
    assert abs(h["hurst"] - laws.hurst(x).first()["hurst"]) < 1e-9 and h["lo"] <= h["hi"]
    band = {b["window"]: b["band"] for b in resample.tracking_null(spark, (20, 90), 200).collect()}
    assert band[20] > band[90] > 1.27  # the mean of x - ln x - 1 for a squared normal
    c = resample.cluster_interval(spark.createDataFrame([(float(k), "c") for k in range(50)], "g double, c string"), "g", ["c"]).first()
    assert c["mean"] == 24.5 and c["lo"] < 24.5 < c["hi"]


def test_jump_penalty_uses_the_first_part_only(spark):
    x, _ = W.hmm_features(500, np.inf, W.rng_of(2))
    days = pd.date_range("2000-01-01", periods=500)
    f = lambda y: spark.createDataFrame(pd.DataFrame({"u": "m", "date": days, "r": y[:, 0], "logvol": y[:, 1]}))
    y = x.copy()
    y[420:] *= 3
    a, b = (models.jump_penalties(f(z), (4.0, 16.0), 300, 50).orderBy("penalty").collect() for z in (x, y))
    assert a == b and sum(q["chosen"] for q in a) == 1


@pytest.mark.parametrize("missing", ["tokenizers", "quantloom.llm"])
def test_engine_stays_registered_without_the_subpackage(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 150 and 'core_book' in q and 'pipeline' not in q"
    got = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-500:]


#: Queries without SQL (the others are compared at sf0.01) on data too short for most windows.
QUICK = (
    "core_book", "signal_sleeves", "hrp_weights", "black_litterman", "min_cvar", "kalman_pairs", "pairs_sleeve", "statarb_sleeve", "trading_system", "frozen_system",
    "asset_vol_forecasts", "deflated_sharpe", "spectral_ratio", "variance_ratio", "combined_signal", "crash_labels",
)


@pytest.mark.parametrize("name", QUICK)
def test_queries_run_on_the_smallest_data(spark, name):
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
