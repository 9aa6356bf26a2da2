"""Registered queries: the trading system, intervals and nulls, comparisons of regime models, the live ledger and its streams, sources and worlds."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import panels as P
from ..functions.exprs import ordered
from ..kernels import hmm as H
from ..kernels import information as N
from ..kernels import portfolio as O
from ..kernels import worlds as W
from ..operators import events as E
from ..operators import inference as I
from ..operators import laws as L
from ..operators import ledger as G
from ..operators import metrics as M
from ..operators import models as X
from ..operators import pairs as Q
from ..operators import relational as J
from ..operators import resample as B
from ..operators import volatility as V
from ..sources import files
from ..staging import shared_folder, staged
from ..streaming import live
from . import book, system, t3
from .t1 import _gk, _gr, _mkt, _rets, rnd

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- the trading system


def _system(s, d, cfg=system.SystemConfig()):
    return system.run_system(_rets(s, d), _gk(s, d), t3._book_regs(s, d), cfg)


@query
def trading_system(s, d):
    """Net returns of the system, sized by forecast volatility."""
    return _system(s, d)["net"].select("date", F.col("r").alias("gross"), "vol", "exposure", "applied", "cost", "net")


@query
def trading_system_control(s, d):
    """Statistics of the system by forecast volatility, by realised volatility, and of equal weights."""
    rows, held, vols = None, system.hold(_rets(s, d), t3._book_regs(s, d)), staged(system.asset_vol(_gk(s, d)))
    for name, forecast in (("forecast", True), ("realised", False)):
        one = system.size(held, vols, system.SystemConfig(forecast=forecast))["net"].select("date", F.col("net").alias("r"), F.lit(name).alias("asset"))
        rows = one if rows is None else rows.unionByName(one)
    equal = held["rets"].groupBy("date").agg(F.avg(F.exp("r") - 1).alias("r")).withColumn("asset", F.lit("equal"))
    return M.summary(rows.unionByName(equal))


@query
def trading_allocation(s, d):
    """Today's whole-dollar allocation of the system, and cash."""
    return system.allocation(_system(s, d))


@query
def asset_vol_forecasts(s, d):
    """Annual volatility of each asset, foretold and realised."""
    return system.asset_vol(_gk(s, d))


@query
def frozen_system(s, d):
    """The core book with unchanged settings on another universe (nations, weekly), beside its market and equal weights."""
    r = staged(P.returns(P.bars_nation(s, d).select("asset", "date", "close")))
    m = staged(P.market(r).withColumn("u", F.lit("all")))
    got = X.regimes(X.features(m), "student").select("date", "regime")
    regs = staged(m.join(got, "date", "left").select("u", "date", F.when(F.col("regime") >= 0, F.col("regime")).otherwise(F.lit(1)).alias("regime")))
    net = book.run_book(r, regs)["net"].select("date", F.col("net").alias("r"), F.lit("frozen").alias("asset"))
    equal = r.groupBy("date").agg(F.avg(F.exp("r") - 1).alias("r")).select("date", "r", F.lit("equal").alias("asset"))
    return M.summary(net.unionByName(equal).unionByName(m.select("date", F.col("r"), F.lit("index").alias("asset"))))


def _signals(s, d) -> DataFrame:
    from ..operators.signals import combined

    return combined(_rets(s, d), t3._book_regs(s, d))


@query
def top_weights(s, d):
    """The assets of the largest mean weights in the book."""
    t = book.target_weights(_rets(s, d), _signals(s, d), "combined")
    return t.groupBy("asset").agg(F.avg("w").alias("mean_weight")).orderBy(F.desc("mean_weight"), "asset").limit(25)


# ---- intervals and nulls


@query
def hurst_interval(s, d):
    """Roughness with its block-bootstrap interval."""
    return B.hurst_interval(_gk(s, d))


@query
def zumbach_interval(s, d):
    """The arrow of volatility with its interval."""
    return B.zumbach_interval(_gr(s, d))


def _auc_scores(s, d) -> DataFrame:
    r = _rets(s, d)
    lab = E.crash_labels(r).select("asset", "date", "label")
    ind = E.ews_indicators(r.withColumn("state", F.log("close")))
    v = r.withColumn("vol", F.stddev_samp("r").over(ordered().rowsBetween(-59, 0))).select("asset", "date", "vol")
    return X.incremental_scores(ind.join(lab, ["asset", "date"]).join(v, ["asset", "date"]), ["vol"], ["ac1", "phi"])


@query
def auc_gain_interval(s, d):
    """Gain of early warnings in crash prediction with its interval."""
    return B.auc_gain_interval(_auc_scores(s, d))


@query
def cluster_gain_interval(s, d):
    """Mean gain over assets with an interval from drawing assets anew."""
    return B.cluster_interval(t3.QUERIES["incremental_auc"](s, d).withColumn("class", F.lit("flag")), "gain", ["class"])


@query
def tracking_null_band(s, d):
    """Critical values of the live tracking statistic where the forecasts are right."""
    return B.tracking_null(s)


@query
def deflated_sharpe(s, d):
    """Sharpe ratios of the assets against the best of as many worthless trials as there are blends."""
    return B.deflated(_rets(s, d), 60, 0.02)


@query
def gaussian_asymmetry_null(s, d):
    """Tail asymmetry of Gaussian pairs by correlation, and the pairs' own looked up in it."""
    null = B.gaussian_asymmetry_null(s).withColumn("bin", F.round(F.col("rho") / 0.05).cast("int"))
    r = _rets(s, d)
    x = Q.exceedance_asymmetry(r).join(Q.spearman_pairs(r), ["a", "b"]).withColumn("bin", F.round(F.abs("gauss_rho") / 0.05).cast("int"))
    return x.join(F.broadcast(null), "bin").select("a", "b", "asymmetry", "mean", "p95", (F.col("asymmetry") > F.col("p95")).cast("int").alias("above"))


@query
def sampled_pairs(s, d):
    """A random sample of pairs without replacement, the same on every run."""
    return Q.pair_correlation(_rets(s, d)).orderBy(F.xxhash64("a", "b", F.lit(42)), "a", "b").limit(10)


# ---- regime models compared


def _feats(s, d):
    return X.features(_mkt(s, d))


@query
def regime_model_scores(s, d):
    """Mean log scores of ten regime models, and whether each is in the confidence set."""
    scores = staged(X.model_scores(_feats(s, d)))
    return X.scores_confidence_set(scores)


@query
def regime_model_tests(s, d):
    """Tests of pairs of regime models by their log scores."""
    scores, out = staged(X.model_scores(_feats(s, d))), None
    wide = scores.groupBy("u", "date").pivot("model", list(X.REGIME_MODELS)).agg(F.max("logscore"))
    for a, b in (("T3", "G3"), ("T3", "G5"), ("G5", "G3"), ("T3", "SJM3"), ("T5", "T3"), ("T3", "Dur3x3")):
        one = I.hac_test(wide, a, b, by="u").withColumn("pair", F.lit(f"{a}/{b}"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def jump_penalty(s, d):
    """Predictive score of the jump model by penalty on the first half of the predictions; the best is marked."""
    return X.jump_penalties(_feats(s, d))


@query
def regime_features_range(s, d):
    """Returns and log volatility from ranges, the alternative features."""
    return X.features_range(_mkt(s, d), _gk(s, d)).withColumn("logvol", F.round("logvol", 8))


@query
def regime_durations(s, d):
    """Distribution of the time in each regime under the duration model fitted to the whole market series."""
    fn = lambda p: _durations(p)
    return X.per_series(_feats(s, d), ["u"], fn, "regime int, days int, p double")


def _durations(p: pd.DataFrame) -> pd.DataFrame:
    m = H.HMM(sub=3).fit(p[["r", "logvol"]].to_numpy(float))
    return pd.concat([pd.DataFrame({"regime": k, "days": range(1, 251), "p": m.duration_pmf(k)}) for k in range(m.k)])


@query
def regime_smoothed(s, d):
    """Smoothed probabilities of the Gaussian model, which know the whole sample, beside the filtered."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x = p[["r", "logvol"]].to_numpy(float)
        m = H.HMM().fit(x)
        return pd.DataFrame({"date": p["date"], "smoothed": m.smoothed(x).tolist(), "filtered": m.filtered(x).tolist()})

    return X.per_series(_feats(s, d), ["u"], fn, "date timestamp, smoothed array<double>, filtered array<double>")


# ---- laws and information


@query
def market_clock(s, d):
    """Kurtosis raw, by the market's volatility, by the asset's own."""
    return rnd(L.market_clock_deformation(_gk(s, d)), 5)


@query
def detoned_spectrum(s, d):
    """Largest and smallest eigenvalues of the correlation of brands before and after the market mode is taken out."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        c = np.corrcoef(X._matrix(p).to_numpy().T)
        a, b = np.linalg.eigvalsh(c), np.linalg.eigvalsh(O.detone(c))
        return pd.DataFrame({"kind": ["raw", "detoned"], "largest": [a[-1], b[-1]], "smallest": [a[0], b[0]]})

    r = P.returns(P.bars_brand(s, d).select("asset", "date", "close"))
    return X.per_series(X.rebalance_windows(r, 504, 504), ["at"], fn, "kind string, largest double, smallest double")


@query
def spectral_ratio(s, d):
    """Low over high frequency power of log volatility in windows of 60 rows."""
    return X.spectral_ratios(_gk(s, d))


@query
def sharpe_ceilings(s, d):
    """Sharpe ratios that the direction bits allow in a Gaussian and in a binary channel, and the bits that the asset's own ratio uses."""
    bits = X.direction_bits(t3._coded(s, d), "full", "next", 200)
    own = M.summary(_rets(s, d).select("asset", "date", (F.exp("r") - 1).alias("r"))).select("asset", "sharpe")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bits": p["bits"], "sharpe": p["sharpe"], "binary": [N.binary_ceiling(min(max(b, 0.0), 0.999)) if b > 1e-12 else 0.0 for b in p["bits"]]})

    x = X.per_series(bits.join(own, "asset"), ["asset"], fn, "bits double, sharpe double, binary double", order="asset")
    return x.withColumn("gaussian", E.sharpe_ceiling(F.greatest("bits", F.lit(0.0)) * F.log(F.lit(2.0)))).withColumn("used", E.bits_consumed(F.col("sharpe")))


@query
def harvest_drop_one(s, d):
    """Bits beyond the harvested features when each other feature is left out."""
    x, out = staged(t3._coded(s, d)), None
    for gone, rest in (("sg", ("mom", "volt")), ("mom", ("sg", "volt"))):
        code = x.withColumn("full", F.concat_ws("_", *rest)).withColumn("part", F.col("volt").cast("string"))
        one = B.harvest_gap(code, "full", "part", "next", draws=80).withColumn("without", F.lit(gone))
        out = one if out is None else out.unionByName(one)
    return out


# ---- worlds


@query
def world_series(s, d):
    """Every generator's series, one group per world: what recovery tests draw from."""
    make = {
        "regimes": lambda g: W.regime_market(1500, 1, g)[:, 0], "garch": lambda g: W.gjr_returns(1500, g)[0], "fgn": lambda g: W.fgn(1500, 0.1, g),
        "rough": lambda g: W.rough_variance(1500, g)[0], "volatility": lambda g: W.sv_world(1500, g)[0], "clock": lambda g: W.clock_world(1500, 4, g)[0][:, 0],
        "reversible": lambda g: W.reversible_world(1500, g)[0], "volofvol": lambda g: W.volofvol_world(1500, 4, g)[0][:, 0], "fold": lambda g: W.fold_world(1500, g)[0],
        "shock": lambda g: W.shock_world(1500, g)[0], "harvest": lambda g: W.harvest_world(1500, True, g)["sign"].astype(float), "bars": lambda g: W.gbm_ohlc(1500, 0.2, g)[:, 3],
    }

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        k, name = int(p["cell"].iloc[0]), p["world"].iloc[0]
        x = make[name](W.rng_of(5, k))
        return pd.DataFrame({"world": name, "t": range(len(x)), "value": np.asarray(x, float)})

    return X.grid(s, list(enumerate(make)), "cell int, world string", fn, "world string, t int, value double")


@query
def planted_crash_labels(s, d):
    """Labels of a world whose jumps are known, and whether the indicators rise before them."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        x, jump = (W.fold_world if p["world"].iloc[0] == "fold" else W.shock_world)(6000, W.rng_of(6, int(p["cell"].iloc[0])))
        days = pd.date_range("2000-01-01", periods=len(x))
        return pd.DataFrame({"asset": p["world"].iloc[0], "date": days, "state": x, "r": np.diff(x, prepend=x[0]), "jump": jump})

    x = X.grid(s, [(0, "fold"), (1, "shock")], "cell int, world string", fn, "asset string, date timestamp, state double, r double, jump int")
    lab = E.jumps_to_labels(staged(x)).select("asset", "date", "label")
    return E.auc(E.ews_indicators(x).join(lab, ["asset", "date"]), "phi", "label")


# ---- ledger, streams, sources and sinks


def _folder(s, name: str) -> str:
    """A folder of this run's own, where driver and executors see it."""
    return f"{shared_folder(s)}/quantloom-{name}-{uuid.uuid4().hex}"


def _bars(s, d) -> DataFrame:
    return P.bars_flag(s, d).select("asset", F.to_date("date").alias("date"), "open", "high", "low", "close")


@query
def genesis_round_trip(s, d):
    """Snapshot, later bars and events written and read back: the panel as the ledger reconstructs it."""
    at, b = _folder(s, "genesis"), _bars(s, d)
    files.write_genesis(b.where("date < '1997-01-01'"), f"{at}/g")
    files.append_bars(b.where("date >= '1997-01-01'"), f"{at}/b")
    ev = s.sql("select date'1996-01-01' as date, 'REANCHOR' as status, map('AF', 0.5D) as factors")
    files.append_ledger(ev, f"{at}/l")
    return files.reconstruct(s, f"{at}/g", f"{at}/b", f"{at}/l").select("asset", F.col("date").cast("timestamp").alias("date"), F.round("close", 4).alias("close"))


@query
def wide_csv_round_trip(s, d):
    """Closes as a wide file of dates by assets, read back as long rows."""
    at = _folder(s, "wide")
    b = _bars(s, d)
    assets = sorted(r[0] for r in b.select("asset").distinct().collect())  # the columns of the file
    b.groupBy("date").pivot("asset", assets).agg(F.max("close")).write.option("header", True).csv(at)
    return files.wide_csv(s, at).select("asset", F.col("date").cast("timestamp").alias("date"), "close")


@query
def ledger_stream(s, d):
    """The live ledger written by a stream over the bars, a row per day, read back."""
    at, b = _folder(s, "ledger"), _bars(s, d).where("date >= '1998-06-01'")
    b.withColumn("date", F.col("date").cast("timestamp")).write.parquet(f"{at}/in")
    x = live.read_bars(s, f"{at}/in", "asset string, date timestamp, open double, high double, low double, close double", 1000)
    equal = lambda bars: bars.select("date", "asset", (1 / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("w"))
    live.ledger_stream(x, f"{at}/out", f"{at}/ck", equal, 6).awaitTermination()
    return files.read_ledger(s, f"{at}/out").select(F.col("date").cast("timestamp").alias("date"), "status", F.coalesce(F.size("weights"), F.lit(-1)).alias("assets"))


@query
def tumbling_bars_stream(s, d):
    """Weekly bars of the event types from a stream of ticks."""
    at = _folder(s, "bars")
    ev = P.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ev.write.parquet(f"{at}/in")
    x = live.read_bars(s, f"{at}/in", ev.schema.simpleString()[7:-1].replace(":", " "), 1000)
    return live.run_to_end(live.tumbling_bars(x), at)


@query
def idempotent_stream(s, d):
    """Bars that were sent twice, once each after the stream."""
    at, b = _folder(s, "twice"), _bars(s, d).withColumn("date", F.col("date").cast("timestamp")).select("asset", "date", "close")
    b.unionByName(b).write.parquet(f"{at}/in")
    return live.run_to_end(live.idempotent(live.read_bars(s, f"{at}/in", "asset string, date timestamp, close double", 1000)), at)


@query
def ledger_emit(s, d):
    """Ledger rows of every calendar day: weights where enough assets have a bar, else the reason."""
    b = _bars(s, d).withColumn("date", F.col("date").cast("timestamp"))
    days = b.agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("date"))
    equal = lambda x: x.select("date", "asset", (1 / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("w"))
    x = live.emit_rows(b, equal, days, 4)
    return x.select(F.col("date").cast("timestamp").alias("date"), "status", F.coalesce(F.size("weights"), F.lit(-1)).alias("assets"))


@query
def bounded_asof(s, d):
    """Prices with the last published regime, carried for five rows at most."""
    pub = P.regimes_by_vol(_mkt(s, d)).where(F.dayofmonth("date") == 1).select(F.lit("all").alias("u"), "date", "regime")
    days = _rets(s, d).select(F.lit("all").alias("u"), "date").distinct()
    return J.asof_join(days, pub, ("u",), "regime", limit=5).select("date", F.coalesce("regime", F.lit(-1)).alias("regime"))


@query
def panel_digest(s, d):
    """Digest, span and number of assets of the snapshot."""
    b = _bars(s, d)
    return G.digest(b.withColumn("date", F.col("date").cast("timestamp"))).agg(F.count(F.lit(1)).alias("assets"), F.min("digest").alias("first"))


@query
def range_variance_check(s, d):
    """Mean forecast volatility over mean realised volatility per asset: the scale of the forecasts."""
    v = V.realized_vol(_gk(s, d)).select("asset", "date", "realized_vol")
    f = system.asset_vol(_gk(s, d)).where("forecast is not null and not isnan(forecast)").select("asset", "date", "forecast")
    return f.join(v, ["asset", "date"]).groupBy("asset").agg((F.avg("forecast") / F.avg("realized_vol")).alias("scale"), F.count(F.lit(1)).alias("n"))
