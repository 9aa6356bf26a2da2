"""Registered queries without SQL text: models, linear algebra, resampling, worlds, books, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import panels as P
from ..operators import events as E
from ..operators import inference as I
from ..operators import laws as L
from ..operators import models as X
from ..operators import pairs as Q
from ..operators import resample as B
from ..operators import volatility as V
from ..staging import shared_folder, staged
from ..streaming import live
from . import book
from .t1 import _gk, _gr, _mkt, _rets, rnd

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _feats(s, d):
    return X.features(_mkt(s, d))


@query
def hmm_regimes(s, d):
    """Walk-forward Gaussian regimes of the market."""
    return X.regimes(_feats(s, d), "gaussian")


@query
def thmm_regimes(s, d):
    """Walk-forward Student-t regimes of the market."""
    return X.regimes(_feats(s, d), "student")


@query
def dhmm_regimes(s, d):
    """Walk-forward duration regimes of the market."""
    return X.regimes(_feats(s, d), "duration")


@query
def jump_regimes(s, d):
    """Walk-forward jump-model states of the market."""
    return X.jump_regimes(_feats(s, d))


@query
def regime_horserace(s, d):
    """Mean predictive log score of the engines."""
    return X.horserace(_feats(s, d), every=21)


def _variances(s, d):
    return X.variance_forecasts(_gr(s, d), every=21)


@query
def variance_forecasts(s, d):
    """EWMA, HAR, GARCH and rough forecasts of each asset's variance."""
    return _variances(s, d)


def _qlikes(s, d):
    v = _variances(s, d).where("har is not null")
    return v.select("asset", "date", *[V.qlike("rv", m).alias(m) for m in ("ewma", "har", "garch", "rough")])


@query
def vol_model_confidence_set(s, d):
    """Confidence set of the variance models by QLIKE."""
    return B.confidence_set(_qlikes(s, d), ["ewma", "har", "garch", "rough"])


@query
def ewma_riskmetrics(s, d):
    """Recursive variance per asset."""
    return rnd(X.ewma_variance(_rets(s, d)), 10)


@query
def ewm_vol(s, d):
    """Exponentially weighted mean and deviation per asset."""
    return rnd(X.ewm_moments(_rets(s, d)).withColumn("ewm_std", F.nanvl("ewm_std", F.lit(None).cast("double"))), 8)


@query
def exposure_full(s, d):
    """Lever, brakes and smoothed exposure of the market book."""
    from ..operators.risk import exposure_brakes

    return rnd(X.exposure(exposure_brakes(_mkt(s, d))))


@query
def hawkes_branching(s, d):
    """Branching ratios of raw and volatility-scaled exceedances."""
    x = L.standardized(_gk(s, d)).where("r is not null and z is not null")
    n = x.groupBy("asset").agg(F.count(F.lit(1)).cast("double").alias("horizon"))
    ev = E.exceedances(x, "r").withColumn("kind", F.lit("raw")).unionByName(E.exceedances(x, "z").withColumn("kind", F.lit("deformed")))
    return X.hawkes_fits(ev.join(F.broadcast(n), "asset"), ["asset", "kind"])


@query
def hawkes_recovery(s, d):
    """Fitted against true branching ratios."""
    return X.hawkes_recovery(s)


@query
def student_t_tails(s, d):
    """Student-t fit of raw and scaled returns."""
    x = L.standardized(_gk(s, d))
    return X.t_tails(x, "r").withColumn("kind", F.lit("raw")).unionByName(X.t_tails(x, "z").withColumn("kind", F.lit("deformed")))


def _windows(s, d):
    return X.rebalance_windows(_rets(s, d), 252)


@query
def hrp_weights(s, d):
    """Hierarchical risk parity at each rebalance."""
    return X.portfolio_weights(_windows(s, d), "hrp")


@query
def black_litterman(s, d):
    """Capped weights from views on recent returns."""
    return X.portfolio_weights(_windows(s, d), "bl")


@query
def rmt_denoise(s, d):
    """Minimum variance on the denoised covariance."""
    return X.portfolio_weights(_windows(s, d), "rmt")


@query
def min_cvar(s, d):
    """Weights of least CVaR."""
    return X.portfolio_weights(_windows(s, d), "cvar")


@query
def eigen_spectrum(s, d):
    """Eigenvalues against the noise edge, brands as assets."""
    p = P.returns(P.bars_brand(s, d).select("asset", "date", "close"))
    return X.spectrum(X.rebalance_windows(p, 504, 504))


@query
def minvar_bakeoff(s, d):
    """Realised volatility by covariance estimator."""
    return X.estimator_bakeoff(_rets(s, d), 252)


@query
def ou_sscores(s, d):
    """Residual mean-reversion scores."""
    return X.ou_signals(_windows(s, d))


def _kalman(s, d):
    cand = [(r["a"], r["b"]) for r in Q.top_pairs(_rets(s, d), 120).collect()]  # at most 120 rows
    return X.kalman_pairs(P.panel_flag(s, d), Q.greedy_disjoint(cand, 8))


@query
def kalman_pairs(s, d):
    """Filtered spreads, positions and actions of the selected pairs."""
    return _kalman(s, d)


@query
def pairs_sleeve(s, d):
    """Returns of the pairs book."""
    return book.pairs_sleeve(P.panel_flag(s, d), _kalman(s, d))


@query
def statarb_sleeve(s, d):
    """Returns of the residual-reversion book."""
    return book.statarb_sleeve(X.ou_signals(_windows(s, d)), _rets(s, d))


_CFG = book.BookConfig()


def _book_regs(s, d):
    """u, date, regime: walk-forward Gaussian regimes of the market; the middle one before the first fit, as in the reference."""
    m, got = _mkt(s, d), X.regimes(_feats(s, d), "gaussian").select("date", "regime")
    known = F.when(F.col("regime") >= 0, F.col("regime")).otherwise(F.lit(1))
    return staged(m.join(got, "date", "left").select("u", "date", known.alias("regime")))


@query
def core_book(s, d):
    """Net returns of the walk-forward book with overlay, costs and financing."""
    return book.run_book(_rets(s, d), _book_regs(s, d), _CFG)["net"]


@query
def signal_sleeves(s, d):
    """Returns of the single-signal books."""
    return book.sleeves(_rets(s, d), _book_regs(s, d), _CFG)


@query
def hedge_ensemble(s, d):
    """Multiplicative weights over the assets as experts."""
    w = X.hedge_weights(_rets(s, d).select(F.lit("all").alias("u"), "date", F.col("asset").alias("expert"), "r"))
    return w.select("u", "date", F.round(F.array_max("weights"), 7).alias("top"), F.round("r", 9).alias("r"))


@query
def bootstrap_sharpe_ci(s, d):
    """Percentile interval of the market's Sharpe ratio."""
    return B.interval(B.sharpe_draws(_mkt(s, d)), "sharpe")


@query
def equity_fan(s, d):
    """Percentiles of resampled value paths."""
    return B.equity_fan(_mkt(s, d))


def _coded(s, d):
    f = E.causal_features(_rets(s, d))
    return f.withColumn("full", F.concat_ws("_", "sg", "mom", "volt")).withColumn("part", F.concat_ws("_", "sg", "volt"))


@query
def permutation_mi(s, d):
    """Mutual information against its permutation null."""
    return B.permutation_mi(_coded(s, d), "full", "next")


@query
def direction_bits(s, d):
    """Bits about the next sign, tested."""
    return X.direction_bits(_coded(s, d), "full", "next")


@query
def harvest_gap(s, d):
    """Bits beyond the harvested features."""
    return B.harvest_gap(_coded(s, d), "full", "part", "next", draws=300)


@query
def knn_information(s, d):
    """Nearest-neighbour information of volatility about the size of the next return."""
    x = _rets(s, d).withColumn("vol", F.sqrt(F.avg(F.col("r") * F.col("r")).over(Window.partitionBy("asset").orderBy("date").rowsBetween(-20, 0)))).withColumn("nx", F.abs(F.lead("r").over(Window.partitionBy("asset").orderBy("date"))))
    return X.knn_information(x, "vol", "nx")


@query
def entropy_production_null(s, d):
    """Irreversibility of returns against reversed blocks."""
    return X.entropy_test(_rets(s, d), "r")


@query
def incremental_auc(s, d):
    """Gain of early-warning features over volatility in crash prediction."""
    r = _rets(s, d)
    lab = E.crash_labels(r).select("asset", "date", "label")
    ind = E.ews_indicators(r.withColumn("state", F.log("close")))
    v = r.withColumn("vol", F.stddev_samp("r").over(Window.partitionBy("asset").orderBy("date").rowsBetween(-59, 0))).select("asset", "date", "vol")
    return X.incremental_auc(ind.join(lab, ["asset", "date"]).join(v, ["asset", "date"]), ["vol"], ["ac1", "phi"])


@query
def gaussian_tail_null(s, d):
    """Tail dependence of Gaussian pairs by correlation."""
    return B.gaussian_tail_null(s)


def _eras(s, d):
    r = _rets(s, d).withColumn("era", F.ntile(5).over(Window.partitionBy("asset").orderBy("date")))
    return r.groupBy("asset", "era").agg(F.avg("r").alias("mean"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("sd"), F.avg("era").alias("centre"))


@query
def variance_ratio(s, d):
    """Constancy of mean returns over eras, with its class."""
    v = B.variance_ratio(_eras(s, d), "asset")
    return v.withColumn("label", I.classify(F.col("vr_p"), F.col("trend_p")))


@query
def agent_battery(s, d):
    """Stylised-fact scores of agent markets by majority of seeds."""
    return X.majority_scores(X.agent_batteries(s))


@query
def subwindow_hurst(s, d):
    """Roughness in overlapping windows."""
    return rnd(L.subwindow_hurst(_gk(s, d)))


@query
def ewma_stream(s, d):
    """Recursive variance as a stream over the returns, run to the end of its input."""
    folder = f"{shared_folder(s)}/quantloom-stream-{uuid.uuid4().hex}"
    _rets(s, d).select("asset", "date", "r").write.parquet(f"{folder}/in")
    # all files in one micro-batch: rows of an asset lie in many of them, and a batch puts them in order
    x = live.read_bars(s, f"{folder}/in", "asset string, date timestamp, r double", 1_000_000)
    return rnd(live.run_to_end(live.ewma_stream(x), folder), 10)
