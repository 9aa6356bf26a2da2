"""The studies: each a function of (spark, sf_dir) that composes operators into one result table.

Studies that need another study's result call its function; there is no hidden cache and
no dependence on the order in which they run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import panels as P
from ..functions.exprs import kurt_g2, ordered
from ..kernels import hmm as H
from ..kernels import worlds as W
from ..kernels.numeric import sign_test_p, signed_rank_p
from ..operators import events as E
from ..operators import inference as I
from ..operators import laws as L
from ..operators import metrics as M
from ..operators import models as X
from ..operators import pairs as Q
from ..operators import resample as B
from ..operators import volatility as V
from ..operators.expanding import expanding_quantiles
from ..staging import staged
from . import book, t1b, t3, t5  # noqa: F401
from .t1 import QUERIES as QUERIES_SQL
from .t1 import _gk, _mkt, _rets, rnd

STUDIES: dict = {}
CFG = book.BookConfig()


def study(f):
    STUDIES[f.__name__] = f
    return f


def long(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Columns as rows: key (joined), stat, value."""
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    return df.select(key.alias("key"), F.explode(F.array(*[F.struct(F.lit(v).alias("stat"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select("key", "x.*")


# ---- operators that only studies use


def clock_commonality(gk: DataFrame, smooth: int = 10) -> DataFrame:
    """Shares of the two largest eigenvalues of the correlation of smoothed log volatility (assets are few: one group)."""
    w = ordered().rowsBetween(-(smooth - 1), 0)
    x = gk.where("gk_var is not null").withColumn("r", F.avg(0.5 * F.log("gk_var")).over(w)).select(F.lit("all").alias("u"), "date", "asset", "r")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index="date", columns="asset", values="r").dropna().to_numpy()
        e = np.linalg.eigvalsh(np.corrcoef(m.T))[::-1] / m.shape[1]
        return pd.DataFrame({"first": [e[0]], "second": [e[1] if len(e) > 1 else np.nan]})

    return X.per_series(x, ["u"], fn, "first double, second double")


def surge_lift(rets: DataFrame, gk: DataFrame, horizon: int = 21, halflife: float = 8.0) -> DataFrame:
    """Later frequency of joint tail days when the market's clock runs agitated, against calm, by expanding terciles."""
    jt = L.joint_tail_days(rets)
    mk = gk.groupBy("date").agg(F.avg(F.log("gk_var")).alias("l")).withColumn("asset", F.lit("market"))
    d = mk.withColumn("d", F.abs(F.col("l") - F.lag("l").over(ordered()))).where("d is not null")
    meta = X.ewm_moments(d, halflife, "d").select("date", F.col("ewm_mean").alias("meta"))
    x = jt.join(meta, "date").withColumn("asset", F.lit("market"))
    x = expanding_quantiles(x, "meta", {"lo": 1 / 3, "hi": 2 / 3})
    x = x.withColumn("later", F.avg("joint").over(ordered().rowsBetween(1, horizon)))
    return x.agg(F.avg(F.when(F.col("meta") >= F.col("hi"), F.col("later"))).alias("agitated"), F.avg(F.when(F.col("meta") <= F.col("lo"), F.col("later"))).alias("calm")).withColumn("lift", F.try_divide("agitated", "calm"))


def law_battery(bars: DataFrame, eras: int = 5) -> DataFrame:
    """Seven laws per asset and era: kurtosis raw and deformed, leverage, roughness, autocorrelation, s2, range share."""
    x = L.standardized(bars).withColumn("era", F.ntile(eras).over(ordered()))
    key = F.concat_ws("#", "asset", F.col("era").cast("string"))
    y = x.withColumn("asset", key)
    parts = [
        y.groupBy("asset").agg(kurt_g2("r").alias("kurt_raw"), kurt_g2("z").alias("kurt_deformed"), F.avg((F.col("high") > F.col("low")).cast("double")).alias("range_share")),
        L.leverage_effect(y), L.hurst(y), L.logvol_signal_variance(y), E.autocorr(y.withColumn("a", F.abs("r")).where("a is not null"), "a", 1),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "asset")
    return out.select(F.substring_index("asset", "#", 1).alias("asset"), F.substring_index("asset", "#", -1).cast("int").alias("era"), *[c for c in out.columns if c != "asset"])


def law_estimates(battery: DataFrame, by: str) -> DataFrame:
    """law, group, mean and sampling deviation across assets."""
    laws = ("kurt_raw", "kurt_deformed", "leverage", "hurst", "s2", "acf", "range_share")
    x = long(battery, [by], *laws)
    return x.groupBy(F.col("stat").alias("law"), F.col("key").alias("group")).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sd"))


def variant_family(sleeves: DataFrame, targets=(0.08, 0.10, 0.13, 0.16), steps: int = 4) -> DataFrame:
    """t, variant, r: blends of the sleeves on a simplex grid, scaled to volatility targets by the trailing deviation of the day before."""
    names = ("momentum", "mean_reversion", "low_vol")
    mix = [(f"{a}-{b}-{steps - a - b}", n, w / steps) for a in range(steps + 1) for b in range(steps + 1 - a) for n, w in zip(names, (a, b, steps - a - b), strict=True)]
    dim = sleeves.sparkSession.createDataFrame(mix, "blend string, expert string, share double")
    tg = sleeves.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    x = sleeves.join(F.broadcast(dim), "expert").groupBy("blend", "date").agg(F.sum(F.col("share") * F.col("r")).alias("r"))
    w = Window.partitionBy("blend").orderBy("date")
    x = x.withColumn("vol", F.stddev_samp("r").over(w.rowsBetween(-63, -1)) * 252**0.5).withColumn("t", F.row_number().over(w) - 1)
    y = x.crossJoin(F.broadcast(tg)).withColumn("r", F.col("r") * F.coalesce(F.least(F.col("target") / F.when(F.col("vol") > 0, F.col("vol")), F.lit(2.0)), F.lit(1.0)))
    return y.select("t", F.concat_ws("@", "blend", F.col("target").cast("string")).alias("variant"), "r")


def khallucination(spark, seeds: int = 8, rows: int = 3000, ks=(2, 3, 4, 5)) -> DataFrame:
    """Held-out log score by number of states, in Gaussian and fat-tailed worlds, by family; a cell is one group."""
    cells = [(i, *c) for i, c in enumerate((w, s, f, k) for w in ("gauss", "t5") for s in range(seeds) for f in ("gaussian", "student") for k in ks)]

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        c = p.iloc[0]
        x, _ = W.hmm_features(rows, np.inf if c["world"] == "gauss" else 5.0, W.rng_of(int(c["seed"])))
        m = H.HMM(k=int(c["k"]), student=c["family"] == "student", iters=120).fit(x[: rows * 2 // 3], restarts=2)
        sub = m.sub_filtered(x)
        s = m.predictive_logpdf(m.next_weights(sub[rows * 2 // 3 - 1 : -1]), x[rows * 2 // 3 :, 0])
        return pd.DataFrame({"world": [c["world"]], "family": [c["family"]], "k": [int(c["k"])], "score": [float(s.mean())]})

    got = X.grid(spark, cells, "cell int, world string, seed int, family string, k int", fn, "world string, family string, k int, score double")
    return got.groupBy("world", "family", "k").agg(F.avg("score").alias("score"))


def contrasts(estimates: DataFrame, ref: str) -> DataFrame:
    """z and label of each group's law against the reference group."""
    a = estimates.where(F.col("group") == ref).select("law", F.col("mean").alias("m0"), F.col("sd").alias("s0"))
    x = estimates.where(F.col("group") != ref).join(F.broadcast(a), "law")
    z = F.try_divide(F.col("mean") - F.col("m0"), F.sqrt(F.col("sd") ** 2 + F.col("s0") ** 2))
    return x.select("law", "group", z.alias("z"), I.contrast(F.col("mean"), F.col("sd"), F.col("m0"), F.col("s0")).alias("label"))


def _pct(x: DataFrame, value: str, by: list[str]) -> DataFrame:
    return x.groupBy(*by).agg(*[F.percentile(value, F.lit(q)).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])


def _by_asset(s, d, names: tuple[str, ...]) -> DataFrame:
    out = QUERIES_SQL[names[0]](s, d)
    for n in names[1:]:
        out = out.join(QUERIES_SQL[n](s, d), "asset")
    return out


# ---- the studies


@study
def horserace(s, d):
    """Engines by predictive score."""
    score = t3.QUERIES["regime_horserace"](s, d)
    m, out = _mkt(s, d), None
    worst = m.withColumn("dd", F.sum("r").over(Window.partitionBy("u").orderBy("date").rowsBetween(1, 21))).orderBy("dd", "date").limit(5).select(F.col("date").alias("start"))
    worst = staged(worst)
    for engine in ("gaussian", "duration", "jump"):
        x = t3._feats(s, d)
        r = staged((X.jump_regimes(x) if engine == "jump" else X.regimes(x, engine)).where("regime >= 0").select("u", "date", "regime"))
        late = I.crash_latency(r, worst.join(r.select(F.col("date").alias("start")), "start")).agg(F.avg("latency").alias("latency"))
        # what the regimes are worth: the market held in full but in the stressed one, known the day before
        held = F.when(F.lag("regime").over(Window.partitionBy("u").orderBy("date")) == 2, 0.0).otherwise(1.0)
        worth = M.summary(r.join(m, ["u", "date"]).withColumn("h", held).select("date", (F.col("h") * F.col("r")).alias("r"), F.lit(engine).alias("asset"))).select("sharpe")
        one = I.persistence(r).drop("u").crossJoin(late).crossJoin(worth).withColumn("engine", F.lit(engine))
        out = one if out is None else out.unionByName(one)
    return score.join(out, "engine", "left")


@study
def vollab(s, d):
    """Variance models by QLIKE and its test against the first."""
    q = t3._qlikes(s, d)
    out = None
    for m in ("har", "garch", "rough"):
        one = I.hac_test(q, m, "ewma").withColumn("model", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@study
def rough(s, d):
    """Roughness: whole sample and sub-windows, quartiles."""
    return rnd(_pct(L.subwindow_hurst(_gk(s, d)), "hurst", ["asset"]).join(L.hurst(_gk(s, d)), "asset"))


@study
def rmt(s, d):
    """Covariance estimators by realised volatility."""
    return t3.QUERIES["minvar_bakeoff"](s, d)


@study
def statarb(s, d):
    """Statistics of the residual sleeve."""
    return M.summary(t3.QUERIES["statarb_sleeve"](s, d).withColumn("asset", F.lit("statarb")))


@study
def cvar(s, d):
    """Books of HRP and least-CVaR weights."""
    r, out = _rets(s, d), None
    win = X.rebalance_windows(r, 252)
    for m in ("hrp", "cvar"):
        t = book.traded(X.portfolio_weights(win, m), r, CFG)
        one = book.daily_weights(t, r).groupBy("date").agg(F.sum(F.col("weight") * (F.exp("r") - 1)).alias("r")).withColumn("asset", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return M.summary(out)


@study
def ensemble(s, d):
    """Equal blend, gates and multiplicative weights over the sleeves."""
    regs = t3._book_regs(s, d)
    sl = book.sleeves(_rets(s, d), regs, CFG)
    gates = {0: {"momentum": 0.6, "mean_reversion": 0.2, "low_vol": 0.2}, 1: {"momentum": 0.3, "mean_reversion": 0.4, "low_vol": 0.3}, 2: {"momentum": 0.1, "mean_reversion": 0.3, "low_vol": 0.6}}
    rows = sl.groupBy("date").agg(F.avg("r").alias("r")).withColumn("asset", F.lit("equal"))
    rows = rows.unionByName(book.gates_blend(sl, regs, gates).withColumn("asset", F.lit("gates")))
    for name, share in (("hedge", 0.0), ("fixed_share", 0.005)):
        rows = rows.unionByName(X.hedge_weights(sl, share=share).select("date", "r", F.lit(name).alias("asset")))
    return M.summary(rows)


@study
def forensics(s, d):
    """Probability of overfitting on the variant family."""
    return I.cscv_pbo(variant_family(book.sleeves(_rets(s, d), t3._book_regs(s, d), CFG)), 8)


@study
def synthesis(s, d):
    """The book, gross and net, beside the market."""
    n = book.run_book(_rets(s, d), t3._book_regs(s, d), CFG)["net"]
    rows = n.select("date", F.col("net").alias("r"), F.lit("net").alias("asset")).unionByName(n.select("date", F.col("gross").alias("r"), F.lit("gross").alias("asset")))
    return M.summary(rows.unionByName(_mkt(s, d).select("date", "r", F.lit("market").alias("asset"))))


@study
def tails(s, d):
    """Scores by number of states in known worlds."""
    k = khallucination(s).select(F.concat_ws("/", "world", "family", F.col("k").cast("string")).alias("model"), "score", F.lit(None).cast("double").alias("p"), F.lit(None).cast("int").alias("kept"))
    real = X.scores_confidence_set(X.model_scores(t3._feats(s, d))).select(F.concat(F.lit("real/"), F.col("model")).alias("model"), "score", "p", "kept")
    return k.unionByName(real)


@study
def rfsv(s, d):
    """Confidence set of the variance models."""
    return t3.QUERIES["vol_model_confidence_set"](s, d)


@study
def laws(s, d):
    """Kurtosis law and deformation per asset."""
    return _by_asset(s, d, t5.LAWS)


@study
def clock(s, d):
    """Tail dependence of pairs in excess of the Gaussian null, and commonality of clocks."""
    r = _rets(s, d)
    null = B.gaussian_tail_null(s).withColumn("bin", F.round(F.col("rho") / 0.05).cast("int"))
    x = Q.tail_dependence(r).join(Q.spearman_pairs(r), ["a", "b"]).withColumn("bin", F.round(F.col("gauss_rho") / 0.05).cast("int"))
    y = x.join(F.broadcast(null), "bin").agg(F.avg(F.col("lower_tail") - F.col("mean")).alias("excess"), F.avg((F.col("lower_tail") > F.col("p95")).cast("double")).alias("above_null"))
    return y.crossJoin(clock_commonality(_gk(s, d)).select("first", "second"))


@study
def surge(s, d):
    """Cascade moments, arrow and leverage per asset."""
    return _by_asset(s, d, t5.SURGE)


@study
def surge_intensity(s, d):
    """Lift of joint tail days after agitated clocks."""
    return surge_lift(_rets(s, d), _gk(s, d))


@study
def bits(s, d):
    """Direction bits and the Sharpe ceiling they allow."""
    r, out = staged(_rets(s, d)), None
    w = ordered()
    for h in (1, 5, 21):
        f = E.causal_features(r).withColumn("full", F.concat_ws("_", "sg", "mom", "volt")).drop("next")
        ahead = r.select("asset", "date", F.when(F.count("r").over(w.rowsBetween(1, h)) >= h, F.signum(F.sum("r").over(w.rowsBetween(1, h))).cast("int")).alias("next"))
        one = X.direction_bits(f.join(ahead.where("next is not null"), ["asset", "date"]), "full", "next").withColumn("part", F.lit(f"direction/{h}"))
        out = one if out is None else out.unionByName(one)
    vol = F.sqrt(F.avg(F.col("r") * F.col("r")).over(w.rowsBetween(-20, 0)))
    x = r.withColumn("vol", vol).withColumn("nx", F.abs(F.lead("r").over(w))).withColumn("era", F.ntile(2).over(w))
    for part, rows in (("magnitude", x), ("magnitude/early", x.where("era = 1")), ("magnitude/late", x.where("era = 2"))):
        one = X.knn_information(rows, "vol", "nx").select("asset", (F.col("nats") / F.log(F.lit(2.0))).alias("bits"), F.lit(None).cast("int").alias("significant"), F.lit(part).alias("part"))
        out = out.unionByName(one)
    out = staged(out)
    total = out.where("part in ('direction/1', 'magnitude')").groupBy("asset").agg(F.sum(F.greatest("bits", F.lit(0.0))).alias("bits"))
    out = out.unionByName(total.select("asset", "bits", F.lit(None).cast("int").alias("significant"), F.lit("total").alias("part")))
    return out.withColumn("ceiling", E.sharpe_ceiling(F.greatest("bits", F.lit(0.0)) * F.log(F.lit(2.0))))


@study
def arrow(s, d):
    """Irreversibility of returns and of deformed returns."""
    x = L.standardized(_gk(s, d))
    return X.entropy_test(x, "r").withColumn("kind", F.lit("returns")).unionByName(X.entropy_test(x, "z").withColumn("kind", F.lit("deformed")))


def _agents(s, configs, **kw):
    return X.majority_scores(X.agent_batteries(s, configs={k: W.CONFIGS[k] for k in configs}, **kw))


@study
def decathlon(s, d):
    """Stylised facts of agent configurations."""
    return _agents(s, ("G", "F", "FC", "FV", "FCV", "FCVM", "FCVMH"))


@study
def decathlon2(s, d):
    """Anticipators switched on and off."""
    main = X.majority_scores(X.agent_batteries(s, configs={k: k for k in ("FCVMA", "FVA", "FA")})).select("config", "seeds", "score", "kurt")
    return main.unionByName(anticipator_grid(s))


def anticipator_grid(s, seeds: int = 4, rows: int = 6000, draws: int = 120) -> DataFrame:
    """Scores over the 18 settings of the anticipators' strength, capital and noise, on seeds of their own; a run is one group."""
    cells = [(i, *c) for i, c in enumerate((k, c, n, 900 + j) for k in (0.25, 0.5, 1.0) for c in (0.01, 0.02, 0.05) for n in (0.001, 0.002) for j in range(seeds))]

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        c = p.iloc[0]
        m = W.Market(ahead=float(c["ahead"]), capital=float(c["capital"]), ahead_noise=float(c["noise"]))
        b = W.battery(W.agent_market("FCVMA", [int(c["seed"])], rows, market=m)[0], int(c["seed"]), draws)
        return pd.DataFrame({"config": [f"A/{c['ahead']:g}/{c['capital']:g}/{c['noise']:g}"], "kurt": [b["kurt"]], **{f"E{k}": [b[f"E{k}"]] for k in range(1, 11)}})

    facts = ", ".join(f"E{k} double" for k in range(1, 11))
    got = X.grid(s, cells, "cell int, ahead double, capital double, noise double, seed int", fn, f"config string, kurt double, {facts}")
    return X.majority_scores(got).select("config", "seeds", "score", "kurt")


def _paired(s, name: str, pairs: int = 32, rows: int = 6000, draws: int = 120, **change) -> DataFrame:
    """A change against its control on the same seeds: means of score and direction bits, wins, and the
    signed-rank and sign tests of the bits; a seed is one group. ``flows`` and ``control`` name the markets."""
    flows, control = change.pop("flows", "FCVMA"), change.pop("control", "FCVMA")
    seeds = [(k, 100 + k) for k in range(pairs)]

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        sd = int(p["seed"].iloc[0])
        a, b = (W.battery(W.agent_market(f, [sd], rows, **kw)[0], sd, draws) for f, kw in ((control, {}), (flows, change)))
        return pd.DataFrame({"seed": [sd], "control": [a["score"]], "changed": [b["score"]], "bits0": [a["bits"]], "bits1": [b["bits"]]})

    x = X.grid(s, seeds, "cell int, seed int", fn, "seed int, control double, changed double, bits0 double, bits1 double").withColumn("change", F.lit(name))

    def tests(p: pd.DataFrame) -> pd.DataFrame:
        d = (p["bits1"] - p["bits0"]).to_numpy()
        return pd.DataFrame({
            "seeds": [len(p)], "gain": [float((p["changed"] - p["control"]).mean())], "wins": [int((p["changed"] > p["control"]).sum())], "bits_gain": [float(d.mean())],
            "signed_rank_p": [float(signed_rank_p(d))], "sign_p": [float(sign_test_p(int((d > 0).sum()), int((d != 0).sum())))],
        })

    return X.per_series(x, ["change"], tests, "seeds int, gain double, wins int, bits_gain double, signed_rank_p double, sign_p double", order="seed")


@study
def decathlon3(s, d):
    """Five layers of anticipation against one, paired by seed."""
    one = _paired(s, "one layer against none", control="FCVM")
    return one.unionByName(_paired(s, "five layers against one", layers=5))


@study
def decathlon4(s, d):
    """Quotes that lean against forecast flow, paired by seed."""
    out = None
    for lean in (0.5, 1.0):
        x = _paired(s, f"lean {lean:g}", flows="FCVM", control="FCVM", lean=lean)
        out = x if out is None else out.unionByName(x)
    return out.join(quote_leak(s), "change", "left")


def quote_leak(s, seeds: int = 8, rows: int = 6000) -> DataFrame:
    """Correlation of the flow to come, known the day before, with the day's return, by how far quotes lean; a seed is one group."""
    cells = [(i, lean, 100 + k) for i, (lean, k) in enumerate((v, k) for v in (0.0, 0.5, 1.0) for k in range(seeds))]

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        c, m = p.iloc[0], W.Market()
        r = W.agent_market("FCVM", [int(c["seed"])], rows, lean=float(c["lean"]))[0]
        var, flow = m.target_vol**2, np.empty(rows)
        for t in range(rows):
            flow[t] = m.flow_to_come(np.array([var]))
            var += m.vol_speed * (r[t] ** 2 - var)
        return pd.DataFrame({"change": [f"lean {c['lean']:g}"], "leak": [float(np.corrcoef(flow, r)[0, 1])]})

    return X.grid(s, cells, "cell int, lean double, seed int", fn, "change string, leak double").groupBy("change").agg(F.avg("leak").alias("leak"))


@study
def battery_audit(s, d):
    """The battery on the panel's own series."""
    fn = lambda p: pd.DataFrame({"score": [W.battery(p["r"].to_numpy(float), 0)["score"]]})
    return X.per_series(_rets(s, d), ["asset"], fn, "score double")


@study
def score_se(s, d):
    """Spread of scores over seeds."""
    return B.majority_spread(X.agent_batteries(s))


@study
def critical(s, d):
    """Gain of early-warning indicators per asset."""
    return t3.QUERIES["incremental_auc"](s, d)


@study
def reflex(s, d):
    """Branching ratios before and after deformation, de-biased on the recovery curve."""
    from ..kernels.volmodels import debias

    fits = t3.QUERIES["hawkes_branching"](s, d)
    curve = X.hawkes_recovery(s).orderBy("n").collect()  # one row per grid point
    true, got = np.array([r["n"] for r in curve]), np.array([r["fitted"] for r in curve])
    fn = lambda p: pd.DataFrame({"n": p["n"], "debiased": [debias(v, true, got) if v == v else np.nan for v in p["n"]]})
    return X.per_series(fits, ["asset", "kind"], fn, "n double, debiased double", order="kind")


@study
def constants(s, d):
    """Constancy of the laws over eras."""
    est = law_estimates(law_battery(_gk(s, d)), "era").withColumn("centre", F.col("group").cast("double"))
    v = B.variance_ratio(est.where("sd is not null"), "law")
    return v.withColumn("label", I.classify(F.col("vr_p"), F.col("trend_p")))


def _universes(s, d) -> DataFrame:
    flag = law_battery(_gk(s, d), 2).withColumn("universe", F.lit("flag"))
    brand = law_battery(V.gk_variance(P.bars_brand(s, d)), 2).withColumn("universe", F.lit("brand"))
    hour = law_battery(V.gk_variance(P.bars_event(s, d).where("low > 0")), 2).withColumn("universe", F.lit("event"))
    return law_estimates(flag.unionByName(brand).unionByName(hour), "universe")


@study
def transfer(s, d):
    """Laws of other universes against the first."""
    return contrasts(_universes(s, d), "flag")


@study
def crypto(s, d):
    """Leverage effect of the hourly universe against the first."""
    return contrasts(_universes(s, d), "flag").where("group = 'event' and law = 'leverage'")


@study
def fx(s, d):
    """Range audit and leverage contrast of the brand universe."""
    a = E.real_range_audit(P.bars_brand(s, d), 0.5).agg(F.avg("share").alias("share"), F.sum("passed").alias("passed"))
    return contrasts(_universes(s, d), "flag").where("group = 'brand' and law = 'leverage'").crossJoin(a)


@study
def crypto_wide(s, d):
    """All pairs of universes by leverage."""
    u = _universes(s, d).where("law = 'leverage'")
    return contrasts(u, "flag").unionByName(contrasts(u.where("group <> 'flag'"), "brand"))


def legacy_exposure(m: DataFrame, brakes: DataFrame, start: float = 0.08, end: float = 0.20, floor: float = 0.25) -> DataFrame:
    """u, date, exposure of the overlay as it was first published, kept for its row alone: the least of lever, CVaR
    brake and a drawdown brake with the wrong sign (it brakes at the high and releases in the fall), smoothed."""
    w = Window.partitionBy("u").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nav = m.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("dd", F.col("nav") / F.max("nav").over(w) - 1)
    wrong = F.least(F.lit(1.0), F.greatest(F.lit(floor), 1 - (F.col("dd") + start) * (1 - floor) / (end - start)))
    lever = X.exposure(m.withColumn("brake", F.lit(1.0)), cap=1.0).select("date", "lever")
    x = nav.join(lever, "date").join(brakes.select("date", "cvar_brake"), "date").withColumn("brake", F.least("lever", "cvar_brake", wrong))
    # smoothed as the others are, by an infinite target that leaves the brake alone
    return X.exposure(x.select("u", "date", "r", "brake"), target=1e9, cap=1.0)


@study
def edge(s, d):
    """The market book under the overlay, in halves: the published baseline with its inverted drawdown brake, the
    mended one, with leverage, with the forecast lever, and leaning with momentum."""
    from ..operators.risk import exposure_brakes

    m, out = staged(_mkt(s, d)), None
    brakes = staged(exposure_brakes(m).join(book.momentum_of_market(m), "date", "left"))
    arms = {"legacy": legacy_exposure(m, brakes)}
    for name, cap, more in (("capped", 1.0, {}), ("levered", 1.5, {}), ("forecast", 1.5, {"forecast": True}), ("leaning", 1.5, {"forecast": True, "tilt": 0.15})):
        arms[name] = X.exposure(brakes, cap=cap, **more)
    for name, e in arms.items():
        x = m.join(e.select("date", "exposure"), "date").withColumn("e", F.lag("exposure").over(Window.partitionBy("u").orderBy("date"))).where("e is not null")
        x = x.withColumn("half", F.ntile(2).over(Window.partitionBy("u").orderBy("date")))
        one = x.select("date", (F.col("r") * F.col("e")).alias("r"), F.concat_ws("/", F.lit(name), F.col("half").cast("string")).alias("asset"))
        out = one if out is None else out.unionByName(one)
    return M.summary(out)


@study
def harvest(s, d):
    """Bits beyond the harvested features."""
    return t3.QUERIES["harvest_gap"](s, d)


QUERIES = {f"study_{k}": f for k, f in STUDIES.items()}
