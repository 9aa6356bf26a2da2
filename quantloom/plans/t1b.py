"""Registered queries, continued: laws, events, inference, ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_cdf_sql, ordered
from .t1 import QUERIES, E, G, I, L, P, V, _gk, _gr, _mkt, _regs, _rets, query, rnd

_LAGS = "(values " + ", ".join(f"({x})" for x in L.LAGS) + ") t(delta)"
_QS = "(values " + ", ".join(f"({x}::double)" for x in L.QS) + ") t(q)"
_SCALE = f"""l as (select asset, 0.5 * ln(gk_var) as l, row_number() over (partition by asset order by date) as rn from gk where gk_var is not null),
    m as (select x.asset, delta, q, avg(power(abs(y.l - x.l), q)) as m from l x cross join {_LAGS} join l y on y.asset = x.asset and y.rn = x.rn + delta cross join (select * from {_QS}) group by 1, 2, 3),
    z as (select asset, q, regr_slope(ln(m), ln(delta)) as zeta from m group by 1, 2)"""


@query(f"with {_SCALE} select asset, round(sum(q * zeta) / sum(q * q), 6) as hurst from z group by 1")
def hurst_scaling(s, d):
    """Roughness exponent of log volatility."""
    return rnd(L.hurst(_gk(s, d)))


@query("""with x as (select asset, r - avg(r) over (partition by asset) as d, row_number() over (partition by asset order by date) - 1 as rn from rets),
    b as (select asset, delta, rn // delta as b, sum(d) as s, count(*) as n from x cross join (values (1), (2), (4), (8), (16), (32)) t(delta) group by 1, 2, 3),
    m as (select asset, delta, q, avg(power(abs(s), q)) as m from b cross join (values (0.5::double), (1::double), (1.5::double), (2::double), (2.5::double), (3::double)) t(q) where n = delta group by 1, 2, 3),
    z as (select asset, q, regr_slope(ln(m), ln(delta)) as zeta from m group by 1, 2),
    f as (select asset, sum(q * q) as a, sum(-q * q * (q - 2) / 2) as b, sum(q * (q - 2) / 2 * q * (q - 2) / 2) as c, sum(q * zeta) as u, sum(-q * (q - 2) / 2 * zeta) as v from z group by 1)
    select asset, round((u * c - v * b) / (a * c - b * b), 6) as h, round((v * a - u * b) / (a * c - b * b), 6) as lambda2 from f""")
def mrw_lambda2(s, d):
    """Multifractal fit of block moments."""
    return rnd(L.mrw_lambda2(_rets(s, d)))


_STD = "sx as (select *, round(r / sqrt(gk_var), 8) as z from gr)"
_TRIM = "(select asset, {c} as v from (select asset, {c}, avg({c}) over (partition by asset) as m, stddev_samp({c}) over (partition by asset) as sd from sx where {c} is not null) where abs({c} - m) < 12 * sd)"


@query(f"""with {_STD}, a as (select asset, kurtosis(v) as k from {_TRIM.format(c='r')} group by 1), b as (select asset, kurtosis(v) as k from {_TRIM.format(c='z')} group by 1)
    select asset, round(a.k, 5) as kurt_raw, round(b.k, 5) as kurt_deformed from a join b using (asset)""")
def deformed_kurtosis(s, d):
    """Kurtosis before and after division by volatility."""
    return rnd(L.deformed_kurtosis(_gk(s, d)), 5)


@query(f"""with {_STD}, l as (select asset, date, 0.5 * ln(gk_var) as l from gk where gk_var is not null), c as (select asset, date, l - avg(l) over (partition by asset) as d from l),
    g as (select *, lag(d, 1) over w as d1, lag(d, 2) over w as d2 from c window w as (partition by asset order by date)),
    s as (select asset, avg(d * d1) as c1, avg(d * d2) as c2, var_pop(d) as c0 from g group by 1),
    v as (select asset, coalesce(case when c1 > 0 and c2 > 0 then least(c1 * c1 / c2, c0) end, greatest(c1, 0.0)) as s2 from s),
    k as (select asset, kurtosis(v) + 3 as realised from {_TRIM.format(c='r')} group by 1)
    select asset, round(s2, 6) as s2, round(realised, 5) as realised, round(3 * exp(4 * s2), 5) as implied from v join k using (asset)""")
def kurtosis_law(s, d):
    """Kurtosis implied by the variance of log volatility."""
    x = L.kurtosis_law(_gk(s, d))
    return x.select("asset", F.round("s2", 6).alias("s2"), F.round("realised", 5).alias("realised"), F.round("implied", 5).alias("implied"))


_CLEAN = "g as (select asset, date, r, gk_var, row_number() over (partition by asset order by date) as rn from gr where r is not null and gk_var is not null)"


@query(f"with {_CLEAN} select x.asset, tau::int as tau, round(corr(x.r, y.gk_var), 6) as c from g x cross join range(1, 21) t(tau) join g y on y.asset = x.asset and y.rn = x.rn + tau group by 1, 2")
def leverage_kernel(s, d):
    """Correlation of returns with later variance by lag."""
    return rnd(L.leverage_kernel(_gr(s, d), 20))


@query(f"with {_CLEAN}, k as (select x.asset, tau, corr(x.r, y.gk_var) as c from g x cross join range(1, 11) t(tau) join g y on y.asset = x.asset and y.rn = x.rn + tau group by 1, 2) select asset, round(avg(c), 6) as leverage from k group by 1")
def leverage_effect(s, d):
    """Mean of the leverage kernel over ten lags."""
    return rnd(L.leverage_effect(_gr(s, d)))


@query(f"""with {_CLEAN}, k as (select x.asset, tau, corr(x.r * x.r, y.gk_var) - corr(x.gk_var, y.r * y.r) as c from g x cross join range(1, 21) t(tau) join g y on y.asset = x.asset and y.rn = x.rn + tau group by 1, 2)
    select asset, round(sum(c), 6) as zumbach from k group by 1""")
def zumbach_stat(s, d):
    """Asymmetry of past squared returns and later volatility."""
    return rnd(L.zumbach(_gr(s, d)))


_WEEK = """wl as (select asset, b, max(date) as date, round(avg(0.5 * ln(gk_var)), 10) as logvol from (select *, (row_number() over (partition by asset order by date) - 1) // 5 as b from gk where gk_var is not null) group by 1, 2 having count(*) = 5)"""


@query(f"with {_WEEK} select asset, b, date, logvol from wl")
def weekly_logvol(s, d):
    """Block means of log volatility."""
    return L.weekly_logvol(_gk(s, d))


@query(f"""with {_WEEK}, i as (select asset, b, logvol - lag(logvol) over (partition by asset order by b) as i from wl), j as (select *, abs(i) as a from i where i is not null),
    k as (select *, lag(i, 1) over w as i1, lag(a, 1) over w as a1, lag(a, 5) over w as a5 from j window w as (partition by asset order by b))
    select asset, count(i) as n, round(kurtosis(i), 5) as kurt, round(corr(i, i1), 5) as ac1, round(corr(a, a1), 5) as abs_ac1, round(corr(a, a5), 5) as abs_ac5 from k group by 1""")
def cascade_moments(s, d):
    """Moments of weekly log-volatility innovations."""
    return rnd(L.cascade_moments(_gk(s, d)), 5)


@query("""with x as (select asset, date, r, case when count(r) over w >= 252 then quantile_cont(r, 0.05) over w end as q from rets window w as (partition by asset order by date rows between 504 preceding and 1 preceding))
    select date, round(avg((r < q)::int::double), 6) as share, (avg((r < q)::int::double) >= 0.25)::int as joint from x where q is not null group by 1""")
def joint_tail_days(s, d):
    """Days on which many assets fall below their own trailing quantile."""
    return rnd(L.joint_tail_days(_rets(s, d)))


@query("""with t as (select a.asset as a, b.asset as b from (select distinct asset from rets) a, (select distinct asset from rets) b where a.asset < b.asset),
    g as (select a, b, r as v, sum((asset = a)::int) as na, sum((asset = b)::int) as nb from t join rets on asset = a or asset = b group by 1, 2, 3),
    c as (select a, b, abs(sum(na) over w / sum(na) over p - sum(nb) over w / sum(nb) over p) as gap from g window w as (partition by a, b order by v), p as (partition by a, b))
    select a, b, round(max(gap), 6) as ks from c group by 1, 2""")
def ks_two_sample(s, d):
    """Distance of every two return distributions."""
    r = _rets(s, d)
    n = r.select(F.col("asset").alias("a")).distinct()
    pairs = n.crossJoin(n.withColumnRenamed("a", "b")).where("a < b")
    return rnd(L.ks_two_sample(r, "asset", "r", pairs))


# ---- events and information

_LAB = """f as (select asset, date, close, r, round(ln(lead(close, 20) over (partition by asset order by date) / close), 10) as fwd from rets),
    th as (select *, case when count(fwd) over w >= 504 then quantile_cont(fwd, 0.05) over w end as threshold from f window w as (partition by asset order by date rows between unbounded preceding and 1 preceding)),
    lab as (select *, case when fwd is not null and threshold is not null then (fwd < threshold)::int end as label from th)"""


@query(f"with {_LAB} select asset, date, fwd, round(threshold, 7) as threshold, coalesce(label, -1) as label from lab")
def crash_labels(s, d):
    """Forward falls beyond the expanding quantile."""
    x = E.crash_labels(_rets(s, d)).withColumn("label", F.coalesce("label", F.lit(-1)))
    return rnd(x.select("asset", "date", "fwd", "threshold", "label"), 7, keep=("fwd",))


_EWS = """st as (select asset, date, r, round(ln(close), 8) as state from rets), st2 as (select *, lag(state, 1) over w as s1, lag(state, 2) over w as s2 from st window w as (partition by asset order by date)),
    ew as (select asset, date, count(state) over w as n, var_pop(state) over w as sv, corr(state, s1) over w as ac1, corr(state, s2) over w as ac2, covar_pop(state, s1) over w / nullif(var_pop(s1) over w, 0) as phi, var_samp(r) over w as rv
      from st2 window w as (partition by asset order by date rows between 60 preceding and 1 preceding))"""


@query(f"""with {_EWS} select asset, date, round(sv, 6) as state_var, round(ac1, 4) as ac1, round(ac2, 4) as ac2, round(phi, 4) as phi, round(rv, 7) as ret_var from ew where n >= 60""")
def ews_indicators(s, d):
    """Early-warning indicators over past rows."""
    x = E.ews_indicators(_rets(s, d).withColumn("state", F.round(F.log("close"), 8))).where("state_var is not null")
    return x.select("asset", "date", F.round("state_var", 6).alias("state_var"), *[F.round(c, 4).alias(c) for c in ("ac1", "ac2", "phi")], F.round("ret_var", 7).alias("ret_var"))


_V60 = "v60 as (select asset, date, round(stddev_samp(r) over (partition by asset order by date rows between 59 preceding and current row), 10) as vol from rets)"


def _labelled(s, d):
    v = _rets(s, d).withColumn("vol", F.round(F.stddev_samp("r").over(ordered().rowsBetween(-59, 0)), 10)).select("asset", "date", "vol")
    return E.crash_labels(_rets(s, d)).join(v, ["asset", "date"])


@query(f"""with {_LAB}, {_V60}, j as (select asset, vol, label from lab join v60 using (asset, date) where label is not null and vol is not null),
    k as (select *, rank() over (partition by asset order by vol) + (count(*) over (partition by asset, vol) - 1) / 2.0 as rk from j),
    s as (select asset, sum(label)::double as p, count(*)::double as n, sum(case when label = 1 then rk end) as s from k group by 1)
    select asset, round((s - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) as auc from s""")
def auc_rank(s, d):
    """Area under the curve of volatility as a crash score."""
    return rnd(E.auc(_labelled(s, d), "vol", "label"))


@query(f"""with {_LAB}, {_V60}, j as (select asset, date, vol, abs(r) as sig, label from lab join v60 using (asset, date) where label is not null and vol is not null),
    c as (select *, (row_number() over (partition by asset order by vol, date) - 1) * 3 // count(*) over (partition by asset) as c from j),
    t as (select *, (row_number() over (partition by asset order by sig, date) - 1) * 3 // count(*) over (partition by asset) as t from c where c = 1)
    select asset, round(avg(case when t = 2 then label::double end), 6) as top, round(avg(case when t = 0 then label::double end), 6) as bottom,
      round(avg(case when t = 2 then label::double end) / nullif(avg(case when t = 0 then label::double end), 0), 6) as lift from t group by 1""")
def stratified_lift(s, d):
    """Event rates by signal within a volatility stratum."""
    return rnd(E.stratified_lift(_labelled(s, d).withColumn("sig", F.abs("r")), "sig", "vol", "label"))


@query(f"""with {_LAB}, {_V60}, j as (select asset, date, vol, label from lab join v60 using (asset, date) where vol is not null),
    z as (select *, (vol - avg(vol) over (partition by asset)) / stddev_pop(vol) over (partition by asset) as z, (label = 1 and coalesce(lag(label) over (partition by asset order by date), 0) = 0)::int as on1 from j),
    y as (select asset, z, coalesce(on1, 0) as on1, coalesce(max(coalesce(on1, 0)) over (partition by asset order by date rows between 1 following and 20 following), 0) as pre from z)
    select asset, round(avg(case when pre = 1 then z end), 5) as before, round(avg(case when pre = 0 then z end), 5) as elsewhere, sum(on1)::bigint as onsets from y group by 1""")
def precursor_shift(s, d):
    """Mean standardised volatility before onsets."""
    return rnd(E.precursor_shift(_labelled(s, d), "vol", "label"), 5)


_FEAT = """cf as (select asset, date, sign(r)::int as sg, case when count(r) over w >= 21 then sign(round(sum(r) over w, 8))::int end as mom, round(sqrt(avg(r * r) over w), 10) as vol, sign(lead(r) over (partition by asset order by date))::int as nx from rets
      window w as (partition by asset order by date rows between 20 preceding and current row)),
    ct as (select *, (row_number() over (partition by asset order by vol, date) - 1) * 3 // count(*) over (partition by asset) as volt from cf where mom is not null and nx is not null),
    cc as (select asset, sg || '_' || mom || '_' || volt as a, nx as b from ct)"""


@query(f"""with {_FEAT}, c as (select asset, a, b, count(*) as n from cc group by 1, 2, 3),
    t as (select *, sum(n) over (partition by asset) as tot, sum(n) over (partition by asset, a) as na, sum(n) over (partition by asset, b) as nb from c)
    select asset, round(sum(n / tot * ln(n * tot / (na * nb))) - (count(*) - count(distinct a) - count(distinct b) + 1) / (2 * max(tot)), 6) as mi from t group by 1""")
def discrete_mi(s, d):
    """Mutual information of composite features and the next sign."""
    f = E.causal_features(_rets(s, d)).withColumn("a", F.concat_ws("_", "sg", "mom", "volt"))
    return rnd(E.discrete_mi(f, "a", "next"))


@query("""with q as (select asset, quantile_cont(r, 1/3.) as e1, quantile_cont(r, 2/3.) as e2 from rets group by 1),
    y as (select asset, date, (r >= e1)::int + (r >= e2)::int as s from rets join q using (asset)),
    g as (select asset, s * 9 + lead(s, 1) over w * 3 + lead(s, 2) over w as f, s + lead(s, 1) over w * 3 + lead(s, 2) over w * 9 as b from y window w as (partition by asset order by date)),
    c as (select a.asset, c, (select count(*) from g where g.asset = a.asset and f = c) as nf, (select count(*) from g where g.asset = a.asset and b = c) as nb from (select distinct asset from rets) a cross join range(27) t(c)),
    p as (select asset, (nf + 0.5) / (sum(nf) over (partition by asset) + 13.5) as p, (nb + 0.5) / (sum(nf) over (partition by asset) + 13.5) as q from c)
    select asset, round(sum(p * log2(p / q)) / 3, 6) as ep from p group by 1""")
def ngram_entropy_production(s, d):
    """Irreversibility of symbolised returns."""
    return rnd(E.ngram_entropy_production(E.symbolize(_rets(s, d), "r")))


@query("""with q as (select asset, quantile_cont(abs(r), 0.95) as q from rets group by 1), x as (select asset, date, r, row_number() over (partition by asset order by date) - 1 as pos from rets)
    select asset, date, pos from x join q using (asset) where abs(r) > q""")
def exceedance_events(s, d):
    """Positions of large moves."""
    return E.exceedances(_rets(s, d), "r")


@query("""with x as (select asset, date, r, round(r / sqrt(gk_var), 8) as z from gr), y as (select asset, date, abs(r) as v, 'raw' as kind from x where r is not null and z is not null union all select asset, date, abs(z), 'deformed' from x where r is not null and z is not null),
    q as (select asset, kind, quantile_cont(v, 0.95) as q from y group by 1, 2) select asset, kind, count(*) as n from y join q using (asset, kind) where v > q group by 1, 2""")
def raw_vs_deformed_events(s, d):
    """Number of exceedances of raw and of volatility-scaled returns on common rows."""
    x = L.standardized(_gk(s, d)).where("r is not null and z is not null")
    ev = E.exceedances(x, "r").withColumn("kind", F.lit("raw")).unionByName(E.exceedances(x, "z").withColumn("kind", F.lit("deformed")))
    return ev.groupBy("asset", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("select asset, round(avg((high > low)::int::double), 8) as share, (avg((high > low)::int::double) > 0.9)::int as passed from bars group by 1")
def real_range_audit(s, d):
    """Share of bars with a genuine range."""
    return rnd(E.real_range_audit(P.bars_flag(s, d), 0.9), 8)


@query(f"""with {_EWS}, c as (select asset, phi from ew where n >= 60) select asset, round(avg(case when phi > 0 then -ln(least(phi, 0.9999)) end), 5) as kappa from c group by 1""")
def kappa_from_phi(s, d):
    """Mean recovery rate from AR(1) coefficients."""
    x = E.ews_indicators(_rets(s, d).withColumn("state", F.round(F.log("close"), 8)))
    return rnd(x.where("state_var is not null").groupBy("asset").agg(F.avg("kappa").alias("kappa")), 5)


# ---- inference and regimes

_LOSS = """lo as (select asset, date, power(r, 2) as rv, avg(power(r, 2)) over (partition by asset order by date rows between 5 preceding and 1 preceding) as f1, avg(power(r, 2)) over (partition by asset order by date rows between 60 preceding and 1 preceding) as f2 from rets),
    ql as (select asset, date, round(greatest(rv, 1e-12) / greatest(f1, 1e-12) - ln(greatest(rv, 1e-12) / greatest(f1, 1e-12)) - 1, 8) as a, round(greatest(rv, 1e-12) / greatest(f2, 1e-12) - ln(greatest(rv, 1e-12) / greatest(f2, 1e-12)) - 1, 8) as b from lo where f1 is not null and f2 is not null)"""


def _hac_sql(src: str, h: int) -> str:
    lags = ", ".join(f"lag(e, {k}) over (partition by asset order by date) as e{k}" for k in range(1, h))
    s = "sum(e * e)" + "".join(f" + 2 * {1 - k / h!r} * coalesce(sum(e * e{k}), 0)" for k in range(1, h))
    return f"""dd as (select asset, date, a - b as d, avg(a - b) over (partition by asset) as m from {src}), de as (select *, d - m as e from dd), dl as (select *, {lags} from de),
      ds as (select asset, max(m) as mean, count(*)::double as n, greatest(({s}) / count(*), 1e-18) as s from dl group by 1), dt as (select asset, mean, mean / sqrt(s / n) as stat, -abs(mean / sqrt(s / n)) as nabs from ds)
      select asset, round(mean, 5) as mean, round(stat, 4) as stat, round(2 * {norm_cdf_sql('nabs')}, 5) as p from dt"""


def _losses(s, d):
    x = _rets(s, d).withColumn("rv", F.col("r") * F.col("r"))
    x = x.withColumn("f1", F.avg("rv").over(ordered().rowsBetween(-5, -1))).withColumn("f2", F.avg("rv").over(ordered().rowsBetween(-60, -1)))
    return x.where("f1 is not null and f2 is not null").select("asset", "date", F.round(V.qlike("rv", "f1"), 8).alias("a"), F.round(V.qlike("rv", "f2"), 8).alias("b"))


def _hac(df):
    return df.select("asset", F.round("mean", 5).alias("mean"), F.round("stat", 4).alias("stat"), F.round("p", 5).alias("p"))


@query(f"with {_LOSS}, {_hac_sql('ql', 5)}")
def diebold_mariano(s, d):
    """Short against long variance forecasts by QLIKE."""
    return _hac(I.hac_test(_losses(s, d), "a", "b", 5))


_SCORE = """sc as (select asset, date, r, avg(r*r) over (partition by asset order by date rows between 20 preceding and 1 preceding) as v1, avg(r*r) over (partition by asset order by date rows between 120 preceding and 1 preceding) as v2 from rets),
    ls as (select asset, date, round(-0.5 * (ln(v1) + r * r / v1), 8) as a, round(-0.5 * (ln(v2) + r * r / v2), 8) as b from sc where v1 > 0 and v2 > 0)"""


@query(f"with {_SCORE}, {_hac_sql('ls', 10)}")
def amisano_giacomini(s, d):
    """Gaussian log scores of two variance windows."""
    x = _rets(s, d).withColumn("q", F.col("r") * F.col("r"))
    x = x.withColumn("v1", F.avg("q").over(ordered().rowsBetween(-20, -1))).withColumn("v2", F.avg("q").over(ordered().rowsBetween(-120, -1))).where("v1 > 0 and v2 > 0")
    sc = lambda v: F.round(-0.5 * (F.log(v) + F.col("q") / F.col(v)), 8)
    return _hac(I.hac_test(x.select("asset", "date", sc("v1").alias("a"), sc("v2").alias("b")), "a", "b", 10))


@query("""with x as (select asset as variant, row_number() over (partition by asset order by date) - 1 as t, r from rets), hi as (select max(t) as hi from x),
    b as (select variant, least(floor(t * 8 / (hi + 1)), 7)::int as block, r from x, hi), st as (select block, variant, count(r) as n, sum(r) as s, sum(r * r) as q from b group by 1, 2),
    sp as (select a.m as combo, j as block, ((a.m >> j) & 1)::int as inside from range(256) a(m), range(8) t(j) where bit_count(a.m::int) = 4),
    p as (select combo, variant, inside, sum(n) as n, sum(s) as s, sum(q) as q from st join sp using (block) group by 1, 2, 3),
    sr as (select combo, variant, inside, round(coalesce(s / n / nullif(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 0), 0.0), 10) as sr from p),
    w as (select i.combo, i.variant, i.sr as si, o.sr as so from sr i join sr o on i.combo = o.combo and i.variant = o.variant and i.inside = 1 and o.inside = 0),
    k as (select *, row_number() over (partition by combo order by si desc, variant) as best, rank() over (partition by combo order by so) as rk, count(*) over (partition by combo) as nv from w),
    f as (select rk / (nv + 1) as w from k where best = 1) select count(*) as splits, round(avg((w < 0.5)::int::double), 6) as pbo, round(avg(ln(w / (1 - w))), 6) as logit from f""")
def cscv_pbo(s, d):
    """Probability of backtest overfitting with the assets as variants."""
    x = _rets(s, d).withColumn("t", F.row_number().over(ordered()) - 1).withColumnRenamed("asset", "variant")
    return rnd(I.cscv_pbo(x.select("t", "variant", "r")))


@query("""with t as (select regime as f, lead(regime) over (order by date) as t from regs), c as (select f, t, count(*) as n from t where t is not null group by 1, 2),
    g as (select i::int as f, j::int as t, coalesce((select n from c where c.f = i and c.t = j), 0) + 1.0 as n from range(3) a(i), range(3) b(j))
    select f as "from", t as "to", round(n::double / sum(n) over (partition by f), 8) as p from g""")
def transition_matrix(s, d):
    """Regime transition probabilities with pseudo-counts."""
    return rnd(I.transition_matrix(_regs(s, d)), 8)


_ISL = "i1 as (select date, regime, coalesce(lag(regime) over (order by date) <> regime, true)::int as c from regs), i2 as (select *, sum(c) over (order by date) as k from i1), i3 as (select k, count(*) as n from i2 group by 1)"


@query(f"with {_ISL} select round((count(*) - 1) * 252.0 / sum(n), 6) as switches_per_year, quantile_cont(n, 0.5)::double as median_dwell from i3")
def regime_persistence(s, d):
    """Switches per year and median dwell."""
    return rnd(I.persistence(_regs(s, d)).select("switches_per_year", "median_dwell"))


@query("""with x as (select date, regime, row_number() over (order by date) as rn, lead(regime) over (order by date) as nx from regs), st as (select date as start, rn as rn0 from x where day(date) = 15),
    j as (select start, min(rn - rn0) as m from st left join (select rn from x where regime >= 2 and nx >= 2) h on h.rn >= rn0 and h.rn < rn0 + 60 group by 1) select start, coalesce(m, 60) as latency from j""")
def crash_latency(s, d):
    """Rows until two consecutive stressed rows."""
    r = _regs(s, d)
    return I.crash_latency(r, r.where(F.dayofmonth("date") == 15).select(F.col("date").alias("start")))


@query("""with e as (select min(r) as lo, max(r) as hi from rets) select least(floor((r - lo) / ((hi - lo) / 30)), 29)::int as bin, count(*) as n from rets, e group by 1""")
def histogram(s, d):
    """Distribution of returns in thirty bins."""
    return I.histogram(_rets(s, d), "r", 30)


@query("""with m as (select asset, avg(r) as mu, stddev_samp(r) / sqrt(count(r)) as se from rets group by 1), x as (select a.asset as a, b.asset as b, a.mu as ma, b.mu as mb, (a.mu - b.mu) / sqrt(a.se * a.se + b.se * b.se) as z from m a join m b on a.asset < b.asset)
    select a, b, round(z, 5) as z, case when ma * mb < 0 then case when abs(z) > 1.645 then 'INVERTED' else 'SAME' end when z > 1.645 then 'STRONGER' when z < -1.645 then 'WEAKER' else 'SAME' end as label from x""")
def class_contrast(s, d):
    """Labelled contrasts of mean returns between assets."""
    m = _rets(s, d).groupBy("asset").agg(F.avg("r").alias("mu"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se"))
    n = m.select(F.col("asset").alias("b"), F.col("mu").alias("mb"), F.col("se").alias("sb"))
    x = m.select(F.col("asset").alias("a"), "mu", "se").join(F.broadcast(n), F.col("a") < F.col("b"))
    z = (F.col("mu") - F.col("mb")) / F.sqrt(F.col("se") ** 2 + F.col("sb") ** 2)
    return x.select("a", "b", F.round(z, 5).alias("z"), I.contrast(F.col("mu"), F.col("se"), F.col("mb"), F.col("sb")).alias("label"))


# ---- ledger


@query("""with n as (select *, case when asset = 'AF' then close * 0.5 else close end as c2, row_number() over (partition by asset order by date desc) as rn from pan), q as (select asset, c2 / close as q from n where rn <= 5),
    s as (select asset, avg(q) as factor, stddev_samp(q) as sd, count(*) as n from q group by 1) select asset, round(factor, 8) as factor from s where abs(factor - 1) > 0.005 and sd < 0.005 and n >= 3""")
def detect_adjustment(s, d):
    """Assets whose recent closes stand in a steady ratio to the stored ones."""
    p = P.panel_flag(s, d)
    return G.detect_adjustment(p.withColumn("close", F.when(F.col("asset") == "AF", F.col("close") * 0.5).otherwise(F.col("close"))), p)


@query("""with w as (select asset, date, close / sum(close) over (partition by date) as w from pan), a as (select * from w where asset <> 'NO'), b as (select asset, date, case when day(date) = 3 then w * 1.01 else w end as w from w)
    select coalesce(a.date, b.date) as date, round(max(abs(coalesce(a.w, 0) - coalesce(b.w, 0))), 8) as max_diff, (max(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) <= 1e-9)::int as ok from a full join b on a.date = b.date and a.asset = b.asset group by 1""")
def ledger_l1(s, d):
    """Stored against recomputed weights."""
    w = P.panel_flag(s, d).withColumn("w", F.col("close") / F.sum("close").over(Window.partitionBy("date")))
    again = w.withColumn("w", F.when(F.dayofmonth("date") == 3, F.col("w") * 1.01).otherwise(F.col("w")))
    return rnd(G.l1_reproduce(w.where("asset <> 'NO'"), again), 8)


@query("""with f as (select date, r, avg(r * r) over (order by date rows between 19 preceding and current row) as f, lead(r * r) over (order by date) as rv from mkt),
    l as (select date, round(greatest(rv, 1e-12) / greatest(f, 1e-12) - ln(greatest(rv, 1e-12) / greatest(f, 1e-12)) - 1, 10) as loss from f where rv is not null)
    select date, loss, round(case when count(loss) over w >= 20 then avg(loss) over w end, 6) as mean_qlike from l window w as (order by date rows between 89 preceding and current row)""")
def ledger_l2(s, d):
    """Tracking of forecast variance."""
    m = _mkt(s, d)
    led = m.withColumn("forecast_var", F.avg(F.col("r") * F.col("r")).over(Window.partitionBy("u").orderBy("date").rowsBetween(-19, 0))).select("date", "forecast_var")
    return rnd(G.l2_tracking(led, m), keep=("loss",))


@query("select case regime when 2 then 'GAP' else 'LIVE' end as status, count(*) as n, sum((1 - regime * 0.6 < 0)::int)::bigint as violations from regs group by 1")
def ledger_l3(s, d):
    """Status counts and exposures outside the band."""
    x = _regs(s, d).select(F.when(F.col("regime") == 2, "GAP").otherwise("LIVE").alias("status"), (1 - F.col("regime") * 0.6).alias("exposure"))
    return G.l3_bands(x)


@query("""with b as (select asset, close / sum(close) over () as w from pan where date = (select max(date) from pan)), r as (select asset, round(w * 0.8 * 100000, 0) as dollars from b where w > 0.005)
    select * from r union all select 'CASH', 100000 - sum(dollars) from r""")
def recommend(s, d):
    """Whole-dollar allocation and cash."""
    w = P.panel_flag(s, d).withColumn("u", F.lit("flag"))
    last = w.where(F.col("date") == w.agg(F.max("date")).first()[0]).withColumn("w", F.col("close") / F.sum("close").over(Window.partitionBy("u")))
    return G.recommend(last, 0.8)


