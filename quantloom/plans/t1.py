"""Registered queries that SQL can express, each with its DuckDB text.

``SQL`` texts share the common table expressions of ``BASE``; only those that a text
names are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import panels as P
from ..functions.exprs import ANNUAL, norm_cdf_sql, norm_ppf_sql, ordered, roll_mean, roll_std, trailing
from ..operators import events as E
from ..operators import inference as I
from ..operators import laws as L
from ..operators import ledger as G
from ..operators import metrics as M
from ..operators import pairs as Q
from ..operators import relational as J
from ..operators import risk as R
from ..operators import signals as S
from ..operators import volatility as V
from ..staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BASE = {
    "bars": f"""select l_returnflag||l_linestatus as asset, l_shipdate as date, first(l_extendedprice order by {_LI}) as open,
        max(l_extendedprice) as high, min(l_extendedprice) as low, last(l_extendedprice order by {_LI}) as close, sum(l_quantity) as volume
        from lineitem group by 1, 2""",
    "dm": "select l_returnflag||l_linestatus as asset, l_shipdate as date, avg(l_extendedprice) as px from lineitem group by 1, 2",
    "pan": """select * from (select asset, date, round(case when count(px) over w >= 20 then avg(px) over w end, 3) as close from dm
        window w as (partition by asset order by date rows between 19 preceding and current row)) where close is not null""",
    "rets": """select * from (select *, round(ln(close / lag(close) over (partition by asset order by date)), 10) as r from pan) where r is not null""",
    "mkt": "select date, round(avg(r), 12) as r from rets group by 1",
    "gk": """select asset, date, open, high, low, close, volume, case when v > 0 then v end as gk_var from (select *, round(
        0.5*ln(high/low)*ln(high/low) - 0.3862943611198906*ln(close/open)*ln(close/open) + power(ln(open / lag(close) over (partition by asset order by date)), 2), 10) as v from bars)""",
    "vols": "select *, round(sqrt(avg(r*r) over (order by date rows between 19 preceding and current row)), 10) as vol from mkt",
    "regs": """select date, r, cast(case when n < 60 then 1 when vol > b then 2 when vol > a then 1 else 0 end as int) as regime from (select *, count(vol) over w as n,
        quantile_cont(vol, 1/3.) over w as a, quantile_cont(vol, 2/3.) over w as b from vols window w as (order by date rows between unbounded preceding and 1 preceding))""",
    "gr": "select *, round(ln(close / lag(close) over (partition by asset order by date)), 10) as r from gk",
    "pr": "select x.date, x.asset as a, y.asset as b, x.r as x, y.r as y from rets x join rets y on x.date = y.date and x.asset < y.asset",
}
ORDER = list(BASE)


def full_sql(text: str) -> str:
    """``text`` with the base tables it needs in front."""
    need: set[str] = set()
    todo = [text]
    while todo:
        t = todo.pop()
        for name in ORDER:
            if name not in need and re.search(rf"\b(from|join)\s+{name}\b", t):
                need.add(name)
                todo.append(BASE[name])
    ctes = [f"{n} as ({BASE[n]})" for n in ORDER if n in need]
    body = text.strip()
    head = "with recursive " if body.startswith("with recursive ") else "with "
    if body.startswith(head):
        return head + ", ".join([*ctes, body[len(head) :]])
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = full_sql(sql)
        return f

    return add


def rnd(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _rets(s: SparkSession, d: str) -> DataFrame:
    return P.returns(P.panel_flag(s, d))


def _mkt(s: SparkSession, d: str) -> DataFrame:
    return P.market(_rets(s, d)).withColumn("u", F.lit("flag"))


def _regs(s: SparkSession, d: str) -> DataFrame:
    return P.regimes_by_vol(_mkt(s, d)).withColumn("u", F.lit("flag"))


def _gk(s: SparkSession, d: str) -> DataFrame:
    return V.gk_variance(P.bars_flag(s, d))


def _gr(s: SparkSession, d: str) -> DataFrame:
    g = _gk(s, d)
    return g.withColumn("r", F.round(P.log_return("close"), 10))


# ---- bars and cleaning


@query("select * from bars")
def bars_daily(s, d):
    """Daily bars of the six flag assets."""
    return P.bars_flag(s, d)


@query("""select event_type as asset, date_trunc('hour', ts) as date, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
    last(value order by ts, event_id) as close, count(*)::double as volume from events group by 1, 2""")
def bars_hourly(s, d):
    """Hourly bars of the event types."""
    return P.bars_event(s, d)


@query(f"""select p_brand as asset, l_shipdate as date, first(l_extendedprice order by {_LI}) as open, max(l_extendedprice) as high, min(l_extendedprice) as low,
    last(l_extendedprice order by {_LI}) as close, sum(l_quantity) as volume from lineitem join part on l_partkey = p_partkey group by 1, 2""")
def bars_brand(s, d):
    """Daily bars of the brands."""
    return P.bars_brand(s, d)


@query("""select c_nationkey::varchar as asset, date_trunc('week', o_orderdate)::timestamp as date, first(o_totalprice order by o_orderkey) as open, max(o_totalprice) as high,
    min(o_totalprice) as low, last(o_totalprice order by o_orderkey) as close, count(*)::double as volume from orders join customer on o_custkey = c_custkey group by 1, 2""")
def bars_nation_weekly(s, d):
    """Weekly bars of the customers' nations."""
    return P.bars_nation(s, d)


@query("""select asset, count(*) as n, count(*) / (select count(distinct date) from bars) as coverage,
    cast(count(*) >= 0.95 * (select count(distinct date) from bars) as int) as kept from bars group by 1""")
def clean_panel_coverage(s, d):
    """Share of the panel's dates on which each asset has a price."""
    b = P.bars_flag(s, d)
    n = b.select("date").distinct().agg(F.count(F.lit(1)).alias("m"))
    g = b.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(n)).select("asset", "n", (F.col("n") / F.col("m")).alias("coverage"), (F.col("n") >= 0.95 * F.col("m")).cast("int").alias("kept"))


_FILL = """with grid as (select a.asset, t.date, b.close from (select distinct asset from bars) a cross join (select distinct date from bars) t
    left join bars b on b.asset = a.asset and b.date = t.date),
    fil as (select asset, date, last_value(close ignore nulls) over (partition by asset order by date rows between 3 preceding and current row) as close from grid)"""


@query(_FILL + " select asset, date, round(close, 2) as close from fil where date in (select date from fil where close is not null group by date having count(*) = 6)")
def clean_panel_ffill(s, d):
    """Prices after the bounded fill, on dates when all assets have one."""
    return rnd(P.clean_panel(P.bars_flag(s, d).select("asset", "date", "close"), min_coverage=0.0, bad_tick=1e18), 2)


@query("""with x as (select *, close / lag(close) over (partition by asset order by date) - 1 as q from pan),
    y as (select asset, date, case when abs(q) > 0.05 then 0.0 else coalesce(ln(1 + q), 0.0) end as st, first_value(close) over (partition by asset order by date) as c0 from x)
    select asset, date, round(c0 * exp(sum(st) over (partition by asset order by date rows unbounded preceding)), 2) as close from y""")
def clean_panel_badtick(s, d):
    """Price paths rebuilt without moves above 5 %."""
    return rnd(P.flatten_bad_ticks(P.panel_flag(s, d), 0.05), 2)


# ---- returns and volatility


@query("select asset, date, close, r from rets")
def log_returns(s, d):
    """Log returns of the smoothed panel."""
    return _rets(s, d)


@query("select asset, date, round(power(ln(close / lag(close) over (partition by asset order by date)), 2), 10) as c2c_var from pan")
def c2c_variance(s, d):
    """Squared close-to-close returns."""
    return rnd(V.c2c_variance(P.panel_flag(s, d)).select("asset", "date", "c2c_var"), 10)


@query("select asset, date, gk_var from gk")
def gk_variance(s, d):
    """Garman-Klass variance with the overnight part."""
    return _gk(s, d).select("asset", "date", "gk_var")


@query("""select asset, date, round(sqrt(case when count(gk_var) over w >= 5 then avg(gk_var) over w end) * sqrt(252), 6) as realized_vol from gk
    window w as (partition by asset order by date rows between 9 preceding and current row)""")
def realized_vol(s, d):
    """Annual volatility from the trailing mean of the range variance."""
    return rnd(V.realized_vol(_gk(s, d)).select("asset", "date", "realized_vol"))


@query("""with f as (select asset, date, gk_var, avg(gk_var) over (partition by asset order by date rows between 20 preceding and 1 preceding) as f from gk)
    select asset, date, round(greatest(gk_var, 1e-12) / greatest(f, 1e-12) - ln(greatest(gk_var, 1e-12) / greatest(f, 1e-12)) - 1, 6) as qlike from f where gk_var is not null and f is not null""")
def qlike_loss(s, d):
    """QLIKE of the range variance against its mean over the 20 rows before."""
    g = _gk(s, d).withColumn("f", F.avg("gk_var").over(ordered().rowsBetween(-20, -1)))
    return rnd(g.where("gk_var is not null and f is not null").select("asset", "date", V.qlike("gk_var", "f").alias("qlike")))


# ---- performance


_SIMPLE = "select asset, date, round(exp(r) - 1, 10) as r from rets"


def _simple(s, d):
    return _rets(s, d).select("asset", "date", F.round(F.exp("r") - 1, 10).alias("r"))


_DD = """nav as (select *, exp(sum(ln(1 + r)) over (partition by asset order by date)) as nav from sim),
    dd as (select *, nav / max(nav) over (partition by asset order by date) - 1 as dd from nav)"""
_RUN = """isl as (select *, sum(case when round(dd, 12) < 0 then 0 else 1 end) over (partition by asset order by date) as k from dd),
    runs as (select asset, k, min(dd) as low, sum(case when round(dd, 12) < 0 then 1 else 0 end) as n from isl group by 1, 2),
    mdd as (select asset, min(low) as max_drawdown, max(n)::bigint as longest_underwater from runs group by 1)"""


@query(f"""with sim as ({_SIMPLE}), {_DD}, {_RUN}, qs as (select asset, quantile_cont(r, 0.05) as q from sim group by 1),
    vc as (select asset, -max(q) as var, -avg(case when r <= q then r end) as cvar from sim join qs using (asset) group by 1),
    a as (select asset, count(r) as n, power(exp(sum(ln(1 + r))), 252.0 / count(r)) - 1 as cagr, stddev_samp(r) * sqrt(252) as ann_vol,
      avg(r) / stddev_samp(r) * sqrt(252) as sharpe, avg(r) / stddev_samp(case when r < 0 then r end) * sqrt(252) as sortino, skewness(r) as skew, kurtosis(r) as kurt,
      avg((r > 0)::int::double) as hit_rate, exp(sum(ln(1 + r))) - 1 as total_return from sim group by 1)
    select asset, n, round(cagr, 6) as cagr, round(ann_vol, 6) as ann_vol, round(sharpe, 6) as sharpe, round(sortino, 6) as sortino, round(skew, 6) as skew, round(kurt, 6) as kurt,
      round(hit_rate, 6) as hit_rate, round(total_return, 6) as total_return, round(max_drawdown, 6) as max_drawdown, longest_underwater, round(var, 6) as var, round(cvar, 6) as cvar,
      round(case when max_drawdown < 0 then cagr / abs(max_drawdown) else 0 end, 6) as calmar from a join mdd using (asset) join vc using (asset)""")
def perf_summary(s, d):
    """Thirteen statistics per asset."""
    return rnd(M.summary(_simple(s, d)))


@query(f"""with sim as ({_SIMPLE}) select asset, year(date)::int as year, month(date)::int as month, round(exp(sum(ln(1 + r))) - 1, 6) as ret from sim group by 1, 2, 3""")
def monthly_returns(s, d):
    """Compounded returns by calendar month."""
    return rnd(M.monthly_table(_simple(s, d)))


@query(f"with sim as ({_SIMPLE}), {_DD} select asset, date, round(nav, 6) as nav, round(dd, 6) as drawdown from dd")
def drawdown(s, d):
    """Value and drawdown paths."""
    return rnd(M.drawdown_series(_simple(s, d)).select("asset", "date", "nav", "drawdown"))


@query(f"with sim as ({_SIMPLE}), {_DD}, {_RUN} select asset, round(max_drawdown, 6) as max_drawdown, longest_underwater from mdd")
def underwater_spell(s, d):
    """Deepest drawdown and longest spell below the maximum."""
    return rnd(M.max_drawdown(_simple(s, d)))


@query(f"""with sim as ({_SIMPLE}), qs as (select asset, quantile_cont(r, 0.05) as q from sim group by 1)
    select asset, round(-max(q), 8) as var, round(-avg(case when r <= q then r end), 8) as cvar from sim join qs using (asset) group by 1""")
def var_cvar(s, d):
    """Value at risk and its tail mean."""
    return rnd(M.var_cvar(_simple(s, d)), 8)


# ---- signals

_XZ = "case when {x} is null then null when stddev_samp({x}) over (partition by date) >= 1e-12 then coalesce(least(greatest(({x} - avg({x}) over (partition by date)) / stddev_samp({x}) over (partition by date), -3.0), 3.0), 0.0) else 0.0 end"
_MOM = f"""mom0 as (select asset, date, round(lag(close, 21) over w / lag(close, 252) over w - 1, 10) as x from rets window w as (partition by asset order by date)),
    mom as (select asset, date, coalesce({_XZ.format(x='x')}, 0.0) as momentum from mom0)"""
_REV = f"""rev0 as (select asset, date, case when count(close) over w >= 20 then -(close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) end as z from rets
      window w as (partition by asset order by date rows between 19 preceding and current row)),
    rev1 as (select asset, date, case when z is not null then least(greatest(round(z, 10), -3.0), 3.0) end as x from rev0),
    rev as (select asset, date, coalesce({_XZ.format(x='x')}, 0.0) as mean_reversion from rev1)"""
_LV = f"""lv0 as (select asset, date, round(case when count(r) over w >= 60 then stddev_samp(r) over w end, 10) as vol from rets window w as (partition by asset order by date rows between 59 preceding and current row)),
    lv1 as (select asset, date, (rank() over (partition by date order by vol) + (count(*) over (partition by date, vol) - 1) / 2.0 - 0.375) / (count(vol) over (partition by date) + 0.25) as p from lv0 where vol is not null),
    lv2 as (select asset, date, round(-{norm_ppf_sql('p')}, 10) as x from lv1),
    lv as (select asset, date, coalesce({_XZ.format(x='x')}, 0.0) as low_vol from lv2)"""


@query(f"select asset, date, round({_XZ.format(x='r')}, 6) as z from rets")
def xs_zscore(s, d):
    """Cross-sectional z-score of returns."""
    from ..functions.exprs import xz

    return rnd(_rets(s, d).select("asset", "date", xz("r").alias("z")))


@query(f"with {_MOM} select asset, date, round(momentum, 6) as momentum from mom")
def momentum_12_1(s, d):
    """Momentum over 252 rows without the last 21."""
    return rnd(S.momentum(_rets(s, d)).select("asset", "date", "momentum"))


@query(f"with {_REV} select asset, date, round(mean_reversion, 6) as mean_reversion from rev")
def reversal_20(s, d):
    """Reversal against the 20-row mean."""
    return rnd(S.mean_reversion(_rets(s, d)).select("asset", "date", "mean_reversion"))


@query(f"with {_LV} select asset, date, round(low_vol, 6) as low_vol from lv")
def lowvol_rank(s, d):
    """Normal scores of low volatility."""
    return rnd(S.low_vol(_rets(s, d)).select("asset", "date", "low_vol"))


@query(f"""with {_MOM}, {_REV}, {_LV}, w(regime, a, b, c) as (values (0, 0.6, 0.2, 0.2), (1, 0.3, 0.4, 0.3), (2, 0.1, 0.3, 0.6)),
    j as (select asset, date, regime, momentum, mean_reversion, low_vol, round(a::double * momentum + b::double * mean_reversion + c::double * low_vol, 8) as x
      from mom join rev using (asset, date) join lv using (asset, date) join regs using (date) join w using (regime))
    select asset, date, regime, round(momentum, 5) as momentum, round(mean_reversion, 5) as mean_reversion, round(low_vol, 5) as low_vol, round({_XZ.format(x='x')}, 5) as combined from j""")
def combined_signal(s, d):
    """Regime-weighted blend of the signals."""
    r = staged(_rets(s, d))
    m = P.market(r).withColumn("u", F.lit("flag"))
    return rnd(S.combined(r, P.regimes_by_vol(m)), 5)


# ---- book and risk

_DRIFT = """n as (select *, (row_number() over (partition by asset order by date) - 1) // 21 as k from pan),
    g as (select *, close / first_value(close) over (partition by asset, k order by date) as g from n),
    dw as (select asset, date, k, close, g / sum(g) over (partition by date) as w from g)"""


@query(f"with {_DRIFT} select asset, date, k, round(w, 8) as w from dw")
def drift_weights(s, d):
    """Weights between rebalances in closed form."""
    return rnd(R.drift_weights(P.panel_flag(s, d)).select("asset", "date", "k", "w"), 8)


_PNL = _DRIFT + """, pl as (select asset, date, lag(w) over (partition by asset order by date) as wl, close / lag(close) over (partition by asset order by date) - 1 as ret from dw),
    pnl as (select date, round(sum(wl * ret), 10) as r from pl where wl is not null and ret is not null group by 1)"""


@query(f"with {_PNL} select date, r from pnl")
def portfolio_pnl(s, d):
    """Returns of the drifting book."""
    return R.portfolio_pnl(R.drift_weights(P.panel_flag(s, d)))


@query(f"""with {_DRIFT}, v as (select asset, date, round(stddev_samp(r) over (partition by asset order by date rows between 19 preceding and current row), 10) as vol from rets),
    x as (select dw.asset, dw.date, dw.k, w, 1.0/6 - w as dwt, vol from dw join v on v.asset = dw.asset and v.date = dw.date where vol is not null),
    y as (select *, row_number() over (partition by asset, k order by date desc) as rn from x)
    select date, round(sum(abs(dwt) * (1 + 2 + least(10 * (vol / 0.01) * sqrt(abs(dwt) / 0.01), 25))), 6) as cost_bps from y where rn = 1 group by 1""")
def trade_costs(s, d):
    """Cost of going back to equal weights at the end of each drift period."""
    w = R.drift_weights(P.panel_flag(s, d))
    v = _rets(s, d).select("asset", "date", F.round(F.stddev_samp("r").over(trailing(20)), 10).alias("vol"))
    x = w.join(v, ["asset", "date"]).where("vol is not null")
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("asset", "k").orderBy(F.desc("date")))).where("rn = 1")
    return rnd(x.groupBy("date").agg(F.sum(R.trade_cost_bps(F.lit(1 / 6) - F.col("w"), "vol")).alias("cost_bps")))


@query(f"""with {_PNL}, w as (select date, r, quantile_cont(r, 0.05) over f as q, list(r) over f as a, exp(sum(ln(1 + r)) over (order by date)) as nav from pnl
      window f as (order by date rows between 251 preceding and current row)),
    c as (select date, r, case when len(a) >= 50 then -list_avg(list_filter(a, lambda v: v <= q)) end as cvar, nav / max(nav) over (order by date) - 1 as dd from w),
    b as (select date, r, case when cvar > 0 then least(1.0, greatest(0.25, 0.02 / cvar)) else 1.0 end as cb, least(1.0, greatest(0.25, 1 - 0.75 * (-dd - 0.05) / 0.10)) as db from c)
    select date, round(cb, 6) as cvar_brake, round(db, 6) as dd_brake, round(least(cb, db), 6) as brake from b""")
def exposure_brakes(s, d):
    """CVaR and drawdown brakes of the book."""
    p = R.portfolio_pnl(R.drift_weights(P.panel_flag(s, d))).withColumn("u", F.lit("book"))
    return rnd(R.exposure_brakes(p).select("date", "cvar_brake", "dd_brake", "brake"))


@query("""select asset, date, round(case when count(r) over w >= 60 then covar_samp(r, m) over w / nullif(var_samp(m) over w, 0) end, 4) as beta from (select rets.*, mkt.r as m from rets join mkt using (date))
    window w as (partition by asset order by date rows between 59 preceding and current row)""")
def rolling_beta(s, d):
    """Trailing beta to the market proxy."""
    return rnd(R.rolling_beta(_rets(s, d), _mkt(s, d)), 4)


@query("""with x as (select rets.asset, rets.r as y, mkt.r as m, mkt.r * mkt.r as q, row_number() over (partition by asset order by date desc) as rn from rets join mkt using (date)),
    c as (select asset, covar_pop(m, m) as a, covar_pop(m, q) as b, covar_pop(q, q) as c, covar_pop(y, m) as u, covar_pop(y, q) as v from x where rn <= 252 group by 1)
    select asset, round((u * c - v * b) / (a * c - b * b), 4) as delta, round(2 * (v * a - u * b) / (a * c - b * b), 2) as gamma, round(-0.01 / 252, 8) as theta from c""")
def greeks_delta(s, d):
    """Delta, gamma and theta per asset."""
    return R.greeks(_rets(s, d), _mkt(s, d)).select("asset", F.round("delta", 4).alias("delta"), F.round("gamma", 2).alias("gamma"), F.round("theta", 8).alias("theta"))


# ---- joins and sets


@query("""with m as (select * from regs where day(date) in (1, 11, 21)) select p.asset, p.date, p.close, coalesce(m.regime, -1)::int as regime from pan p asof left join m on p.date >= m.date""")
def asof_regime_join(s, d):
    """Every price with the last published regime."""
    pub = _regs(s, d).where(F.dayofmonth("date").isin(1, 11, 21)).select("date", "regime")
    prices = P.panel_flag(s, d)
    # what holds on a date holds for all its assets: as of by date first, then an equi-join
    days = prices.select(F.lit("all").alias("u"), "date").distinct()
    joined = prices.join(J.asof_join(days, pub.withColumn("u", F.lit("all")), ("u",), "regime").drop("u"), "date")
    return joined.select("asset", "date", "close", F.coalesce("regime", F.lit(-1)).alias("regime"))


@query("""with ev as (select * from (values ('AF', date '1993-06-01', 0.5), ('AF', date '1994-06-01', 0.9), ('NO', date '1996-01-01', 2.0)) t(asset, event_date, factor))
    select p.asset, p.date, round(coalesce(product(ev.factor::double), 1.0), 8) as factor, round(p.close * coalesce(product(ev.factor::double), 1.0), 6) as adjusted
    from pan p left join ev on p.asset = ev.asset and p.date < ev.event_date group by p.asset, p.date, p.close""")
def reanchor_range_join(s, d):
    """Prices before corporate actions times their factors."""
    ev = s.sql("select * from values ('AF', date'1993-06-01', 0.5D), ('AF', date'1994-06-01', 0.9D), ('NO', date'1996-01-01', 2.0D) t(asset, event_date, factor)")
    return J.reanchor(P.panel_flag(s, d), ev).select("asset", "date", F.round("factor", 8).alias("factor"), F.round("adjusted", 6).alias("adjusted"))


@query("select asset, date, case when day(date) = 1 then round(close * 2, 6) else close end as close from pan")
def upsert_latest_bar(s, d):
    """Later rows replace earlier ones with the same key."""
    p = P.panel_flag(s, d)
    return J.upsert(p, p.where(F.dayofmonth("date") == 1).withColumn("close", F.round(F.col("close") * 2, 6)))


@query("select distinct p_brand as asset from part where p_brand not in (select p_brand from part join lineitem on l_partkey = p_partkey where l_shipdate >= timestamp '1998-01-01' group by 1 having count(*) > 120)")
def dropped_assets(s, d):
    """Anti join: brands without enough recent bars."""
    part = P.table(s, d, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    recent = P.table(s, d, "lineitem").where("l_shipdate >= timestamp'1998-01-01'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    good = recent.groupBy("asset").count().where("count > 120")
    return part.select("asset").distinct().join(good, "asset", "left_anti")


@query("""with a as (select asset, count(*)::double as n1 from rets where r > 0.02 group by 1), b as (select asset, count(*)::double as n2 from rets where r < -0.02 group by 1)
    select coalesce(a.asset, b.asset) as asset, coalesce(n1, 0.0) as n1, coalesce(n2, 0.0) as n2 from a full join b on a.asset = b.asset""")
def outer_join_default(s, d):
    """Outer join with zeros for what is missing."""
    r = _rets(s, d)
    n = lambda c, name: r.where(c).groupBy("asset").agg(F.count(F.lit(1)).cast("double").alias(name))
    return J.full_outer_default(n("r > 0.02", "n1"), n("r < -0.02", "n2"), ("asset",))


@query("""with c as (select a, b, round(corr(x, y), 8) as rho from pr group by 1, 2), bins as (select (i * 0.05)::double as centre, i as band from range(-20, 21) t(i))
    select a, b, rho, band from c left join bins on floor(rho / 0.05::double + 0.5) = floor(centre / 0.05::double + 0.5)""")
def nearest_bin_lookup(s, d):
    """Pairs looked up in a table of correlation bins."""
    c = Q.pair_correlation(_rets(s, d)).select("a", "b", F.round("corr", 8).alias("rho"))
    bins = s.range(-20, 21).select((F.col("id") * 0.05).alias("centre"), F.col("id").alias("band"))
    return J.nearest_bin(c, "rho", bins, "centre", 0.05).select("a", "b", "rho", "band")


@query("""with x as (select *, (row_number() over (partition by asset order by date) - 1) * 50 // count(*) over (partition by asset) as b from rets),
    y as (select *, row_number() over (partition by asset, b order by close, date) as lo, row_number() over (partition by asset, b order by close desc, date) as hi, row_number() over (partition by asset, b order by date desc) as la from x)
    select asset, date, close from y where lo = 1 or hi = 1 or la = 1""")
def decimated_series(s, d):
    """Plot points that keep minima, maxima and last values."""
    return J.decimate(_rets(s, d), "close", 50).select("asset", "date", "close")


# ---- pairs and covariance


@query("select a, b, count(*) as n, round(corr(x, y), 6) as corr from pr group by 1, 2")
def pair_correlation(s, d):
    """Correlation of every pair."""
    return rnd(Q.pair_correlation(_rets(s, d)))


@query("with c as (select a, b, round(corr(x, y), 8) as corr from pr group by 1, 2) select a, b, corr from c order by corr desc, a desc, b desc limit 5")
def top_pairs(s, d):
    """The five most correlated pairs."""
    return Q.top_pairs(_rets(s, d), 5).select("a", "b", "corr")


@query("""with x as (select p.date, p.asset as a, q.asset as b, ln(p.close) as x, ln(q.close) as y from pan p join pan q on p.date = q.date and p.asset < q.asset),
    f as (select *, covar_pop(x, y) over w / var_pop(y) over w as beta, avg(x) over w as mx, avg(y) over w as my from x window w as (partition by a, b)),
    e as (select *, round(x - (mx - beta * my) - beta * y, 10) as e from f),
    l as (select *, lag(e) over (partition by a, b order by date) as e1 from e),
    s as (select a, b, max(beta) as beta, count(*) as n, sum(e1 * e1) as sxx, sum(e1 * (e - e1)) as sxy, sum((e - e1) * (e - e1)) as syy from l where e1 is not null group by 1, 2)
    select a, b, round(beta, 5) as beta, round((sxy / sxx) / sqrt(((syy - sxy / sxx * sxy) / (n - 1)) / sxx), 4) as tstat from s""")
def adf_tstat(s, d):
    """Unit-root statistic of the residual of every pair."""
    return Q.adf_tstat(P.panel_flag(s, d)).select("a", "b", F.round("beta", 5).alias("beta"), F.round("tstat", 4).alias("tstat"))


@query("""with r as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from pr)
    select a, b, round(corr(rx, ry), 6) as spearman, round(2 * sin(pi() * corr(rx, ry) / 6), 6) as gauss_rho from r group by 1, 2""")
def spearman_pairs(s, d):
    """Rank correlation of every pair."""
    return rnd(Q.spearman_pairs(_rets(s, d)))


@query("""with q as (select a, b, quantile_cont(x, 0.05) as qx, quantile_cont(y, 0.05) as qy from pr group by 1, 2)
    select a, b, round(avg((x <= qx and y <= qy)::int::double) / 0.05, 6) as lower_tail from pr join q using (a, b) group by 1, 2""")
def tail_dependence(s, d):
    """Joint lower-tail frequency of every pair."""
    return rnd(Q.tail_dependence(_rets(s, d)))


@query("""with q as (select a, b, quantile_cont(x, 0.1) as lx, quantile_cont(y, 0.1) as ly, quantile_cont(x, 0.9) as hx, quantile_cont(y, 0.9) as hy from pr group by 1, 2),
    s as (select a, b, count(*) filter (x <= lx and y <= ly) as n_lo, count(*) filter (x >= hx and y >= hy) as n_hi, corr(x, y) filter (x <= lx and y <= ly) as c1, corr(x, y) filter (x >= hx and y >= hy) as c2 from pr join q using (a, b) group by 1, 2)
    select a, b, n_lo, n_hi, round(case when n_lo > 10 and n_hi > 10 then c1 - c2 end, 5) as asymmetry from s""")
def exceedance_asymmetry(s, d):
    """Lower less upper tail correlation of every pair."""
    return rnd(Q.exceedance_asymmetry(_rets(s, d)), 5)


_COV = """z as (select *, row_number() over (partition by asset order by date desc) as rn from rets), zz as (select *, rn - 1 as age from z where rn <= 252),
    pz as (select p.asset as a, q.asset as b, power(0.5::double, p.age / 63::double) as w, p.r as x, q.r as y from zz p join zz q on p.date = q.date and p.asset <= q.asset),
    cv as (select a, b, sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w) as cov from pz group by 1, 2)"""


@query(f"with {_COV} select a, b, round(cov, 10) as cov from cv")
def ewma_cov_pairs(s, d):
    """Exponentially weighted covariance matrix as pair rows."""
    return rnd(Q.ewma_cov(_rets(s, d)), 10)


@query(f"""with {_COV}, v as (select a as k, cov as v from cv where a = b), x as (select cv.*, p.v as va, q.v as vb from cv join v p on p.k = cv.a join v q on q.k = cv.b),
    m as (select avg(cov / sqrt(va * vb)) as rho from x where a < b) select a, b, round(cov, 10) as cov, round(case when a = b then va else rho * sqrt(va * vb) end, 10) as target from x, m""")
def const_corr_target(s, d):
    """Constant-correlation target of the shrinkage."""
    return rnd(Q.constant_correlation(Q.ewma_cov(_rets(s, d))), 10)


@query("""with z as (select *, row_number() over (partition by asset order by date desc) as age from rets), y as (select asset, date, r - avg(r) over (partition by asset) as d from z where age <= 252),
    p as (select u.asset as a, t.asset as b, u.d * t.d as xy from y u join y t on u.date = t.date and u.asset <= t.asset),
    s as (select a, b, avg(xy) as cov, var_pop(xy) as pi, count(*) as t from p group by 1, 2), v as (select a as k, cov as v from s where a = b),
    x as (select s.*, m.v as va, n.v as vb from s join v m on m.k = s.a join v n on n.k = s.b), rho as (select avg(cov / sqrt(va * vb)) as rho from x where a < b),
    g as (select *, cov - case when a = b then va else rho * sqrt(va * vb) end as gap, case when a = b then 1 else 2 end as m from x, rho),
    h as (select sum(m * pi) as pi, sum(m * gap * gap) as gamma, max(t) as t from g)
    select round(pi * 1e8, 4) as pi, round(gamma * 1e8, 4) as gamma, round(least(greatest(pi / (gamma * t), 0.0), 1.0), 6) as delta from h""")
def lw_intensity(s, d):
    """Shrinkage intensity of the last 252 rows."""
    return Q.shrinkage_intensity(_rets(s, d)).select(F.round(F.col("pi") * 1e8, 4).alias("pi"), F.round(F.col("gamma") * 1e8, 4).alias("gamma"), F.round("delta", 6).alias("delta"))
