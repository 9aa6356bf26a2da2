"""DuckDB texts of model, study, stream and ledger queries whose recursions have closed forms or plain SQL."""

from __future__ import annotations

from ..operators.laws import LAGS, QS
from . import t1, t1b  # noqa: F401  (registers the texts that are joined here)

_N = "x as (select *, row_number() over (partition by asset order by date) as k from rets)"


def _ewm(value: str, decay: str, order: str = "partition by asset order by date") -> dict[str, str]:
    """Sums of the exponentially weighted recursion as window sums: each term is scaled by its own age."""
    total = lambda v, d: f"power({d}, k) * sum({v} / power({d}, k)) over ({order})"
    return {"s0": total("1", decay), "s1": total(value, decay), "s2": total(f"{value} * {value}", decay), "q": total("1", f"({decay} * {decay})")}


_D21 = "power(0.5::double, 1 / 21::double)"
_M = _ewm("r", _D21)
_EWM_COLS = f"{_M['s0']} as s0, {_M['s1']} as s1, {_M['s2']} as s2, {_M['q']} as q"
_STD = "case when s0 * s0 - q > 1e-12 then sqrt(greatest((s2 / s0 - s1 / s0 * s1 / s0) * s0 * s0 / (s0 * s0 - q), 0)) end"
_VALUES = lambda xs, kind: ", ".join(f"({x!r}::{kind})" for x in xs)

_WINDOWS = f"""v as (select asset, 0.5 * ln(gk_var) as l, row_number() over (partition by asset order by date) as rn from gk where gk_var is not null),
    w0 as (select asset, w, l, rn from (select *, unnest([(rn - 1) // 500, (rn - 1) // 500 - 1]) as w from v) where w >= 0),
    w1 as (select *, row_number() over (partition by asset, w order by rn) as i, count(*) over (partition by asset, w) as n from w0),
    w2 as (select * from w1 where n >= 1000),
    m as (select a.asset, a.w, d, q, avg(power(abs(b.l - a.l), q)) as m from w2 a cross join (values {_VALUES(LAGS, 'int')}) t(d) join w2 b on b.asset = a.asset and b.w = a.w and b.i = a.i + d
      cross join (values {_VALUES(QS, 'double')}) u(q) group by 1, 2, 3, 4),
    z as (select asset, w, q, regr_slope(ln(m), ln(d)) as zeta from m where m > 0 group by 1, 2, 3),
    h as (select asset, w, sum(q * zeta) / sum(q * q) as hurst from z group by 1, 2)"""

_SX = "sx as (select *, r / sqrt(gk_var) as z0, avg(gk_var) over (partition by date) as mv from gr), sy as (select *, round(z0, 8) as z, round(r / sqrt(mv), 8) as zm from sx)"
_TRIM = "(select asset, kurtosis(v) as {n} from (select asset, {c} as v from (select asset, {c}, avg({c}) over (partition by asset) as m, stddev_samp({c}) over (partition by asset) as sd from sy where {c} is not null) where abs({c} - m) < 12 * sd) group by 1)"

TEXTS = {
    "ewma_riskmetrics": f"""with {_N}, f as (select asset, avg(r * r) as s0 from x where k <= 20 group by 1)
        select asset, date, round(power(0.94::double, k) * (s0 + 0.06::double * sum(r * r / power(0.94::double, k)) over (partition by asset order by date)), 10) as s2 from x join f using (asset)""",
    "ewma_stream": f"""with {_N} select asset, date, round(power(0.94::double, k) * sum(case when k = 1 then r * r / 0.94::double else 0.06::double * r * r / power(0.94::double, k) end) over (partition by asset order by date), 10) as s2 from
        (select asset, date, r, k - 1 as k0, k from x)""",
    "ewm_vol": f"with {_N}, e as (select asset, date, k, {_EWM_COLS} from x) select asset, date, round(s1 / s0, 8) as ewm_mean, round({_STD}, 8) as ewm_std from e",
    "exposure_full": f"""with x0 as (select date, r, row_number() over (order by date) as k, 'flag' as asset from mkt), b0 as (select date, quantile_cont(r, 0.05) over f as q, list(r) over f as a, exp(sum(ln(1 + r)) over (order by date)) as nav
          from x0 window f as (order by date rows between 251 preceding and current row)),
        b1 as (select date, case when len(a) >= 50 then -list_avg(list_filter(a, lambda v: v <= q)) end as cvar, nav / max(nav) over (order by date) - 1 as dd from b0),
        b2 as (select date, least(case when cvar > 0 then least(1.0, greatest(0.25, 0.02 / cvar)) else 1.0 end, least(1.0, greatest(0.25, 1 - 0.75 * (-dd - 0.05) / 0.10))) as brake from b1),
        e as (select date, k, {_EWM_COLS} from x0), l as (select date, k, {_STD} * sqrt(252::double) as vol from e),
        v as (select date, k, case when vol > 0 then least(0.13 / vol, 1.5) else 1.0 end as lever, brake from l join b2 using (date)),
        s as (select date, lever, list(lever * brake) over (order by k rows between 149 preceding and current row) as a from v),
        t as (select date, lever, list_sum(list_transform(a, lambda y, i: y * power(2 / 3::double, len(a) - i))) / list_sum(list_transform(a, lambda y, i: power(2 / 3::double, len(a) - i))) as m from s)
        select 'flag' as u, date, round(lever, 6) as lever, round(least(greatest(m, 0.0), 1.5), 6) as exposure from t""",
    "subwindow_hurst": f'with {_WINDOWS} select asset, w::int as "window", round(hurst, 6) as hurst from h',
    "study_rough": f"""with {_WINDOWS}, p as (select asset, round(quantile_cont(hurst, 0.25), 6) as q25, round(quantile_cont(hurst, 0.5), 6) as median, round(quantile_cont(hurst, 0.75), 6) as q75 from h group by 1)
        select * from p join ({t1.ORACLE['hurst_scaling']}) using (asset)""",
    "market_clock": f"with {_SX} select asset, round(a.kurt_raw, 5) as kurt_raw, round(b.kurt_market, 5) as kurt_market, round(c.kurt_own, 5) as kurt_own from {_TRIM.format(c='r', n='kurt_raw')} a join {_TRIM.format(c='zm', n='kurt_market')} b using (asset) join {_TRIM.format(c='z', n='kurt_own')} c using (asset)",
    "regime_features_range": """with m as (select date, avg(gk_var) as v from gk where gk_var is not null group by 1), j as (select date, r, count(v) over w as n, avg(v) over w as v from mkt join m using (date) window w as (order by date rows between 9 preceding and current row))
        select 'flag' as u, date, r, round(ln(greatest(sqrt(v * 252), 1e-4)), 8) as logvol from j where n >= 5""",
    "bounded_asof": """with d as (select date, row_number() over (order by date) as k from (select distinct date from rets)), p as (select d.k, regs.date, regime from regs join d using (date) where day(regs.date) = 1)
        select d.date, coalesce(case when d.k - p.k <= 5 then regime end, -1)::int as regime from d asof left join p on d.date >= p.date""",
    "ledger_emit": """with b as (select date, count(distinct asset) as n from bars group by 1), c as (select unnest(generate_series((select min(date) from b), (select max(date) from b), interval 1 day)) as date)
        select c.date::timestamp as date, case when coalesce(n, 0) >= 4 then 'LIVE' else 'GAP' end as status, (case when coalesce(n, 0) >= 4 then n else -1 end)::int as assets from c left join b on b.date = c.date""",
    "ledger_stream": """select date::timestamp as date, case when n >= 6 then 'LIVE' else 'GAP' end as status, (case when n >= 6 then n else -1 end)::int as assets
        from (select date, count(distinct asset) as n from bars where date >= timestamp '1998-06-01' group by 1)""",
    "idempotent_stream": "select asset, date::timestamp as date, close from bars",
    "wide_csv_round_trip": "select asset, date::timestamp as date, close from bars",
    "genesis_round_trip": "select asset, date::timestamp as date, round(case when asset = 'AF' and date < timestamp '1996-01-01' then close * 0.5 else close end, 4) as close from bars",
    "tumbling_bars_stream": """with w as (select event_type as asset, time_bucket(interval 7 days, ts, timestamp '1970-01-01') as date, ts, value from events)
        select asset, date, first(value order by ts, value) as open, max(value) as high, min(value) as low, last(value order by ts, value) as close, count(*) as n from w
        where date + interval 7 days <= (select max(ts) - interval 1 day from events) group by 1, 2""",
    "hedge_ensemble": """with recursive n as materialized (select date, row_number() over (order by date) as k from (select distinct date from rets)),
        a as materialized (select distinct asset from rets),
        g as materialized (select n.k, n.date, list(coalesce(r, 0.0) order by a.asset) as g from n cross join a left join rets on rets.date = n.date and rets.asset = a.asset group by 1, 2),
        c as materialized (select greatest(avg(abs(v)), 1e-9) as c from (select unnest(g) as v from g where k <= 63)),
        s as materialized (select k, list_transform(g, lambda v: exp(0.05::double * (v - top) / scale)) as e from (select k, g, list_max(g) as top, c.c as scale from g, c)),
        w as (select 1::bigint as k, list_transform(g, lambda v: 1.0::double / len(g)) as w from g where k = 1
          union all select w.k + 1, list_transform(list_transform(range(1, len(s.e) + 1), lambda i: w.w[i] * s.e[i]), lambda p: 0.995::double * p / list_sum(list_transform(range(1, len(s.e) + 1), lambda j: w.w[j] * s.e[j])) + 0.005::double / len(s.e))
          from w join s on s.k = w.k)
        select 'all' as u, g.date, round(list_max(w.w), 7) as top, round(list_sum(list_transform(range(1, len(g.g) + 1), lambda i: w.w[i] * g.g[i])), 9) as r from w join g on g.k = w.k""",
}


def joined(names: tuple[str, ...]) -> str:
    """Several registered texts joined by asset."""
    parts = [f"({t1.ORACLE[n]})" for n in names]
    return f"select * from {parts[0]} " + " ".join(f"join {p} using (asset)" for p in parts[1:])


LAWS, SURGE = ("kurtosis_law", "deformed_kurtosis", "mrw_lambda2"), ("cascade_moments", "zumbach_stat", "leverage_effect")


def oracle() -> dict[str, str]:
    return {k: t1.full_sql(v) for k, v in TEXTS.items()} | {"study_laws": joined(LAWS), "study_surge": joined(SURGE)}
