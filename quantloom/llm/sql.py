"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality import CHARS, COMMON

_WORDS = r"case when length(regexp_replace({t}, '[\x20\x09-\x0D]+', '', 'g')) = 0 then []::varchar[] else list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda w: w <> '') end"

OP2 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length('<turn>') + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n')) + 1
  + length(replace(replace(text, '\', '\\'), '<', '\l')) + length('</turn>') + 1 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from e group by 1
"""

OP3 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
g as (select * from v where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
l as (select a.vec_id as i, b.vec_id as j from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as i, vec_id as c from v union select l.j, r.c from r join l on l.i = r.i),
k as (select i, min(c) as c from r group by 1), n as (select i, count(*) as n from l group by 1)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, k.c as component_id, v.vec_id = k.c as kept from v left join n on n.i = v.vec_id left join k on k.i = v.vec_id
"""


def _op6(rules: dict[str, str], order: int = 4, mass: float = 2.0, alphabet: int = 256) -> str:
    fits = []
    for rule in sorted(rules, key=lambda r: (len(r), r), reverse=True):
        name, _, rest = rule.partition("/")
        fits.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}') then '{rule}'")
    said = " ".join(f"when rule = '{r}' then '{v}'" for r, v in rules.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts, good, bad, joins = [], f"{1 / alphabet!r}", f"{1 / alphabet!r}", ""
    for k in range(order + 1):
        at = order + 1 - k
        parts.append(f"t{k} as (select substr(g, {at}, {k + 1}) as t, sum(n_good) as a, sum(n_bad) as b from gr group by 1), c{k} as (select substr(g, {at}, {k}) as t, sum(n_good) as a, sum(n_bad) as b from gr group by 1)")
        joins += f" join t{k} on t{k}.t = substr(g, {at}, {k + 1}) join c{k} on c{k}.t = substr(g, {at}, {k})"
        good = f"((t{k}.a + {mass} * {good}) / (c{k}.a + {mass}))"
        bad = f"((t{k}.b + {mass} * {bad}) / (c{k}.b + {mass}))"
    return f"""
with r0 as (select page_id, coalesce(url, '') as u, instr(coalesce(url, ''), '://') as mark from pages),
r1 as (select page_id, u, case when mark > 0 then split_part(split_part(substr(u, mark + 3), '?', 1), '#', 1) else '' end as b from r0),
p0 as (select page_id, u, translate(split_part(b, '/', 1), '{upper}', '{lower}') as host, substr(b, length(split_part(b, '/', 1)) + 1) as path from r1),
p1 as (select *, case {" ".join(fits)} end as rule from p0), p2 as (select *, case {said} end as said from p1),
us as (select u, md5(u) < '4' as held, count(*) filter (said = 'allow') as n_good, count(*) filter (said = 'block') as n_bad from p2 group by 1),
fl as (select u, held, n_good, n_bad, substr(repeat(chr(2), {order}) || u, i::int, {order + 1}) as g from us, lateral (select unnest(range(1, length(u) + 1)) as i)),
gr as (select g, coalesce(sum(n_good) filter (not held), 0)::double as n_good, coalesce(sum(n_bad) filter (not held), 0)::double as n_bad from fl group by 1), {", ".join(parts)},
sc as (select g, ln({good}) - ln({bad}) as s from gr{joins}),
sd as (select u, held, n_good, n_bad, round(sum(s) / count(*), 6) as score from fl join sc using (g) group by 1, 2, 3, 4),
w0 as (select coalesce(sum(n_good) filter (held), 0) > 0 and coalesce(sum(n_bad) filter (held), 0) > 0 as enough from sd),
w1 as (select floor(score * 100) as k, sum(n_good) as good, sum(n_bad) as bad from sd, w0 where n_good + n_bad > 0 and (held or not enough) group by 1),
w2 as (select k, coalesce(lag(k) over (order by k) + 1, k) as low, sum(good) over () as g, sum(bad) over () as b, coalesce(sum(good) over (order by k rows between unbounded preceding and 1 preceding), 0) as lg,
  coalesce(sum(bad) over (order by k rows between unbounded preceding and 1 preceding), 0) as lb from w1),
lim as (select (low + k) / 200 as t from w2 where g > 0 and b > 0 order by lb * g - lg * b desc, k limit 1)
select page_id, host, path, rule, coalesce(said, case when (select t from lim) is null then 'allow' when coalesce(score, 0) < (select t from lim) then 'block' else 'allow' end) as verdict
from p2 left join sd using (u)
"""


def _op7() -> str:
    listed = ", ".join(f"('{lang}', {k}, '{w}')" for lang, ws in COMMON.items() for k, w in enumerate(ws))
    count = lambda c: f"length(o) - length(regexp_replace(o, '[{c}]', '', 'g'))"
    classes = ", ".join(f"{count(c.replace(chr(92) + chr(34), chr(34)).replace(chr(39), chr(39) * 2))} as {n}" for n, c in CHARS.items())
    half = lambda x, y: f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"
    return rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, {_WORDS.format(t="coalesce(text, '')")} as w, regexp_replace(coalesce(text, ''), '[a-z \n]+', '', 'g') as o from documents),
b as (select doc_id, lang, t, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {classes},
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines from d),
g as (select doc_id, i, w[i:i+4] as g from b, lateral (select unnest(range(1, greatest(n_words - 3, 1))) as i)),
h as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
rp as (select doc_id, count(distinct i + k) as n from h, range(5) q(k) group by 1),
f as (select b.doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rp.n, 0) as n_repeat_words, length(t) - word_chars as space, upper, digit, punct, word_chars - upper - digit - punct - n_symbols as rest from b left join rp using (doc_id)),
cl as (select doc_id, lang, n_words, unnest([0, 1, 2, 3, 4, 5]) as k, unnest([space, upper, digit, punct, n_symbols, rest]) as n, word_chars + space as tot from f),
cr as (select lang, k, sum(n) / sum(sum(n)) over (partition by lang) as q from cl group by 1, 2),
cd as (select doc_id, n_words, sqrt(greatest(0, sum({half("p", "q")} + {half("q", "p")}) / 2)) as dist from (select doc_id, n_words, coalesce(n / nullif(tot, 0), 0) as p, coalesce(q, 0) as q from cl join cr using (lang, k)) group by 1, 2),
cw(lang, k, word) as (values {listed}),
uw as (select doc_id, lang, unnest(w) as word from b),
wc as (select doc_id, cw.lang, k, count(*) as n from uw join cw on cw.lang = uw.lang and cw.word = uw.word group by 1, 2, 3),
wl as (select f.doc_id, f.lang, f.n_words, cw.k, coalesce(wc.n, 0) as n from f join cw on cw.lang = f.lang left join wc on wc.doc_id = f.doc_id and wc.k = cw.k
  union all select f.doc_id, f.lang, f.n_words, 99, f.n_words - coalesce((select sum(n) from wc where wc.doc_id = f.doc_id), 0) from f where f.lang in (select lang from cw)),
wr as (select lang, k, sum(n) / sum(sum(n)) over (partition by lang) as q from wl group by 1, 2),
wd as (select doc_id, sqrt(greatest(0, sum({half("p", "q")} + {half("q", "p")}) / 2)) as dist from (select doc_id, coalesce(n / nullif(n_words, 0), 0) as p, coalesce(q, 0) as q from wl join wr using (lang, k)) group by 1),
a as (select f.*, case when f.n_words >= 50 then round(cd.dist, 9) end as char_distance, case when f.n_words >= 100 then round(wd.dist, 9) end as word_distance,
  f.n_words < 10 or 100 * n_repeat_words > 20 * f.n_words as base_failed from f left join cd using (doc_id) left join wd using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  round(char_distance, 6) as char_distance, round(word_distance, 6) as word_distance, not base_failed and not coalesce(char_distance > 0.3, false) and not coalesce(word_distance > 0.28, false) as kept from a
"""


OP8 = rf"""
with recursive d as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, case when len(w) < 4 then w else w[i:i+3] end as s from d, lateral (select unnest(range(1, greatest(1, len(w) - 3) + 1)) as i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
x as (select a.doc_id as i, b.doc_id as j, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select i, j from x join n p on p.doc_id = i join n q on q.doc_id = j where 100 * c >= 80 * (p.n + q.n - c)), b as (select i, j from l union all select j, i from l),
r as (select doc_id as i, doc_id as c from d union select b.j, r.c from r join b on b.i = r.i),
k as (select i, min(c) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, k.c as component_id, d.doc_id = k.c as kept from d left join n using (doc_id) left join k on k.i = d.doc_id
"""


def oracle(rules: dict[str, str]) -> dict[str, str]:
    return {
        "op2_chat_format": OP2,
        "op3_embedding_dedup": OP3,
        "op6_url_filter": _op6(rules),
        "op7_quality_rules": _op7(),
        "op8_minhash": OP8,
    }
