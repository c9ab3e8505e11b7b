"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from . import chat, licences, reputation

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alnum(text: str) -> str:
    return f"coalesce(regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), '{_ALNUM}'), [])"


OP1 = rf"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
classes as (select list_sort(s) as s, min(doc_id) as rep, len(any_value(s)) as n from s where len(s) > 0 group by 1),
e as (select rep, n, unnest(s) as g from classes),
links as (select a.rep as x, b.rep as y from e a join e b on a.g = b.g and a.rep <> b.rep and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select rep as x, rep as y from classes union select r.x, l.y from reach r join links l on r.y = l.x),
comp as (select x, min(y) as c from reach group by x)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(comp.c, s.doc_id) as component_id,
  s.doc_id = coalesce(comp.c, s.doc_id) as kept
from s left join classes on list_sort(s.s) = classes.s left join comp on comp.x = classes.rep
"""

OP2 = f"""
with d as (select doc_id, {_alnum('text')} as w from documents),
b as (select item_id, {_alnum('text')} as w from benchmark),
pat as (select distinct item_id, least(len(w), 10) as m,
  unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) as p
  from b where len(w) > 0),
lens as (select distinct m from pat),
pos as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as p
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lens where len(w) >= m)),
occ as (select pos.doc_id, pos.i, pos.m, pat.item_id from pos join pat on pos.p = pat.p and pos.m = pat.m),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + m)) as k from occ) group by 1),
it as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct doc_id, item_id from occ) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(hit.n_hit, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items,
  sha256(coalesce(it.ids, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op3() -> str:
    # One letter per known sentence, a blank for any other; rules are alternatives in order.
    letters = {name: chr(65 + i) for i, name in enumerate(licences.SENTENCES)}
    known = " ".join(
        f"when {_quoted(licences.normalise(s).decode())} then '{letters[n]}'" for n, s in licences.SENTENCES.items()
    )
    run = ["".join(letters[n] for n in names) for _, names in licences.RULES]
    to = " ".join(f"when '{r}' then {_quoted(name)}" for (name, _), r in zip(licences.RULES, run))
    return rf"""
with s as (select doc_id, list_filter([array_to_string(regexp_extract_all(translate(x, '{_UP}', '{_LOW}'), '{_ALNUM}'), ' ')
  for x in regexp_split_to_array(coalesce(text, ''), '[.!?][ \t]+|[\r\n]+')], lambda x: x <> '') as s from documents),
k as (select doc_id, len(s) as n, array_to_string([case x {known} else ' ' end for x in s], '') as ids from s),
m as (select doc_id, n, [case x {to} end for x in regexp_extract_all(ids, '{"|".join(run)}')] as m from k)
select doc_id, n::bigint as n_sentences, len(m)::bigint as n_matches,
  coalesce(array_to_string(list_sort(list_distinct(m)), ','), '') as licences from m
"""


def _op4() -> str:
    rules = sorted(reputation.RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in rules]
    name = " ".join(f"when {f} then '{r.name}'" for f, r in zip(fits, rules))
    verdict = " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, rules))
    low, high = reputation.STRENGTH
    k = f"""case when extra > 0 then greatest({low}, least({high}, (rate * (1 - rate) - extra) / extra)) else {high} end"""

    def strength(groups: str) -> str:
        return f"""(select {k} from (select rate, spread - rate * (1 - rate) * g / n as extra from (
          select sum(n)::double as n, count(*) filter (n > 0) as g, sum(bad) / sum(n)::double as rate,
          sum(case when n > 0 then bad * bad / n::double end) / sum(n) - (sum(bad) / sum(n)::double) ^ 2 as spread from {groups})))"""

    return rf"""
with u as (select page_id, url, strpos(url, '://') as cut from pages),
r as (select page_id, case when cut > 0 then substr(url, cut + 3) else '' end as rest from u),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
lab as (select doc_id, min(quality) as q from labels group by 1),
o as (select host, case q when 0 then 1 when 1 then 0 end as bad from p left join lab on page_id = doc_id),
h as (select host, regexp_replace(host, '\.*(:[0-9]*)?$', '') as name, string_split(name, '.') as parts,
  array_to_string(parts[-2:], '.') as two, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') or starts_with(name, '[') as address,
  count(bad) as n, coalesce(sum(bad), 0) as bad from o group by host),
hosts as (select host, case when address then name when two in {reputation.SUFFIXES} then array_to_string(parts[-3:], '.') else two end as domain,
  case when address then '' when two in {reputation.SUFFIXES} then two else parts[-1] end as suffix, n, bad from h),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by 1),
ks as (select {strength('hosts')} as kh, {strength('domains')} as kd, {strength('suffixes')} as kx,
  (select (sum(bad) + {reputation.BAD_RATE * low}) / (sum(n) + {low}) from suffixes) as rate),
sx as (select suffix, (bad + rate * kx) / (n + kx) as mean from suffixes, ks),
dm as (select domain, (bad + sx.mean * kd) / (n + kd) as mean from domains join sx using (suffix), ks),
post as (select host, bad + dm.mean * kh as a, n - bad + (1 - dm.mean) * kh as b from hosts join dm using (domain), ks),
bound as (select host, a / (a + b) as m, a / (a + b) - {reputation.Z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) as low from post)
select page_id, host, path, case {name} end as rule,
  coalesce(case {verdict} end, case when low > {reputation.BAD_RATE} then 'block' else 'allow' end) as verdict
from p left join bound using (host)
"""


def _op8() -> str:
    t = chat.CHAT
    esc = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)({t.rests})', '\1\\\2\3', 'g')"
    marks = len(t.opening) + len(t.after_role) + len(t.closing)
    valid = r"^(system,)?(user,assistant,)+$"
    return rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({marks} + length({esc('role')}) + length({esc('text')}))::bigint as formatted_chars,
  regexp_matches(string_agg(role || ',', '' order by turn, role, text), '{valid}') as valid
from t group by conv_id
"""


OP11 = rf"""
with p as (select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as g
  from w, (select unnest(range(1, 5)) as k) where len(w) >= k),
f as (select lang, k, g, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
c as (select lang, k, g, a, string_split(g, ' ') as w from f where k > 1 and a >= 30),
cut as (select *, unnest(range(1, k)) as first from c),
s as (select cut.lang, cut.k, cut.g, cut.a, first, l.a as l, r.a as r, (2000000::hugeint * cut.a) // (l.a::hugeint + r.a) as score
  from cut join f l on l.lang = cut.lang and l.k = first and l.g = array_to_string(w[:first], ' ')
  join f r on r.lang = cut.lang and r.k = cut.k - first and r.g = array_to_string(w[first + 1:], ' ')
  qualify row_number() over (partition by cut.lang, cut.g order by score, first) = 1),
inside as (select lang, a, array_to_string(w[i:i + m - 1], ' ') as g from
  (select lang, a, w, m, unnest(range(1, k - m + 2)) as i from c, (select unnest(range(2, 4)) as m) where m < k)),
dropped as (select distinct s.lang, s.g from s join inside using (lang, g) where 100 * inside.a::hugeint >= 80 * s.a::hugeint)
select lang, row_number() over (partition by lang order by score desc, a desc, g)::int as rank_, g, a, l, r, n, score
from s anti join dropped using (lang, g) join n using (lang)
qualify rank_ <= 2000
"""
OP11 = f"select lang, rank_::bigint as rank, g as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ({OP11})"

_TERMS = rf"coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
OP12 = f"""
with d as (select doc_id, {_TERMS} as w from documents),
b as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
st as (select count(*) as docs, sum(len(w))::bigint as terms from d where len(w) > 0),
tf as (select doc_id, n, t, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as t from d)
  where t in (select t from b) group by all),
wt as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as weight
  from (select t, count(*) as df from tf group by 1), st),
sc as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
  from b join tf using (t) join wt using (t), st group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from sc where score > 0 qualify rank <= 10
"""

ORACLES = {
    "op1_minhash_dedup": OP1,
    "op2_decontaminate": OP2,
    "op3_license_scans": _op3(),
    "op4_url_filters": _op4(),
    "op8_chat_formatting": _op8(),
    "op11_phrase_collocations": OP11,
    "op12_lexical_search": OP12,
}
