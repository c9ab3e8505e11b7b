"""SQL twins of the registered queries, for DuckDB on the same parquet views.

Built from common-table-expression pieces: cells, elements, fuzzy measures,
gram weights, scores, statistics.  Written apart from the engine: plain SQL
without its collapsing, pruning or closed forms.
"""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WRAP = "{}[]()\"'' "


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return (
        f"lower(regexp_replace(trim({strip(f'coalesce({x}, chr(32))')}, '{WRAP}'), '{WS}+', ' ', 'g'))"
    )


def tidy(x: str) -> str:
    """Normalising again what is normalised already only strips its ends."""
    return f"trim({x}, '{WRAP}')"


def esc(x: str) -> str:
    return f"regexp_replace({x}, '([^a-zA-Z0-9 \\x80-\\x{{10ffff}}])', '\\\\\\1', 'g')"


def delim_parts(n: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({n}, '[,|;/]+'), "
        f"lambda p: {tidy('p')}), lambda p: p <> '')"
    )


def is_wrapped(t: str) -> str:
    return (
        f"(length({t}) > 1 and ((left({t}, 1) = '{{' and right({t}, 1) = '}}') or "
        f"(left({t}, 1) = '[' and right({t}, 1) = ']') or (left({t}, 1) = '(' and right({t}, 1) = ')')))"
    )


def wrapped_parts(t: str) -> str:
    inner = strip(f"substring({t}, 2, length({t}) - 2)")
    return (
        f"list_transform(list_filter(list_transform(string_split({inner}, ','), "
        f"lambda p: {strip('p')}), lambda p: p <> ''), lambda p: {norm('p')})"
    )


def kind(t: str) -> str:
    return (
        f"case when {t} = '' then 'empty' when {is_wrapped(t)} then 'wrapped_list' "
        f"when regexp_matches({t}, '[,|;/]') then 'delimited_list' else 'single' end"
    )


def grams(x: str, n: int) -> str:
    return (
        f"list_transform(range(1, greatest(length({x}) - {n} + 2, 1)), lambda i: substring({x}, i, {n}))"
    )


def gram_list(x: str) -> str:
    return f"list_concat({grams(x, 3)}, list_concat({grams(x, 4)}, {grams(x, 5)}))"


def char_ngrams(x: str) -> str:
    return f"case when {x} = '' then [] when length({x}) < 3 then [{x}] else {grams(x, 3)} end"


def distinct_first(items: str) -> str:
    """Distinct items in first-seen order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def tokens(n: str) -> str:
    return f"regexp_extract_all({n}, '[a-z0-9]+')"


def share(a: str, b: str) -> str:
    return (
        f"case when len(list_distinct({a})) = 0 then 0.0 else "
        f"len(list_intersect(list_distinct({a}), list_distinct({b})))::double / len(list_distinct({a})) end"
    )


def words(x: str) -> str:
    return f"(case when {x} = '' then 0 else len(string_split({x}, ' ')) end)"


def is_long(x: str, chars: int, count: int) -> str:
    return f"({x} <> '' and (length({x}) >= {chars} or {words(x)} >= {count}))"


def is_short(x: str, chars: int, count: int) -> str:
    return f"({x} = '' or length({x}) <= {chars} or {words(x)} <= {count})"


def boundary(a: str, b: str) -> str:
    word = r"[\p{L}\p{N}_]"
    other = r"[^\p{L}\p{N}_]"
    return (
        f"({a} <> '' and regexp_matches({b}, "
        f"(case when regexp_matches({a}, '^{word}') then '(^|{other})' else '{word}' end) || {esc(a)} || "
        f"(case when regexp_matches({a}, '{word}$') then '($|{other})' else '{word}' end)))"
    )


def listlike(a: str, b: str) -> str:
    return f"regexp_matches({b}, '(^|[,|;/]) *' || {esc(a)} || ' *([,|;/]|$)')"


# ---- tables ---------------------------------------------------------------------------------

CUSTOMERS = """customers as (
  select c_custkey, c_name, c_mktsegment as seg, n_name
  from customer join nation on c_nationkey = n_nationkey)"""

DASH = """dash as (
  select c_custkey::varchar as id, c_custkey as key, seg as segment, c_name as name, n_name as nation
  from customers where c_custkey % 3 <> 0)"""

SRC = """src as (
  select c_custkey::varchar as id, '  "' || lower(seg) || '" ' as mkt,
    '[' || seg || ', ' || n_name || ']' as mkt_wrapped, seg || ' | ' || n_name as mkt_delim,
    'cust: ' || c_name as label, case when c_custkey % 7 <> 0 then n_name end as nat,
    'This account belongs to the ' || seg ||
    ' market and is served from the regional office that looks after long term contracts' as note
  from customers)"""

DASH_COLS = ["segment", "name", "nation"]
SRC_COLS = ["mkt", "mkt_wrapped", "mkt_delim", "label", "nat", "note"]


def long_cells(view: str, cols: list[str], name: str, key: str = "") -> str:
    rows = " union all ".join(
        f"select id{key}, {i} as ord, '{c}' as col, {c} as raw from {view}" for i, c in enumerate(cols)
    )
    return f"{name} as ({rows})"


def matching_tables() -> list[str]:
    return [
        CUSTOMERS,
        DASH,
        SRC,
        long_cells("dash", DASH_COLS, "dcells", ", key"),
        long_cells("src", SRC_COLS, "scells"),
    ]


PAIRS = """pairs as (
  select d.id, d.key, d.ord as d_ord, s.ord as s_ord, d.col as dashboard_col, s.col as source_col,
    d.raw as dv, s.raw as sv
  from dcells d join scells s on d.id = s.id
  where d.raw is not null and s.raw is not null)"""



def merged_value(x: str) -> str:
    """Merging turns null and blank cells into empty text, which counts."""
    return f"case when {x} is null or {strip(x)} = '' then '' else {x} end"


MERGED_PAIRS = PAIRS.replace(
    "d.raw as dv, s.raw as sv", f"{merged_value('d.raw')} as dv, {merged_value('s.raw')} as sv"
).replace("\n  where d.raw is not null and s.raw is not null", "")


def elements(mode: str) -> str:
    """Pairs with normal forms and element lists ``de`` and ``se``."""
    if mode == "plain":
        d, s = "[dn]", "[sn]"
    elif mode == "delim":
        d, s = (
            f"list_filter(case when len({delim_parts(n)}) = 0 then [{tidy(n)}] else {delim_parts(n)} end, lambda p: p <> '')"
            for n in ("dn", "sn")
        )
    else:

        def wrapped(t, n):
            parts = f"(case when {t} = '' then [] when {is_wrapped(t)} then {wrapped_parts(t)} else [{n}] end)"
            return (
                f"list_filter(list_transform(case when len({parts}) = 0 then [{n}] else {parts} end, "
                f"lambda p: {tidy('p')}), lambda p: p <> '')"
            )

        d, s = wrapped("dt", "dn"), wrapped("st", "sn")
    return f"""normal as (
  select dv, sv, {strip('dv')} as dt, {strip('sv')} as st, {norm('dv')} as dn, {norm('sv')} as sn
  from (select distinct dv, sv from pairs)),
els as (select *, {d} as de, {s} as se from normal),
duo as (
  select distinct a, b from (
    select a, unnest(se) as b from (select distinct unnest(de) as a, se from els)))"""


FUZZY = """sized as (
  select a, b, case when length(a) <= length(b) then a else b end as s,
    case when length(a) <= length(b) then b else a end as t from duo),
needle as (
  select distinct s from (
    select s from sized union all select t as s from sized where length(s) = length(t))
  where s <> ''),
masks as (
  select s, length(s)::bigint as m, ((1::bigint << length(s)::bigint) - 1) as full_mask,
    map_from_entries(list_transform(list_distinct(string_split(s, '')), lambda c: struct_pack(
      k := c, v := list_sum(list_transform(range(length(s)), lambda i:
        case when substring(s, i + 1, 1) = c then (1::bigint << i::bigint) else 0::bigint end))::bigint))) as spots
  from needle),
windows as (
  select a, b, s, t, substring(t, greatest(i, 0) + 1, least(i + length(s), length(t)) - greatest(i, 0)) as w
  from (select a, b, s, t, unnest(range(1 - length(s), length(t))) as i from sized where s <> '')
  union all
  select a, b, t, s, substring(s, greatest(i, 0) + 1, least(i + length(t), length(s)) - greatest(i, 0)) as w
  from (select a, b, s, t, unnest(range(1 - length(t), length(s))) as i
        from sized where s <> '' and length(s) = length(t))
  union all
  select a, b, s, t, t as w from sized where s <> ''),
lcs as (
  select s, w, m - bit_count(list_reduce(
      list_transform(string_split(w, ''), lambda c: coalesce(spots[c], 0)::bigint),
      lambda v, u: ((v + (v & u)) | (v - (v & u))) & full_mask, full_mask)::bigint) as l
  from (select distinct s, w from windows) join masks using (s)),
rated as (
  select a, b,
    max(2.0 * l / (length(a) + length(b))) filter (where w = t) as whole,
    max(2.0 * l / (length(s) + length(w))) filter (where length(w) <= length(s)) as part
  from windows join lcs using (s, w) group by a, b),
fuzzy as (
  select a, b,
    case when a = b then 1.0 else coalesce(whole, 0.0) end::double as fr,
    case when a = b then 1.0 else coalesce(part, 0.0) end::double as fp,
    case when a = '' and b = '' then 1.0
      else 1.0 - levenshtein(a, b)::double / greatest(length(a), length(b)) end as lev
  from duo left join rated using (a, b))"""


def corpus(policy: str) -> str:
    both = "select id, raw from dcells union all select id, raw from scells"
    common = "id in (select id from dash intersect select id from src)"
    if policy == "all_cells":
        return f"docs as (select {norm('raw')} as doc, count(*) as times from ({both}) where {strip('raw')} <> '' group by 1)"
    if policy == "common_cells":
        return f"docs as (select {norm('raw')} as doc, count(*) as times from ({both}) where raw <> '' and {common} group by 1)"
    ids = " union all select id, id as raw from dash" if policy == "common_distinct_with_id" else ""
    return (
        f"docs as (select distinct {norm('raw')} as doc, 1 as times from ({both}{ids}) "
        f"where {common} and lower({strip(chr(99) + 'oalesce(raw, chr(32))')}) <> 'nan')"
    )


VOCABULARY = f"""vocabulary as (
  select gram, sum(times)::bigint as df, ln((1.0 + (select sum(times) from docs)) / (1.0 + sum(times))) + 1.0 as idf
  from (select times, unnest(list_distinct({gram_list('doc')})) as gram from docs) group by gram)"""

COSINE = f"""terms as (
  select el, gram, count(*) as tf from (
    select el, unnest({gram_list('el')}) as gram from (select a as el from duo union select b from duo))
  group by el, gram),
weights as (
  select el, gram, tf * idf as w, sqrt(sum((tf * idf) * (tf * idf)) over (partition by el)) as size
  from terms join vocabulary using (gram)),
cosines as (
  select duo.a, duo.b, sum((x.w / x.size) * (y.w / y.size)) as cosine
  from duo join weights x on x.el = duo.a join weights y on y.el = duo.b and y.gram = x.gram
  group by duo.a, duo.b),
measured as (
  select a, b, fr, fp, lev, coalesce(cosine, 0.0) as tfidf
  from fuzzy left join cosines using (a, b))"""

BLEND = "0.25 * fp + 0.25 * fr + 0.20 * lev + 0.30 * tfidf"


def gate(boosts: list[float], loose: float, long_chars: int, short_chars: int, at: float) -> str:
    plain, sy, sn, ly, ln = boosts
    precision = "(case when contains(b, a) then length(a)::double / length(b) else 0.0 end)"
    long_b, short_a = is_long("b", long_chars, 15), is_short("a", short_chars, 4)
    return (
        f"case when not {long_b} then {plain} "
        f"when {short_a} then case when {precision} >= 0.4 or tfidf >= {at} or fp >= 0.9 then {sy} else {sn} end "
        f"else case when {precision} >= 0.2 or tfidf >= {at / 2} or fp >= {loose} then {ly} else {ln} end end"
    )


def guarded(long_chars: int, short_chars: int, at: float, equal_score: str | None, cap: float) -> str:
    exact = gate([0.40, 0.25, -0.20, 0.20, -0.10], 0.85, long_chars, short_chars, at)
    sub = gate([0.25, 0.15, -0.15, 0.10, -0.10], 0.80, long_chars, short_chars, at)
    inside = f"case when {boundary('a', 'b')} then {sub} else 0.0 end"
    if equal_score:
        full = f"case when a = b then {equal_score} else least(greatest({BLEND} + {inside}, 0.0), {cap}) end"
    else:
        full = f"least(greatest({BLEND} + case when a = b then {exact} else {inside} end, 0.0), {cap})"
    return f"(case when a = '' or b = '' then 0.0 else {full} end)::double"


HYBRID = (
    "(case when a = '' or b = '' then 0.0 when a = b then 1.0 when contains(b, a) then 0.95 "
    f"else least({BLEND}, 1.0) end)::double"
)

FLAG_EXACT = "(case when a = b and a <> '' then 1.0 else 0.0 end)"
FLAG_SUB = "(case when a <> '' and contains(b, a) then 1.0 else 0.0 end)"
FLAG_ITEM = f"(case when a <> '' and list_contains({delim_parts('b')}, a) then 1.0 else 0.0 end)"

ROWWISE = (
    f"least(greatest(0.3 * {FLAG_EXACT} + 0.3 * {FLAG_SUB} + 0.2 * {FLAG_ITEM} "
    "+ 0.1 * fp + 0.05 * fr + 0.05 * tfidf, 0.0), 1.0)::double"
)

UNIFIED_METRICS = {
    "exact": FLAG_EXACT,
    "substring": FLAG_SUB,
    "list_item": FLAG_ITEM,
    "token_containment": share(tokens("a"), tokens("b")),
    "char3_containment": share(f"({char_ngrams('a')})", f"({char_ngrams('b')})"),
    "rf_partial": "fp",
    "rf_ratio": "fr",
    "levenshtein": "lev",
    "tfidf": "tfidf",
}
UNIFIED_WEIGHTS = [0.25, 0.25, 0.20, 0.10, 0.05, 0.10, 0.03, 0.01, 0.01]
METRICS = [*UNIFIED_METRICS, "final"]

POLICY = {
    "unified": "common_distinct_with_id",
    "rowwise": "common_distinct",
    "hybrid": "common_cells",
}
MODE = {"unified": "plain", "rowwise": "plain", "hybrid": "delim", "longguard": "delim", "weighted": "delim"}
MERGED = ("longguard", "weighted", "fastpath", "tagged")


def scored(profile: str, tables: list[str] | None = None) -> list[str]:
    """Pieces up to ``scored``: one row per aligned cell pair with its score(s) and tag."""
    pieces = list(tables or matching_tables())
    pieces.append(MERGED_PAIRS if profile in MERGED else PAIRS)
    if profile == "containment":
        dn, sn = "dn", "sn"
        parts = delim_parts(sn)
        items = f"(case when len({parts}) = 0 and sn <> '' then [sn] else {parts} end)"
        sub = "(case when dn <> '' and contains(sn, dn) then 1.0 else 0.0 end)"
        item = f"(case when dn <> '' and list_contains({items}, dn) then 1.0 else 0.0 end)"
        token = share(tokens(dn), tokens(sn))
        char = share(f"({char_ngrams(dn)})", f"({char_ngrams(sn)})")
        pieces += [
            f"normal as (select dv, sv, {norm('dv')} as dn, {norm('sv')} as sn from (select distinct dv, sv from pairs))",
            f"""parts as (
  select dv, sv, (case when dn = sn and dv <> '' then 1.0 else 0.0 end) as exact, {sub} as sub, {item} as item,
    {token} as token, {char} as chr from normal)""",
            """scored as (
  select pairs.*, least(greatest(0.35 * exact + 0.30 * sub + 0.20 * item + 0.10 * token + 0.05 * chr, 0.0), 1.0)::double as score,
    sub::double as substring_hit, token::double as token_containment, item::double as list_item_hit
  from pairs join parts using (dv, sv))""",
        ]
        return pieces
    pieces += [
        elements(MODE.get(profile, "wrapped")),
        FUZZY,
        corpus(POLICY.get(profile, "all_cells")),
        VOCABULARY,
        COSINE,
    ]
    if profile == "unified":
        final = " + ".join(f"{k} * {w}" for k, w in zip(UNIFIED_METRICS, UNIFIED_WEIGHTS))
        cols = ", ".join(f"({v})::double as {k}" for k, v in UNIFIED_METRICS.items())
        pieces += [
            f"metrics as (select a, b, {cols} from measured)",
            f"""scored as (
  select pairs.*, {', '.join(UNIFIED_METRICS)}, least(greatest({final}, 0.0), 1.0)::double as final
  from pairs join normal using (dv, sv) join metrics on dn = a and sn = b)""",
        ]
        return pieces
    if profile == "rowwise":
        pieces += [
            f"single as (select a, b, {ROWWISE} as score from measured)",
            "scored as (select pairs.*, score from pairs join normal using (dv, sv) join single on dn = a and sn = b)",
        ]
        return pieces
    rule = {
        "hybrid": HYBRID,
        "longguard": guarded(80, 24, 0.5, "1.0", 1.0),
        "weighted": guarded(80, 24, 0.5, None, 0.999),
    }.get(profile, guarded(95, 35, 0.45, None, 0.999))
    pieces.append(f"single as (select a, b, {rule} as element_score from measured)")
    pieces.append("""best as (
  select dv, sv, max(element_score) as top from (
    select dv, sv, a, unnest(se) as b from (select dv, sv, unnest(de) as a, se from els))
  join single using (a, b) group by dv, sv)""")
    if profile not in ("fastpath", "tagged"):
        pieces.append("""scored as (
  select pairs.*, coalesce(top, 0.0)::double as score
  from pairs left join best using (dv, sv))""")
        return pieces
    pieces.append(f"""tagged as (
  select dv, sv, {kind('st')} as kind,
    case when dn = '' or sn = '' then 'none'
      when {kind('st')} = 'single' and dn = sn then 'direct'
      when {kind('st')} = 'wrapped_list' and list_contains({wrapped_parts('st')}, dn) then 'list'
      when {kind('st')} = 'delimited_list' and {listlike('dn', 'sn')} then 'listlike'
      else 'similarity' end as tag
  from normal)""")
    pieces.append("""scored as (
  select pairs.*, tag, case tag when 'none' then 0.0 when 'direct' then 0.99 when 'list' then 0.94
      when 'listlike' then 0.90 else coalesce(top, 0.0) *
        case kind when 'wrapped_list' then 0.94 when 'delimited_list' then 0.90 when 'single' then 1.0 else 0.0 end
    end::double as score
  from pairs join tagged using (dv, sv) left join best using (dv, sv))""")
    return pieces


def with_(pieces: list[str], select: str) -> str:
    return "with " + ",\n".join(pieces) + "\n" + select


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) as {name or x}"


# ---- statistics and mapping -----------------------------------------------------------------

ALL_PAIRS = """every as (
  select d_ord, s_ord, min(dashboard_col) as dashboard_col, min(source_col) as source_col from (
    select d.ord as d_ord, s.ord as s_ord, d.col as dashboard_col, s.col as source_col
    from (select distinct ord, col from dcells) d, (select distinct ord, col from scells) s)
  group by d_ord, s_ord),
aligned as (select count(*) as n from (select id from dash intersect select id from src))"""


def hit(profile: str) -> str:
    if profile == "tagged":
        return "score >= case tag when 'similarity' then 0.45 when 'none' then 1.0 else 0.7 end"
    return "score >= 0.7"


def statistics(profile: str, least: str | None = None) -> list[str]:
    is_hit = least or hit(profile)
    if profile in ("containment", "unified", "rowwise"):
        metrics = METRICS if profile == "unified" else ["score"]
        means = ", ".join(f"coalesce(avg({m}), 0.0) as {m}" for m in metrics)
        return [
            ALL_PAIRS,
            f"""stats as (
  select every.d_ord, every.s_ord, every.dashboard_col, every.source_col, {means}, count({metrics[-1]}) as support,
    count({metrics[-1]})::double / (select n from aligned) as coverage
  from every left join scored using (d_ord, s_ord)
  group by every.d_ord, every.s_ord, every.dashboard_col, every.source_col)""",
        ]
    tags = ""
    if profile in ("fastpath", "tagged"):
        tags = "".join(
            f", count(*) filter (where {is_hit} and tag = '{t}') as {t}_hits"
            for t in ("direct", "list", "listlike", "similarity")
        )
    return [
        f"""stats as (
  select d_ord, s_ord, dashboard_col, source_col, count(*) filter (where {is_hit}) as hits, count(*) as total_pairs,
    sum(score) filter (where {is_hit}) as weighted_score, max(score) filter (where {is_hit}) as max_score{tags}
  from scored group by d_ord, s_ord, dashboard_col, source_col),
cand as (
  select *, hits::double / total_pairs as hit_rate, weighted_score / hits as avg_score,
    weighted_score / total_pairs * 100.0 as score_pct
  from stats where hits > 0)"""
    ]


def candidates(profile: str, tables: list[str] | None = None, hit: str | None = None) -> str:
    tags = [f"{t}_hits" for t in ("direct", "list", "listlike", "similarity")] if profile in ("fastpath", "tagged") else []
    floats = ["hit_rate", "avg_score", "max_score", "weighted_score", "score_pct"]
    cols = ["dashboard_col", "source_col", "hits", "total_pairs", *[r6(f) for f in floats], *tags]
    return with_(scored(profile, tables) + statistics(profile, hit), f"select {', '.join(cols)} from cand")


def mapping(profile: str, tables: list[str] | None = None) -> str:
    pieces = scored(profile, tables) + statistics(profile)
    if profile in ("containment", "unified", "rowwise"):
        key = "final" if profile == "unified" else "score"
        label = (
            f"case when {key} >= 0.95 then 'exact/substring' when {key} >= 0.85 then 'very likely' "
            f"when {key} >= 0.7 then 'likely (review)' else 'uncertain' end"
            if profile == "rowwise"
            else f"case when {key} >= 0.95 then 'exact/substring match' when {key} >= 0.85 then 'very likely match' "
            f"when {key} >= 0.75 then 'likely match (review)' else 'uncertain' end"
        )
        floor = 0 if profile == "rowwise" else 10
        pieces.append(f"""ranked as (
  select *, row_number() over (partition by d_ord order by round({key}, 12) desc, s_ord) as rank_in_dashboard
  from stats where support >= {floor})""")
        pieces.append(f"""turns as (
  select *, row_number() over (partition by s_ord order by round({key}, 12) desc, d_ord) as turn
  from ranked where rank_in_dashboard = 1)""")
        cols = ["dashboard_col", "source_col", "support", "rank_in_dashboard", f"{label} as suggestion"]
        cols += [r6(m) for m in METRICS] if profile == "unified" else [r6("score", "avg_score")]
        cols += [] if profile == "rowwise" else [r6("coverage")]
        unique = "" if profile == "rowwise" else " where turn = 1"
        return with_(pieces, f"select {', '.join(cols)} from turns{unique}")
    if profile in ("hybrid", "longguard"):
        pieces.append("""ranked as (
  select *, row_number() over (partition by d_ord order by round(avg_score, 12) desc, s_ord) as rank from cand)""")
        label = (
            "case when max_score >= 0.95 then 'exact match' when avg_score >= 0.85 then 'very likely match' "
            "when avg_score >= 0.7 then 'likely match' else 'uncertain' end"
        )
        return with_(
            pieces,
            f"select dashboard_col, source_col, {r6('avg_score')}, {r6('max_score')}, hits as support, rank, "
            f"{label} as suggestion from ranked where rank = 1",
        )
    pieces.append("""ranked as (
  select *, row_number() over (partition by d_ord order by round(weighted_score, 12) desc, round(avg_score, 12) desc,
    hits desc, round(hit_rate, 12) desc, s_ord) as place from cand)""")
    label = (
        "case when hit_rate >= 0.9 and avg_score >= 0.85 then 'exact/very likely (strong coverage)' "
        "when hit_rate >= 0.75 and avg_score >= 0.7 then 'likely (good coverage)' "
        "when hit_rate >= 0.5 and avg_score >= 0.7 then 'possible (review)' else 'uncertain' end"
    )
    tags = "".join(f", {t}_hits" for t in ("direct", "list", "listlike", "similarity")) if profile in ("fastpath", "tagged") else ""
    return with_(
        pieces,
        f"select dashboard_col, source_col, hits, total_pairs, {r6('hit_rate')}, {r6('avg_score')}, {r6('max_score')}, "
        f"{r6('weighted_score')}, {r6('score_pct')}{tags}, {label} as suggestion from ranked where place = 1",
    )


def score_columns(profile: str) -> list[str]:
    if profile == "unified":
        return [r6(m) for m in METRICS]
    if profile == "containment":
        return [r6(c) for c in ("score", "substring_hit", "token_containment", "list_item_hit")]
    return [r6("score"), *(["tag"] if profile in ("fastpath", "tagged") else [])]


def id_name(profile: str) -> str:
    return "id_c" if profile in ("containment", "unified") else "id"


def cell_scores(profile: str) -> str:
    """Every aligned cell pair with its score."""
    where = f" where {hit(profile)}" if profile == "fastpath" else ""
    return with_(
        scored(profile),
        f"select id as {id_name(profile)}, dashboard_col, source_col, dv as dashboard_val, sv as source_val, "
        f"{', '.join(score_columns(profile))} from scored{where}",
    )


def audit(profile: str, chosen: list[tuple[str, str]], rows: int | None = None) -> str:
    listed = ", ".join(f"({i}, '{d}', '{s}')" for i, (d, s) in enumerate(chosen))
    where = f" where {hit(profile)}" if profile == "fastpath" else ""
    bound = "" if rows is None else f"\nqualify row_number() over (partition by pair order by key) <= {rows}"
    return with_(
        scored(profile),
        f"""select id as {id_name(profile)}, dashboard_col, source_col, dv as dashboard_val, sv as source_val,
  {', '.join(score_columns(profile))}
from scored join (values {listed}) as chosen(pair, dashboard_col, source_col) using (dashboard_col, source_col){where}
{bound}""",
    )
