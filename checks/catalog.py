"""Registered queries, each beside its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colweave import PROFILES, audit_cells, get_profile, mapped_pairs, match_columns
from colweave.functions import containers as C, fuzzy, text as X
from colweave.operators import align as A, diagnostics as D, scoring as S, tfidf
from colweave.plans.jobs import run_matching_job, run_threshold_report
from colweave.plans.workspace import Workspace
from colweave.sources import results

from . import oracles as O, views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- text functions over every source cell and every document, whole texts -------------------

RAW_SQL = f"""raw_cells as (
  {" union all ".join(f"select '{c}:' || id as cell, {c} as raw from src" for c in O.SRC_COLS)}
  union all select 'text:' || doc_id, text from documents
  union all select 'opening:' || doc_id, array_to_string(string_split(text, ' ')[1:4], ' ') from documents),
n as (select cell, raw, {O.norm('raw')} as norm, {O.strip("coalesce(raw, '')")} as text from raw_cells)"""


def raw_cells(spark: SparkSession, sf: str) -> DataFrame:
    src = V.src(spark, sf)
    cells = F.array(
        *[F.struct(F.lit(f"{c}:").alias("col"), F.col(c).alias("raw")) for c in O.SRC_COLS]
    )
    long = src.select("c_custkey", F.explode(cells).alias("c")).select(
        F.concat("c.col", F.col("c_custkey").cast("string")).alias("cell"), "c.raw"
    )
    doc = F.col("doc_id").cast("string")
    texts = V.documents(spark, sf).select(F.concat(F.lit("text:"), doc).alias("cell"), F.col("text").alias("raw"))
    opening = V.doc_report(spark, sf).select(
        F.concat(F.lit("opening:"), doc).alias("cell"), F.col("opening").alias("raw")
    )
    return long.unionByName(texts).unionByName(opening)


def text_query(columns: Callable[[], dict[str, Column]], sql: str) -> tuple[Query, str]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        cells = raw_cells(spark, sf).withColumn("norm", X.normalize(F.col("raw")))
        return cells.select("cell", *[v.alias(k) for k, v in columns().items()])

    return query, O.with_([O.CUSTOMERS, O.SRC, RAW_SQL], f"select cell, {sql} from n")


def listed(items: Column, glue: str = "#") -> dict[str, Column]:
    return {"n": F.size(items), "items": F.array_join(items, glue)}


def listed_sql(items: str, glue: str = "#") -> str:
    return f"len({items}) as n, coalesce(array_to_string({items}, '{glue}'), '') as items"


register("normalize_cells", *text_query(lambda: {"norm": F.col("norm")}, "norm"))
DEDUP_SQL = O.distinct_first(O.delim_parts("norm"))
register(
    "split_cells_dedup",
    *text_query(
        lambda: listed(C.split_norm(F.col("norm"), "dedup")),
        listed_sql(f"(case when len({DEDUP_SQL}) = 0 and norm <> '' then [norm] else {DEDUP_SQL} end)"),
    ),
)
register(
    "split_cells_dedup_strict",
    *text_query(lambda: listed(C.split_norm(F.col("norm"), "dedup_strict")), listed_sql(DEDUP_SQL)),
)
register(
    "split_cells_delim",
    *text_query(lambda: listed(C.split_norm(F.col("norm"), "delim")), listed_sql(O.delim_parts("norm"))),
)
WRAPPED_SQL = f"(case when {O.is_wrapped('text')} then {O.wrapped_parts('text')} else [] end)"
register(
    "split_cells_wrapped",
    *text_query(
        lambda: listed(C.split_wrapped(F.col("raw"))),
        listed_sql(
            f"(case when text = '' then [] when {O.is_wrapped('text')} then {O.wrapped_parts('text')} else [norm] end)"
        ),
    ),
)
register(
    "wrapped_list_elements",
    *text_query(lambda: listed(C.wrapped_elements(F.col("raw"))), listed_sql(WRAPPED_SQL)),
)
register(
    "container_type",
    *text_query(
        lambda: {"kind": C.container_type(F.col("raw")), "wrapped": C.is_wrapped(F.col("raw"))},
        f"{O.kind('text')} as kind, {O.is_wrapped('text')} as wrapped",
    ),
)
register(
    "word_tokens",
    *text_query(lambda: listed(X.word_tokens(F.col("norm")), " "), listed_sql(O.tokens("norm"), " ")),
)
register(
    "tokenize",
    *text_query(
        lambda: listed(X.tokenize(F.col("raw")), " "),
        listed_sql("list_transform(regexp_extract_all(coalesce(raw, ''), '[A-Za-z0-9]+'), lambda t: lower(t))", " "),
    ),
)


def gram_columns() -> dict[str, Column]:
    items = X.char_ngrams(F.col("norm"))
    return {
        "n": F.size(items),
        "different": F.size(F.array_distinct(items)),
        "digest": F.md5(F.array_join(items, "#")),
    }


register(
    "char_ngrams",
    *text_query(
        gram_columns,
        f"len({O.char_ngrams('norm')}) as n, len(list_distinct({O.char_ngrams('norm')})) as different, "
        f"md5(coalesce(array_to_string({O.char_ngrams('norm')}, '#'), '')) as digest",
    ),
)


def length_columns() -> dict[str, Column]:
    n = F.col("norm")
    return {
        "long_80": X.is_long_text(n, 80, 15),
        "long_95": X.is_long_text(n, 95, 15),
        "short_24": X.is_short_text(n, 24, 4),
        "short_35": X.is_short_text(n, 35, 4),
    }


register(
    "text_length_flags",
    *text_query(
        length_columns,
        f"{O.is_long('norm', 80, 15)} as long_80, {O.is_long('norm', 95, 15)} as long_95, "
        f"{O.is_short('norm', 24, 4)} as short_24, {O.is_short('norm', 35, 4)} as short_35",
    ),
)


# ---- pair functions over every aligned cell pair ---------------------------------------------


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return (
        A.side_table(V.src(spark, sf), "c_custkey", O.SRC_COLS),
        A.side_table(V.dash(spark, sf), "c_custkey", O.DASH_COLS),
    )


def cell_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.expand_pairs(A.align(*sides(spark, sf)), "id")

    def name(cols, at):
        return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(at) + 1)

    return pairs.where("d.raw is not null and s.raw is not null").select(
        "id",
        name(O.DASH_COLS, "d.ord").alias("dashboard_col"),
        name(O.SRC_COLS, "s.ord").alias("source_col"),
        X.normalize(F.col("d.raw")).alias("a"),
        X.normalize(F.col("s.raw")).alias("b"),
    )


def pair_query(columns: Callable[[Column, Column], dict[str, Column]], sql: str) -> tuple[Query, str]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = columns(F.col("a"), F.col("b"))
        return rounded(
            cell_pairs(spark, sf).select(
                "id", "dashboard_col", "source_col", *[v.alias(k) for k, v in out.items()]
            )
        )

    normal = f"n as (select id, dashboard_col, source_col, {O.norm('dv')} as a, {O.norm('sv')} as b from pairs)"
    return query, O.with_(
        [*O.matching_tables(), O.PAIRS, normal], f"select id, dashboard_col, source_col, {sql} from n"
    )


register(
    "exact_substring_list",
    *pair_query(
        lambda a, b: {
            "exact": X.exact_match(a, b),
            "substring": X.substring_match(a, b),
            "list_item": X.item_match(a, C.split_norm(b, "dedup")),
        },
        f"{O.FLAG_EXACT}::double as exact, {O.FLAG_SUB}::double as substring, {O.FLAG_ITEM}::double as list_item",
    ),
)
register(
    "token_containment",
    *pair_query(
        lambda a, b: {"share": X.share_found(X.word_tokens(a), X.word_tokens(b))},
        f"round({O.share(O.tokens('a'), O.tokens('b'))}, 6) as share",
    ),
)
register(
    "char_containment",
    *pair_query(
        lambda a, b: {"share": X.share_found(X.char_ngrams(a), X.char_ngrams(b))},
        f"round({O.share('(' + O.char_ngrams('a') + ')', '(' + O.char_ngrams('b') + ')')}, 6) as share",
    ),
)
register(
    "boundary_overlap",
    *pair_query(
        lambda a, b: {
            "boundary": X.boundary_substring(a, b),
            "recall": X.overlap_recall(a, b),
            "precision": X.overlap_precision(a, b),
        },
        f"{O.boundary('a', 'b')} as boundary, {O.FLAG_SUB}::double as recall, "
        "round(case when a <> '' and contains(b, a) then length(a)::double / length(b) else 0.0 end, 6) as precision",
    ),
)
register(
    "listlike_member",
    *pair_query(
        lambda a, b: {"member": C.listlike_member(a, b)}, f"(a <> '' and {O.listlike('a', 'b')}) as member"
    ),
)


# ---- fuzzy measures over every part name -----------------------------------------------------

NEAR_SQL = """near as (
  select p_partkey, lower(p_name) as a, lower(left(p_name, 2) || substring(p_name, 4)) as b from part),
duo as (select distinct a, b from near)"""


def near_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = V.near(spark, sf).select(
        "p_partkey", X.normalize(F.col("p_name")).alias("a"), X.normalize(F.col("p_name_typo")).alias("b")
    )
    return rows, rows.select("a", "b").distinct()


def near_query(score: Callable[[Column, Column], Column], name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows, pairs = near_pairs(spark, sf)
        scored = pairs.withColumn(name, score(F.col("a"), F.col("b")))
        return rounded(rows.join(scored, ["a", "b"]).select("p_partkey", "a", "b", name))

    return query


def near_sql(name: str, measure: str) -> str:
    return O.with_(
        [NEAR_SQL, O.FUZZY],
        f"select p_partkey, a, b, round({measure}, 6) as {name} from near join fuzzy using (a, b)",
    )


register("fuzzy_ratio", near_query(lambda a, b: fuzzy.indel_struct(a, b)["ratio"], "ratio"), near_sql("ratio", "fr"))
register(
    "fuzzy_partial", near_query(lambda a, b: fuzzy.indel_struct(a, b)["partial"], "partial"), near_sql("partial", "fp")
)
register("fuzzy_levenshtein", near_query(fuzzy.levenshtein_similarity, "similarity"), near_sql("similarity", "lev"))
register("lcs_like", near_query(fuzzy.lcs_like, "partial"), near_sql("partial", "fp"))
register("fuzzy_difflib", near_query(fuzzy.difflib_ratio, "ratio"))


# ---- alignment -------------------------------------------------------------------------------


def align_ids(spark: SparkSession, sf: str) -> DataFrame:
    aligned = A.align(*sides(spark, sf))
    return aligned.select("id", F.col("d_cells")[0]["raw"].alias("segment"), F.col("s_cells")[4]["raw"].alias("nat"))


register(
    "align_ids", align_ids, O.with_([O.CUSTOMERS, O.DASH, O.SRC], "select id, segment, nat from dash join src using (id)")
)


def column_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.expand_pairs(A.align(*sides(spark, sf)))
    filled = F.col("d.raw").isNotNull() & F.col("s.raw").isNotNull()
    return pairs.groupBy(F.col("d.ord").alias("d_ord"), F.col("s.ord").alias("s_ord")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(filled).alias("filled")
    )


register(
    "column_pairs",
    column_pairs,
    O.with_(
        O.matching_tables(),
        "select d.ord as d_ord, s.ord as s_ord, count(*) as cells, count(d.raw || s.raw) as filled "
        "from dcells d join scells s on d.id = s.id group by d.ord, s.ord",
    ),
)
register(
    "sample_ids",
    lambda spark, sf: A.sample_ids(A.align(*sides(spark, sf)), 250).select("id"),
    O.with_([O.CUSTOMERS, O.DASH, O.SRC], "select id from dash join src using (id) order by dash.key limit 250"),
)



def half_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    return A.sample_ids(A.align(*sides(spark, sf)), V.dash(spark, sf).count() // 2).select("id")


register(
    "sample_half_of_ids",
    half_of_ids,
    O.with_(
        [O.CUSTOMERS, O.DASH, O.SRC],
        "select id from dash join src using (id) order by dash.key limit (select count(*) // 2 from dash)",
    ),
)

ORDER_COLS = ["o_orderstatus", "o_orderpriority"]


def merge_orders(spark: SparkSession, sf: str) -> DataFrame:
    merged = A.merge_duplicates(V.order_status(spark, sf), "o_custkey", ORDER_COLS, ["o_orderkey"])
    return merged.select(
        "id", *[F.col("cells")[i]["raw"].alias(c) for i, c in enumerate(ORDER_COLS)]
    )


MERGED_ORDERS = """(select o_custkey::varchar as id,
    coalesce(string_agg(o_orderstatus, ' | ' order by o_orderkey), '') as o_orderstatus,
    coalesce(string_agg(o_orderpriority, ' | ' order by o_orderkey), '') as o_orderpriority
  from orders{where} group by 1)"""
register("merge_duplicates", merge_orders, f"select * from {MERGED_ORDERS.format(where='')}")


def merge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """With a bound on rows an id that the given tables pass, so that ids are merged both ways."""
    merged = A.merge_duplicates(V.skewed_lines(spark, sf), "owner", ["quantity", "flag"], V.LINE_ORDER, hot_rows=5_000)
    cell = lambda i: F.col("cells")[i]["raw"]
    return merged.select(
        "id",
        *[F.length(cell(i)).alias(f"{c}_chars") for i, c in enumerate(("quantity", "flag"))],
        *[F.md5(cell(i)).alias(f"{c}_md5") for i, c in enumerate(("quantity", "flag"))],
    )


def merged_lines(column: str) -> str:
    return f"coalesce(string_agg({column}, ' | ' order by l_orderkey, l_linenumber, l_partkey, quantity, flag nulls first) filter (trim({column}) <> ''), '')"


register(
    "merge_skewed_lines",
    merge_lines,
    f"""with lines as (
  select case when l_orderkey % 10 < 6 then 'hot' when l_orderkey % 10 = 6 then null when l_orderkey % 10 = 7 then ' '
      else l_suppkey::varchar end as id, l_orderkey, l_linenumber, l_partkey, l_quantity::int::varchar as quantity,
    case l_partkey % 7 when 0 then null when 1 then '  ' else ' ' || l_returnflag end as flag
  from lineitem),
merged as (select id, {merged_lines('quantity')} as quantity, {merged_lines('flag')} as flag from lines group by 1)
select id, length(quantity) as quantity_chars, length(flag) as flag_chars, md5(quantity) as quantity_md5, md5(flag) as flag_md5
from merged""",
)


# ---- gram weights ----------------------------------------------------------------------------


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    s, d = sides(spark, sf)
    docs = tfidf.corpus(get_profile("tagged"), s, d, A.align(s, d))
    return Workspace(spark).table(tfidf.document_frequency(docs), "vocabulary")


def idf_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tfidf.inverse_frequency(vocabulary(spark, sf)))


register(
    "tfidf_idf",
    idf_query,
    O.with_(
        [*O.matching_tables(), O.corpus("all_cells"), O.VOCABULARY], "select gram, df, round(idf, 6) as idf from vocabulary"
    ),
)


def idf_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.documents(spark, sf).groupBy(X.normalize(F.col("text")).alias("doc")).agg(F.count("*").alias("times"))
    table = Workspace(spark).table(tfidf.document_frequency(docs), "vocabulary")
    return rounded(tfidf.inverse_frequency(table))


register(
    "tfidf_idf_documents",
    idf_documents,
    O.with_(
        [f"docs as (select {O.norm('text')} as doc, count(*) as times from documents group by 1)", O.VOCABULARY],
        "select gram, df, round(idf, 6) as idf from vocabulary",
    ),
)


def cosine_query(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cell_pairs(spark, sf).select("a", "b").distinct().withColumn("ek", S.pair_key(F.col("a"), F.col("b")))
    cosines = tfidf.cosine(pairs, vocabulary(spark, sf))
    out = pairs.join(cosines, "ek", "left")
    return rounded(out.select("a", "b", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf")))


register(
    "tfidf_cosine",
    cosine_query,
    O.with_(
        [
            *O.matching_tables(), O.PAIRS,
            f"duo as (select distinct {O.norm('dv')} as a, {O.norm('sv')} as b from pairs)",
            "fuzzy as (select a, b, 0.0 as fr, 0.0 as fp, 0.0 as lev from duo)",
            O.corpus("all_cells"), O.VOCABULARY, O.COSINE,
        ],
        "select a, b, round(tfidf, 6) as tfidf from measured",
    ),
)


# ---- scorers, mappings, candidates, audits ---------------------------------------------------

EVERY_PAIR = [(d, s) for d in O.DASH_COLS for s in O.SRC_COLS]
CHOSEN = [("segment", "mkt"), ("name", "label"), ("nation", "nat")]


def match(spark: SparkSession, sf: str, profile: str):
    return match_columns(V.src(spark, sf), V.dash(spark, sf), "c_custkey", profile=profile)


def audit(spark: SparkSession, sf: str, profile: str, pairs, rows: int | None = None) -> DataFrame:
    return rounded(
        audit_cells(V.src(spark, sf), V.dash(spark, sf), "c_custkey", pairs=pairs, profile=profile, max_rows=rows)
    )


for _name in PROFILES:
    register(
        f"map_{_name}", lambda spark, sf, p=_name: rounded(match(spark, sf, p).mapping), O.mapping(_name)
    )
    register(
        f"score_{_name}", lambda spark, sf, p=_name: audit(spark, sf, p, EVERY_PAIR), O.cell_scores(_name)
    )
    register(
        f"audit_{_name}", lambda spark, sf, p=_name: audit(spark, sf, p, CHOSEN), O.audit(_name, CHOSEN)
    )
    if PROFILES[_name].statistics == "weighted":
        register(
            f"candidates_{_name}",
            lambda spark, sf, p=_name: rounded(match(spark, sf, p).candidates),
            O.candidates(_name),
        )


# Two report columns that compete for a source column, and one with too few rows to be matched.
CROWDED_TABLES = [
    O.CUSTOMERS,
    O.DASH.replace("seg as segment", "seg as segment, seg as again, case when c_custkey <= 8 then n_name end as rare"),
    O.SRC,
    O.long_cells("dash", [*O.DASH_COLS, "again", "rare"], "dcells", ", key"),
    O.long_cells("src", O.SRC_COLS, "scells"),
]
for _name in ("containment", "unified"):
    register(
        f"map_{_name}_competing",
        lambda spark, sf, p=_name: rounded(
            match_columns(V.src(spark, sf), V.crowded(spark, sf), "c_custkey", profile=p).mapping
        ),
        O.mapping(_name, CROWDED_TABLES),
    )
register(
    "candidates_weighted_strict",
    lambda spark, sf: rounded(
        match_columns(V.src(spark, sf), V.dash(spark, sf), "c_custkey", profile="weighted", min_ratio=0.9).candidates
    ),
    O.candidates("weighted", hit="score >= 0.9"),
)
register(
    "audit_unknown_column",
    lambda spark, sf: audit(spark, sf, "containment", [("nowhere", "mkt"), CHOSEN[0], ("segment", "nowhere")]),
    O.audit("containment", CHOSEN[:1]),
)


def metrics_preview(spark: SparkSession, sf: str) -> DataFrame:
    best = mapped_pairs(match(spark, sf, "unified").mapping)[:1]
    return audit(spark, sf, "unified", best, 200)


register("metrics_preview", metrics_preview, O.audit("unified", CHOSEN[:1], 200))

# Both tables with repeated ids: finished orders against all orders of a customer.
ORDER_TABLES = [
    f"dash as {MERGED_ORDERS.format(where=chr(32) + 'where o_orderstatus = ' + chr(39) + 'F' + chr(39))}",
    f"src as {MERGED_ORDERS.format(where='')}",
    O.long_cells("dash", ["o_orderpriority"], "dcells", ", id as key"),
    O.long_cells("src", ORDER_COLS, "scells"),
]


def match_orders(spark: SparkSession, sf: str, profile: str):
    orders = V.order_status(spark, sf)
    done = orders.where("o_orderstatus = 'F'")
    return match_columns(
        orders, done, "o_custkey", profile=profile, source_order=["o_orderkey"], dash_order=["o_orderkey"],
        dash_cols=["o_orderpriority"],
    )


register(
    "candidates_weighted_orders",
    lambda spark, sf: rounded(match_orders(spark, sf, "weighted").candidates),
    O.candidates("weighted", ORDER_TABLES),
)
register(
    "map_longguard_orders",
    lambda spark, sf: rounded(match_orders(spark, sf, "longguard").mapping),
    O.mapping("longguard", ORDER_TABLES),
)
register("map_tagged_orders", lambda spark, sf: rounded(match_orders(spark, sf, "tagged").mapping))

# Many elements a cell on both sides, none equal to one of the other side.
MERGED_PARTS = """(select p_size::varchar as id, {cells} from part{where} group by 1)"""


def merged_parts(columns: dict[str, str], where: str = "") -> str:
    cells = [f"string_agg({x}, ' | ' order by p_partkey) as {name}" for name, x in columns.items()]
    return MERGED_PARTS.format(cells=", ".join(cells), where=where)


PART_COLS = ["p_name", "p_brand", "p_type"]
PART_TABLES = [
    "dash as " + merged_parts({"item": "substr(p_name, 1, 2) || substr(p_name, 4)"}, " where p_partkey % 3 <> 0"),
    "src as " + merged_parts({c: c for c in PART_COLS}),
    O.long_cells("dash", ["item"], "dcells", ", id as key"),
    O.long_cells("src", PART_COLS, "scells"),
]


def match_parts(spark: SparkSession, sf: str, profile: str):
    return match_columns(
        V.parts(spark, sf), V.stocked_parts(spark, sf), "p_size", profile=profile,
        source_order=["p_partkey"], dash_order=["p_partkey"],
    )


register(
    "candidates_weighted_parts",
    lambda spark, sf: rounded(match_parts(spark, sf, "weighted").candidates),
    O.candidates("weighted", PART_TABLES),
)
register(
    "map_longguard_parts",
    lambda spark, sf: rounded(match_parts(spark, sf, "longguard").mapping),
    O.mapping("longguard", PART_TABLES),
)


def match_lines(spark: SparkSession, sf: str, profile: str):
    return match_columns(
        V.line_parts(spark, sf), V.returned_parts(spark, sf), "l_suppkey", profile=profile,
        source_order=V.LINE_ORDER, dash_order=V.LINE_ORDER,
    )


# Hundreds of values a cell: plain SQL cannot hold all pairs; tests compare a small table with all pairs.
register("candidates_weighted_lines", lambda spark, sf: rounded(match_lines(spark, sf, "weighted").candidates))

# Whole documents against their opening words, language and source.
DOC_TABLES = [
    "dash as (select doc_id::varchar as id, doc_id as key, array_to_string(string_split(text, ' ')[1:4], ' ') as opening, "
    "lang as language, source as origin from documents)",
    "src as (select doc_id::varchar as id, text, lang, source from documents)",
    O.long_cells("dash", ["opening", "language", "origin"], "dcells", ", key"),
    O.long_cells("src", ["text", "lang", "source"], "scells"),
]


def match_documents(spark: SparkSession, sf: str, profile: str):
    return match_columns(V.documents(spark, sf), V.doc_report(spark, sf), "doc_id", profile=profile)


register(
    "map_containment_documents",
    lambda spark, sf: rounded(match_documents(spark, sf, "containment").mapping),
    O.mapping("containment", DOC_TABLES),
)
register("map_hybrid_documents", lambda spark, sf: rounded(match_documents(spark, sf, "hybrid").mapping))


# ---- diagnostics -----------------------------------------------------------------------------

register(
    "tag_summary",
    lambda spark, sf: D.tag_summary(match(spark, sf, "tagged").candidates),
    O.with_(
        O.scored("tagged")
        + O.statistics("tagged")
        + [
            "totals as ("
            + " union all ".join(
                f"select '{t}_hits' as tag, coalesce(sum({t}_hits), 0)::bigint as hits, {v} as threshold from cand"
                for t, v in (("direct", 0.7), ("list", 0.7), ("listlike", 0.7), ("similarity", 0.45))
            )
            + ")"
        ],
        'select tag as "Tag", hits as "Total_Hits", threshold::double as "Threshold", '
        'round_even(hits::double / greatest((select sum(hits) from totals), 1) * 100, 2) as "Relative_%" from totals',
    ),
)


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    cells = audit_cells(
        V.src(spark, sf), V.dash(spark, sf), "c_custkey", pairs=EVERY_PAIR, profile="tagged"
    )
    return D.threshold_sweep(cells)


GRID_SQL = """
  ('direct', 0.65::double), ('direct', 0.675::double), ('direct', 0.7::double), ('direct', 0.725::double), ('direct', 0.75::double),
  ('list', 0.65::double), ('list', 0.675::double), ('list', 0.7::double), ('list', 0.725::double), ('list', 0.75::double),
  ('listlike', 0.65::double), ('listlike', 0.675::double), ('listlike', 0.7::double), ('listlike', 0.725::double), ('listlike', 0.75::double),
  ('similarity', 0.3::double), ('similarity', 0.325::double), ('similarity', 0.35::double), ('similarity', 0.375::double), ('similarity', 0.4::double), ('similarity', 0.425::double), ('similarity', 0.45::double), ('similarity', 0.475::double), ('similarity', 0.5::double), ('similarity', 0.525::double), ('similarity', 0.55::double), ('similarity', 0.575::double), ('similarity', 0.6::double)"""
register(
    "threshold_sweep",
    sweep,
    O.with_(
        O.scored("tagged") + [f"grid as (select * from (values {GRID_SQL}) as g(tag, threshold))"],
        "select grid.tag, threshold, count(*) filter (where score >= threshold) as hits, count(score) as rows_considered, "
        "round_even(coalesce(count(*) filter (where score >= threshold) / nullif(count(score), 0)::double, 0.0), 4) as hit_rate, "
        "round_even(coalesce(avg(score) filter (where score >= threshold), 0.0), 4) as avg_score_of_hits "
        "from grid left join scored on scored.tag = grid.tag group by grid.tag, threshold",
    ),
)


# ---- jobs: CSV in, result folders out --------------------------------------------------------


def job(spark: SparkSession, sf: str, profile: str, fmt: str, **wanted: bool) -> str:
    """Write both sides as CSV (padded headers, an id name of its own each), match them and return the result folder."""
    root = Workspace(spark).root
    report = V.dash(spark, sf).toDF(" report_id ", " segment", "name ", "nation")
    paths = [results.write_result(df, f"{root}/in", name) for df, name in ((V.src(spark, sf), "source"), (report, "report"))]
    run_matching_job(
        spark, *paths, "c_custkey", "report_id", f"{root}/out", profile, fmt=fmt, multiline=False, **wanted
    )
    return f"{root}/out"


def job_result(name: str, profile: str = "tagged", fmt: str = "csv", **wanted: bool) -> Query:
    return lambda spark, sf: rounded(results.read_result(spark, job(spark, sf, profile, fmt, **wanted), name, fmt))


def job_report(name: str, fmt: str, **wanted: bool) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = job(spark, sf, "tagged", fmt, **wanted)
        run_threshold_report(spark, out, fmt=fmt)
        return spark.read.parquet(results.result_path(out, name, fmt))

    return query


# What the tagged mapping chooses.
JOB_PAIRS = [("segment", "mkt"), ("name", "label"), ("nation", "mkt_wrapped")]
register("job_mapping", job_result(results.MAPPING), O.mapping("tagged"))
register("job_candidates", job_result(results.CANDIDATES), O.candidates("tagged"))
register("job_audit", job_result(results.AUDIT, audit=True), O.audit("tagged", JOB_PAIRS))
register(
    "job_preview",
    job_result(results.PREVIEW, "unified", "parquet", preview_metrics=True),
    # Ids read from CSV are texts, and ordered as such.
    O.audit("unified", CHOSEN[:1], 200).replace("order by key)", "order by id)"),
)
register("job_tag_summary", job_report(results.TAG_SUMMARY, "parquet"), ORACLES["tag_summary"])
_chosen = ", ".join(f"('{d}', '{s}')" for d, s in JOB_PAIRS)
register(
    "job_threshold_sweep",
    job_report(results.SWEEP, "parquet", audit=True),
    ORACLES["threshold_sweep"].replace(
        "from grid left join scored on", f"from grid left join (select * from scored where (dashboard_col, source_col) in ({_chosen})) as scored on"
    ),
)
