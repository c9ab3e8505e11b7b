"""Column matching and cell audits: the job-level operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import align as A, candidates as N, rank as R, scoring as S, tfidf
from .profiles import Profile, get_profile
from .workspace import Workspace, task_count

NO_COMMON_IDS = "no common ids between source and dashboard"


@dataclass(frozen=True)
class MatchResult:
    #: One row per matched dashboard column, best first.
    mapping: DataFrame
    #: Every column pair with a hit (profiles that report candidates), else ``None``.
    candidates: DataFrame | None


@dataclass(frozen=True)
class _Sides:
    source: DataFrame
    dash: DataFrame
    source_cols: list[str]
    dash_cols: list[str]
    aligned: DataFrame


def _sides(
    profile: Profile,
    source: DataFrame,
    dash: DataFrame,
    id_source: str,
    id_dash: str,
    source_cols: Sequence[str] | None,
    dash_cols: Sequence[str] | None,
    source_order: Sequence[str],
    dash_order: Sequence[str],
    null_ids: str,
) -> _Sides:
    A.require_columns(source, [id_source, *source_order], "source")
    A.require_columns(dash, [id_dash, *dash_order], "dashboard")

    tasks = task_count(source, dash)

    def side(df, id_col, cols, order, what):
        cols = list(A.candidate_columns(df, id_col, order) if cols is None else cols)
        A.require_columns(df, cols, what)
        if profile.merge_duplicates:
            return A.merge_duplicates(df, id_col, cols, order, null_ids, tasks=tasks), cols
        A.require_unique_ids(df, id_col, what, null_ids)
        return A.side_table(df, id_col, cols, null_ids, tasks), cols

    s, s_cols = side(source, id_source, source_cols, source_order, "source")
    d, d_cols = side(dash, id_dash, dash_cols, dash_order, "dashboard")
    return _Sides(s, d, s_cols, d_cols, A.align(s, d))


def _sampled(profile: Profile, aligned: DataFrame, sample_rows: int | None) -> DataFrame:
    if sample_rows is None or (sample_rows == 0 and not profile.zero_sample_is_empty):
        return aligned
    return A.sample_ids(aligned, sample_rows)


def _named(df: DataFrame, sides: _Sides, columns: Sequence[str]) -> DataFrame:
    """Column ordinals to names."""

    def name(cols, ord_col):
        return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(ord_col) + 1)

    named = df.withColumns(
        {
            "dashboard_col": name(sides.dash_cols, "d_ord"),
            "source_col": name(sides.source_cols, "s_ord"),
        }
    )
    return named.select(*columns)


def _vocabulary(profile: Profile, sides: _Sides, ws: Workspace) -> DataFrame:
    docs = tfidf.corpus(profile, sides.source, sides.dash, sides.aligned)
    return ws.table(tfidf.document_frequency(docs), "vocabulary")


def containment_cells(profile: Profile, aligned: DataFrame, *keep: str) -> DataFrame:
    """Scores on the joined row itself: native, so no cell text is ever shuffled."""
    pairs = A.expand_pairs(S.with_features(profile, aligned), *keep)
    filled = F.col("d.raw").isNotNull() & F.col("s.raw").isNotNull()
    scores = S.containment_score(profile, F.col("d"), F.col("s"))
    return pairs.select(
        *keep,
        F.col("d.ord").alias("d_ord"),
        F.col("s.ord").alias("s_ord"),
        *[F.when(filled, v).alias(k) for k, v in scores.items()],
    )


def _scored_pairs(profile: Profile, sides: _Sides, cells: DataFrame, ws: Workspace, prune: bool) -> DataFrame:
    """Column-pair rows with a count and their score, tag or metrics (null on null pairs)."""
    pairs = A.expand_pairs(S.with_features(profile, cells))
    collapsed = ws.table(S.collapse(S.resolve(profile, pairs, prune=prune)), "pairs")
    vocabulary = _vocabulary(profile, sides, ws)
    open_rows = collapsed.where("state = 'open'").select(
        "ck", "d_ord", "s_ord", "n", "tag", "penalty", "d_els", "s_els"
    )
    scored = S.score_open(profile, open_rows, vocabulary, ws, prune=prune).drop("ck")
    score = "final" if profile.scorer == "unified" else "score"
    settled = collapsed.where("state <> 'open'").select(
        "d_ord", "s_ord", "n", "tag", F.col("known").alias(score)
    )
    return scored.unionByName(settled, allowMissingColumns=True)


def match_columns(
    source: DataFrame,
    dash: DataFrame,
    id_source: str,
    id_dash: str | None = None,
    profile: str | Profile = "tagged",
    *,
    source_cols: Sequence[str] | None = None,
    dash_cols: Sequence[str] | None = None,
    source_order: Sequence[str] = (),
    dash_order: Sequence[str] = (),
    sample_rows: int | None = None,
    one_to_one: bool | None = None,
    null_ids: str = "match",
    **changes,
) -> MatchResult:
    """Which source column feeds which dashboard column.

    ``changes`` override profile fields (``min_ratio``, ``tag_thresholds``,
    ``min_support``, ``merge_duplicates``, ...).  ``*_order`` names the columns
    that order the rows of a repeated id when duplicates are merged; they are
    not matched themselves.  Raises ``ValueError`` without a common id.
    """
    p = get_profile(profile, **changes)
    sides = _sides(
        p, source, dash, id_source, id_dash or id_source, source_cols, dash_cols,
        source_order, dash_order, null_ids,
    )
    spark = source.sparkSession
    cells = _sampled(p, sides.aligned, sample_rows)
    ws = Workspace(spark)
    if p.scorer == "containment":
        scored = containment_cells(p, cells).withColumn("n", F.lit(1))
        statistics = N.mean_statistics(scored)
    else:
        scored = _scored_pairs(p, sides, cells, ws, prune=True)
        if p.scorer == "unified":
            statistics = N.mean_statistics(scored, S.METRICS[-1:] + S.METRICS[:-1])
        elif p.scorer == "rowwise":
            statistics = N.mean_statistics(scored)
        else:
            statistics = N.hit_statistics(p, scored)
    # At most one row per column pair; once it is written the large tables can go.
    statistics = ws.table(statistics, "statistics")
    ws.drop("pairs", "vocabulary", "elements")
    if statistics.isEmpty() and sides.dash_cols and sides.source_cols:
        if not A.has_common_ids(sides.source, sides.dash):
            raise ValueError(NO_COMMON_IDS)
    if p.counts_hits:
        candidates = N.hit_candidates(p, statistics)
    else:
        whole = None
        if p.coverage_over == "aligned" and sample_rows is not None:
            whole = sides.aligned.count()
        candidates = N.mean_candidates(p, statistics, whole)
    if "score" in candidates.columns:
        candidates = candidates.withColumnRenamed("score", "avg_score")
    exclusive = p.one_to_one if one_to_one is None else one_to_one
    mapping = _named(R.choose(p, candidates, exclusive), sides, R.mapping_columns(p))
    reported = None
    if p.statistics == "weighted":
        reported = _named(R.ordered(p, candidates), sides, R.candidate_output(p))
    return MatchResult(mapping, reported)


# ---- audit ----------------------------------------------------------------------------------

AUDIT_VALUES = ["dashboard_col", "source_col", "dashboard_val", "source_val"]


def audit_columns(profile: Profile) -> list[str]:
    if profile.scorer == "containment":
        return ["id_c", *AUDIT_VALUES, "score", "substring_hit", "token_containment", "list_item_hit"]
    if profile.scorer == "unified":
        return [*S.METRICS, "id_c", *AUDIT_VALUES]
    return ["id", *AUDIT_VALUES, "score", *(["tag"] if profile.scorer == "tagged" else [])]


def _audit_schema(profile: Profile) -> str:
    text = {"id", "id_c", *AUDIT_VALUES, "tag"}
    return ", ".join(f"{c} {'string' if c in text else 'double'}" for c in audit_columns(profile))


def _first_of_each_pair(rows: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.asc_nulls_last("key")))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def mapped_pairs(mapping: DataFrame) -> list[tuple[str, str]]:
    """The chosen column names, in mapping order: at most one per dashboard column."""
    return [(r[0], r[1]) for r in mapping.select("dashboard_col", "source_col").toLocalIterator()]


def audit_cells(
    source: DataFrame,
    dash: DataFrame,
    id_source: str,
    id_dash: str | None = None,
    pairs: Sequence[tuple[str, str]] = (),
    profile: str | Profile = "tagged",
    *,
    max_rows: int | None = None,
    source_cols: Sequence[str] | None = None,
    dash_cols: Sequence[str] | None = None,
    source_order: Sequence[str] = (),
    dash_order: Sequence[str] = (),
    null_ids: str = "match",
    **changes,
) -> DataFrame:
    """Cell-by-cell scores of the given (dashboard, source) column pairs.

    All of them, or the first ``max_rows`` rows of each pair by id.  Unless only hits
    are kept, rows are cut before scoring: the cut does not depend on scores.
    The gram weights are fitted on the same cells as the mapping's.
    """
    p = get_profile(profile, **changes)
    spark = source.sparkSession
    sides = _sides(
        p, source, dash, id_source, id_dash or id_source, source_cols, dash_cols,
        source_order, dash_order, null_ids,
    )
    if p.audit_needs_common_ids and not A.has_common_ids(sides.source, sides.dash):
        raise ValueError(NO_COMMON_IDS)
    known = [(dc, sc) for dc, sc in pairs if dc in sides.dash_cols and sc in sides.source_cols]
    if len(known) < len(pairs) and not p.audit_needs_common_ids:
        raise ValueError(f"unknown column pair among {list(pairs)}")
    # Elsewhere an unknown column is all null, and null pairs have no row.
    if not known:
        return spark.createDataFrame([], _audit_schema(p))

    def cell(array, columns, name):
        return F.element_at(F.col(array), columns.index(name) + 1)

    # ``ord`` numbers the requested pairs; each row carries just its own two cells.
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                cell("d_cells", sides.dash_cols, dc)["raw"].alias("d_raw"),
                cell("s_cells", sides.source_cols, sc)["raw"].alias("s_raw"),
            )
            for i, (dc, sc) in enumerate(known)
        ]
    )
    rows = (
        sides.aligned.select("id", "key", F.explode(wanted).alias("p"))
        .where("p.d_raw is not null and p.s_raw is not null")
        .select("id", "key", F.col("p.ord").alias("pair"), "p.d_raw", "p.s_raw")
    )
    order = [F.asc("pair"), F.asc_nulls_last("key")]
    if max_rows is not None and not p.audit_hits_only:
        rows = _first_of_each_pair(rows, max_rows)
    rows = rows.select(
        "*",
        F.array(F.struct(F.col("pair").alias("ord"), F.col("d_raw").alias("raw"))).alias("d_cells"),
        F.array(F.struct(F.col("pair").alias("ord"), F.col("s_raw").alias("raw"))).alias("s_cells"),
    )
    keys = ["id", "key", "pair", "d_raw", "s_raw"]
    ws = Workspace(spark)
    if p.scorer == "containment":
        scored = containment_cells(p, rows, *keys)
    else:
        resolved = S.resolve(
            p, A.expand_pairs(S.with_features(p, rows), *keys), *keys, prune=p.audit_hits_only
        )
        table = ws.table(resolved.withColumn("ck", F.monotonically_increasing_id()), "rows")
        vocabulary = _vocabulary(p, sides, ws)
        open_rows = table.where("state = 'open'").select(*keys, "ck", "tag", "penalty", "d_els", "s_els")
        found = S.score_open(p, open_rows, vocabulary, ws, prune=p.audit_hits_only).drop("ck")
        score = "final" if p.scorer == "unified" else "score"
        settled = table.where("state = 'known'").select(*keys, "tag", F.col("known").alias(score))
        scored = found.unionByName(settled, allowMissingColumns=True)
    if p.audit_hits_only:
        scored = scored.where(N.is_hit(p, F.col("score"), F.col("tag")))

    def column(i):
        names = F.array(*[F.lit(pair[i]) for pair in known])
        return F.element_at(names, F.col("pair") + 1)

    out = scored.withColumns(
        {
            "id_c": F.col("id"),
            "dashboard_col": column(0),
            "source_col": column(1),
            "dashboard_val": F.col("d_raw"),
            "source_val": F.col("s_raw"),
        }
    )
    if max_rows is not None and p.audit_hits_only:
        out = _first_of_each_pair(out, max_rows)
    out = ws.table(out.select("pair", "key", *audit_columns(p)), "audit")
    ws.drop("rows", "vocabulary", "elements")
    return out.orderBy(*order).select(*audit_columns(p))
