"""Choosing, labelling and ordering: all on the small table of column pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.profiles import Profile
from .scoring import METRICS

WEIGHTED_KEYS = ("weighted_score", "avg_score", "hits", "hit_rate")


def _down(column: str) -> Column:
    """Descending key; rounded, as sums taken in another order differ in the last bit."""
    return F.desc(F.round(F.col(column).cast("double"), 12))


def score_column(profile: Profile) -> str:
    return "final" if profile.scorer == "unified" else "avg_score"


def rank_keys(profile: Profile) -> tuple[str, ...]:
    return WEIGHTED_KEYS if profile.statistics == "weighted" else (score_column(profile),)


def order_keys(profile: Profile) -> tuple[str, ...]:
    """Keys of the final order, ties in original column order."""
    if profile.statistics == "weighted":
        return WEIGHTED_KEYS
    if profile.coverage_over is not None:
        return (score_column(profile), "coverage", "support")
    return ("avg_score", "support")


def rank_column(profile: Profile) -> str:
    return "rank" if profile.statistics == "hits" else "rank_in_dashboard"


def best_sources(profile: Profile, candidates: DataFrame) -> DataFrame:
    """Rank source columns inside a dashboard column and keep the first."""
    keys = [_down(k) for k in rank_keys(profile)]
    window = Window.partitionBy("d_ord").orderBy(*keys, F.asc("s_ord"))
    name = rank_column(profile)
    return candidates.withColumn(name, F.row_number().over(window)).where(F.col(name) == 1)


def one_to_one(profile: Profile, best: DataFrame) -> DataFrame:
    """A source column keeps its best dashboard column; the others get no second choice."""
    window = Window.partitionBy("s_ord").orderBy(_down(score_column(profile)), F.asc("d_ord"))
    return best.withColumn("turn", F.row_number().over(window)).where("turn = 1").drop("turn")


def _steps(score: Column, steps: list[tuple[float, str]]) -> Column:
    label = F.lit("uncertain")
    for bound, name in reversed(steps):
        label = F.when(score >= bound, F.lit(name)).otherwise(label)
    return label


def suggestion(profile: Profile) -> Column:
    """Confidence label of a chosen pair (label texts and bounds are fixed values)."""
    if profile.statistics == "weighted":
        rate, average = F.col("hit_rate"), F.col("avg_score")
        return (
            F.when((rate >= 0.90) & (average >= profile.high_ratio), "exact/very likely (strong coverage)")
            .when((rate >= 0.75) & (average >= profile.min_ratio), "likely (good coverage)")
            .when((rate >= 0.50) & (average >= profile.min_ratio), "possible (review)")
            .otherwise("uncertain")
        )
    if profile.statistics == "hits":
        return F.when(F.col("max_score") >= profile.high_score, "exact match").otherwise(
            _steps(
                F.col("avg_score"),
                [(profile.high_ratio, "very likely match"), (profile.min_ratio, "likely match")],
            )
        )
    if profile.scorer == "rowwise":
        return _steps(
            F.col("avg_score"), [(0.95, "exact/substring"), (0.85, "very likely"), (0.70, "likely (review)")]
        )
    return _steps(
        F.col(score_column(profile)),
        [(0.95, "exact/substring match"), (0.85, "very likely match"), (0.75, "likely match (review)")],
    )


def ordered(profile: Profile, df: DataFrame) -> DataFrame:
    return df.orderBy(*[_down(k) for k in order_keys(profile)], "d_ord", "s_ord")


def mapping_columns(profile: Profile) -> list[str]:
    """Output columns of the mapping, in order."""
    pair = ["dashboard_col", "source_col"]
    if profile.scorer == "unified":
        return [*METRICS, *pair, "support", "coverage", "rank_in_dashboard", "suggestion"]
    if profile.statistics == "weighted":
        return [*candidate_output(profile), "suggestion"]
    if profile.statistics == "hits":
        return [*pair, "avg_score", "max_score", "support", "rank", "suggestion"]
    coverage = ["coverage"] if profile.coverage_over else []
    return [*pair, "avg_score", *coverage, "support", "rank_in_dashboard", "suggestion"]


def candidate_output(profile: Profile) -> list[str]:
    tags = ["direct_hits", "list_hits", "listlike_hits", "similarity_hits"] if profile.tag_counts else []
    return [
        "dashboard_col", "source_col", "hits", "total_pairs", "hit_rate", "avg_score",
        "max_score", "weighted_score", "score_pct", *tags,
    ]


def choose(profile: Profile, candidates: DataFrame, exclusive: bool) -> DataFrame:
    """Candidates to labelled mapping in its final order."""
    best = best_sources(profile, candidates)
    if exclusive:
        best = one_to_one(profile, best)
    return ordered(profile, best.withColumn("suggestion", suggestion(profile)))
