"""Statistics per column pair, from scored cell pairs with their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.profiles import TAGS, Profile
from .scoring import METRICS

PAIR = ("d_ord", "s_ord")


def is_hit(profile: Profile, score: Column, tag: Column) -> Column:
    """Score reaches its tag's threshold; an unlisted tag uses the global one."""
    if profile.tag_thresholds is None:
        return score >= F.lit(profile.min_ratio)
    threshold = F.lit(profile.min_ratio)
    for name, value in profile.tag_thresholds.items():
        threshold = F.when(tag == name, F.lit(float(value))).otherwise(threshold)
    return score >= threshold


def _total(n: Column, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")


def exact_sum(value: Column, n: Column) -> Column:
    """Sum of ``value`` times ``n``, the same in whatever order and grouping the rows come, so that ties stay ties.

    A score's 17 digits behind the point are summed as decimals.
    """
    return F.sum(value.cast("decimal(22,17)") * n.cast("decimal(15,0)")).cast("double")


def mean_statistics(scored: DataFrame, metrics: tuple[str, ...] = ("score",)) -> DataFrame:
    """Weighted mean of each metric over non-null pairs, 0.0 if there are none, and their count.

    ``score`` (or each metric) is null on the rows that only count null pairs.
    """
    n = F.col("n")
    live = F.col(metrics[0]).isNotNull()
    support = _total(n, live)
    means = [
        F.coalesce(exact_sum(F.col(m), n) / F.sum(F.when(live, n)), F.lit(0.0)).alias(m) for m in metrics
    ]
    return scored.groupBy(*PAIR).agg(*means, support.alias("support"), F.sum(n).alias("rows"))


def hit_statistics(profile: Profile, scored: DataFrame) -> DataFrame:
    """Hits, their mean and maximum, the weighted score and the hits of each tag."""
    n, score, tag = F.col("n"), F.col("score"), F.col("tag")
    hit = F.col("hit")
    live = score.isNotNull()
    counts = []
    if profile.tag_counts:
        named = tag.isin(*TAGS[:-1])
        for name in TAGS:
            cond = tag == name
            if name == "similarity" and profile.tag_thresholds is None:
                cond = ~named  # a hit with no tag of its own counts here
            counts.append(_total(n, hit & cond).alias(f"{name}_hits"))
    rows = scored.withColumn("hit", F.coalesce(is_hit(profile, score, tag), F.lit(False)))
    return rows.groupBy(*PAIR).agg(
        _total(n, hit).alias("hits"),
        _total(n, live).alias("total_pairs"),
        exact_sum(F.when(hit, score), n).alias("weighted_score"),
        F.max(F.when(hit, score)).alias("max_score"),
        *counts,
    )


def hit_candidates(profile: Profile, statistics: DataFrame) -> DataFrame:
    """Pairs with at least one hit and their derived ratios."""
    hits, total = F.col("hits"), F.col("total_pairs")
    kept = statistics.where(hits > 0)
    average = F.col("weighted_score") / hits
    if profile.statistics == "hits":
        return kept.select(*PAIR, average.alias("avg_score"), "max_score", hits.alias("support"))
    tags = [f"{t}_hits" for t in TAGS] if profile.tag_counts else []
    return kept.select(
        *PAIR,
        "hits",
        "total_pairs",
        (hits / total).alias("hit_rate"),
        average.alias("avg_score"),
        "max_score",
        "weighted_score",
        (F.col("weighted_score") / total * 100.0).alias("score_pct"),
        *tags,
    )


def mean_candidates(profile: Profile, statistics: DataFrame, aligned_rows: int | None = None) -> DataFrame:
    """Pairs with enough support; coverage over the sampled or over all aligned rows."""
    kept = statistics.where(F.col("support") >= profile.min_support)
    if profile.coverage_over is None:
        return kept.drop("rows")
    rows = F.col("rows") if aligned_rows is None else F.lit(aligned_rows)
    return kept.withColumn("coverage", F.col("support") / F.greatest(rows, F.lit(1))).drop("rows")


__all__ = ["METRICS", "hit_candidates", "hit_statistics", "is_hit", "mean_candidates", "mean_statistics"]
