"""Reports on a finished run: hits per tag and the threshold sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.profiles import TAG_THRESHOLDS, TAGS

HIT_COLUMNS = [f"{t}_hits" for t in TAGS]


def tag_summary(candidates: DataFrame, tag_thresholds: Mapping[str, float] = TAG_THRESHOLDS) -> DataFrame:
    """Total hits per tag column present, its threshold and its share of all hits in percent."""
    present = [c for c in HIT_COLUMNS if c in candidates.columns]
    if not present:
        raise ValueError("the candidates hold no tag hit column")
    totals = candidates.agg(
        *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long").alias(c) for c in present]
    )
    everything = sum((F.col(c) for c in present[1:]), F.col(present[0])).cast("double")
    rows = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("Tag"),
                        F.col(c).alias("Total_Hits"),
                        F.lit(tag_thresholds.get(c.removesuffix("_hits"))).cast("double").alias("Threshold"),
                        F.bround(
                            F.col(c) / F.when(everything == 0, F.lit(1.0)).otherwise(everything) * 100, 2
                        ).alias("Relative_%"),
                    )
                    for c in present
                ]
            )
        )
    )
    return rows


# Fixed values, in thousandths: how far to sweep around a tag's threshold, the least and the
# greatest threshold to try, the threshold of a tag without one, and the distance of two points.
SWEEP_REACH = {"similarity": (150, 300, 950, 600)}
SWEEP_REACH_ELSE = (50, 500, 990, 700)
SWEEP_STEP = 25


def sweep_grid(base: Mapping[str, float] = TAG_THRESHOLDS) -> dict[str, list[float]]:
    """Thresholds to try per tag: narrow around those of the fast paths, wide around that of similarity."""
    grid = {}
    for tag in TAGS:
        reach, least, most, usual = SWEEP_REACH.get(tag, SWEEP_REACH_ELSE)
        middle = round(1000 * base[tag]) if tag in base else usual
        points = range(max(least, middle - reach), min(most, middle + reach) + 1, SWEEP_STEP)
        grid[tag] = [p / 1000 for p in points]
    return grid


def threshold_sweep(
    audit: DataFrame,
    base: Mapping[str, float] = TAG_THRESHOLDS,
    grid: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Hits, hit rate and mean hit score of each tag's rows at each threshold of the grid.

    The audit is aggregated once, with one conditional count and sum per grid
    point, so it is neither sorted nor multiplied by the grid.
    """
    missing = {"score", "tag"} - set(audit.columns)
    if missing:
        raise ValueError(f"the audit has no column {', '.join(sorted(missing))}")
    grid = sweep_grid(base) if grid is None else grid
    points = [(tag, float(t)) for tag, thresholds in grid.items() for t in thresholds]
    score, tag_col = F.col("score").cast("double"), F.col("tag")
    counts = []
    for i, (tag, at) in enumerate(points):
        hit = (tag_col == tag) & (score >= at)
        counts += [
            F.count_if(hit).alias(f"hits{i}"),
            F.sum(F.when(hit, score)).alias(f"sum{i}"),
        ]
    rows = [F.count_if(tag_col == tag).alias(f"rows{k}") for k, tag in enumerate(grid)]
    totals = audit.agg(*counts, *rows)
    order = {tag: k for k, tag in enumerate(grid)}

    def point(i: int, tag: str, at: float):
        hits, seen = F.col(f"hits{i}"), F.col(f"rows{order[tag]}")
        return F.struct(
            F.lit(tag).alias("tag"),
            F.lit(round(at, 3)).alias("threshold"),
            hits.alias("hits"),
            seen.alias("rows_considered"),
            F.bround(F.when(seen > 0, hits / seen).otherwise(F.lit(0.0)), 4).alias("hit_rate"),
            F.bround(F.when(hits > 0, F.col(f"sum{i}") / hits).otherwise(F.lit(0.0)), 4).alias("avg_score_of_hits"),
        )

    return totals.select(F.inline(F.array(*[point(i, t, at) for i, (t, at) in enumerate(points)])))
