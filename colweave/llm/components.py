"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.workspace import Workspace

#: Links that one task may hold: 16 bytes each, and a few times that while it works.
ONE_TASK = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands the least vertex around it to its greater neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its least smaller neighbour to itself and its other smaller neighbours (u > v throughout)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    passed = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return passed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex but the least of its component, and that least one."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(names))
    while True:  # hand the least number on, and take short cuts
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, least[a], low)
        np.minimum.at(now, least[b], low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    moved = np.flatnonzero(least != np.arange(len(names)))
    return names[moved], names[least[moved]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        found = forest(held["u"].to_numpy(), held["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, work: Workspace, name: str, rows: int) -> DataFrame:
    """``edges`` (u, v: long; ``rows`` of them) -> (u, v): each vertex but the least of its component, and that least one.

    Up to ``ONE_TASK`` links are joined by one task of bounded size.  More go through
    rounds of two steps that keep components whole and end in one star per component
    after a logarithmic number of rounds.  Hot vertices are joined on their own key
    (which the planner splits) and aggregated before they are shuffled.  The driver
    sees a count and a checksum per round, told by the round's write.
    """
    if rows <= ONE_TASK:
        return work.table(_in_one_task(edges), f"{name}_0")
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, k = None, 0
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    while True:
        table, sums = work.counted(now, f"{name}_{k}", checksum=checksum)
        if k:
            work.drop(f"{name}_{k - 1}")
        if sums == seen or not sums["n"]:
            return table
        seen, now, k = sums, _small_star(_large_star(table)), k + 1
