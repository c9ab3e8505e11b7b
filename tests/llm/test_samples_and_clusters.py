"""Bounded fitting samples under repeated rows, real clusters, and rejection of a language left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.llm import language, quality_model
from colweave.llm.common import fold

SF = "/root/testdata/sf0.01"


def test_clusters_hold_a_share_each():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(0, 1, (400, 30)))
    x[::2, :10] += 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = rng.integers(1, 4, 400).astype(float)
    centers, own = language.cluster(x, weight)
    assert len(centers) == language.CENTROIDS
    assert np.bincount(own, weight).min() >= language.LEAST * weight.sum()
    for c in range(len(centers)):  # unit means of their own rows
        mean = (weight[own == c, None] * x[own == c]).sum(0)
        assert np.allclose(centers[c], mean / np.linalg.norm(mean))
    alike, _ = language.cluster(np.repeat(x[:1], 50, 0))
    assert len(alike) == 1


def test_left_out_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold() != 2).where("lang <> 'es'"))
    told, x = language.identify(docs.where(fold() == 2), model)
    rows = told.where("lang is not null").groupBy(F.col("lang") == "es").agg(F.avg(F.col(f"{x}.rejected").cast("int"))).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[True] >= 0.8 and share[False] <= 0.2


def test_repeated_rows_do_not_enlarge_the_samples(spark, monkeypatch):
    """Twenty thousand equal rows are one weighted row of the fitting task."""
    seen = spark.sparkContext.accumulator(0)
    cluster, minimise = language.cluster, quality_model.minimise

    def counted_cluster(x, weight=None, *rest):
        seen.add(len(x))
        return cluster(x, weight, *rest)

    def counted_minimise(p, u, *rest, **more):
        seen.add(len(p) + len(u))
        return minimise(p, u, *rest, **more)

    monkeypatch.setattr(language, "cluster", counted_cluster)
    monkeypatch.setattr(quality_model, "minimise", counted_minimise)
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("other words "), "id").alias("text"), F.lit("en").alias("lang"))
    docs = same.unionByName(other)
    model = language.fit(docs)
    assert set(model.langs) == {"en"}
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    fitted = quality_model.fit(docs, labels)
    assert 0 <= fitted.score("the same words again") <= 1
    assert seen.value <= 301 + 2 * 301


def test_weights_stand_for_repeated_rows():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (20, 4)), rng.normal(0, 1, (30, 4))
    wp, wu = rng.integers(1, 5, 20), rng.integers(1, 5, 30)
    a = quality_model.minimise(p, u, 0.4, 30, wp=wp, wu=wu)
    b = quality_model.minimise(np.repeat(p, wp, 0), np.repeat(u, wu, 0), 0.4, 30)
    assert np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)
