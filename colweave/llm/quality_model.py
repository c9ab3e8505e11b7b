"""Quality classifier: a positive-unlabelled (PU) classifier with the non-negative risk.

A linear model over shares of hashed byte 3-grams and a few counts of the text is
fitted by gradient descent on the non-negative unbiased risk with logistic loss:
``prior * R_P(+)`` plus the part of ``R_U(-) - prior * R_P(-)`` above 0; a batch in
which that part falls below 0 steps back on it.  P are trusted positives (label
1), U is unlabelled web text, and the class prior is estimated as the share of
label 1 among the labelled documents.  The score is the model's probability.

Scale: the fit sees bounded samples, at most ``POSITIVES`` labelled ids that have a
document and about ``UNLABELLED`` different documents (both by id hash), as vectors
of fixed length in one task; the prior counts all labels.  Only ids are shuffled to
choose them.  Scoring is one pass without a shuffle.

Edge cases: null and empty texts have a vector of zeros and are scored like any
other; null labels and ids are left out of the training; a document with several
labels counts with the least; without positives or unlabelled text every score is
the prior (0.5 without any label); repeated rows count as often as they come, as one
row of the sample with their number as its weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name
from .quality_rules import base_counts

BITS = 9
POSITIVES = 5000
UNLABELLED = 5000
STEPS = 120
RATE = 0.05
DECAY = 1e-2
THRESHOLD = 0.7
N_COUNTS = 9

QUALITY = "struct<score: double, predicted: int>"
_QUALITY = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def features(text: str | None) -> np.ndarray:
    """Counts of the text as shares, then its n-gram shares (square roots)."""
    out = np.zeros(N_COUNTS + (1 << BITS), np.float32)
    if not text:
        return out
    raw, c = text.encode(), base_counts(text)
    words = raw.split()
    n, size, lines = max(len(words), 1), len(raw), text.count("\n") + 1
    out[:N_COUNTS] = [
        np.log1p(n) / 10,
        min(c["word_chars"] / n, 50) / 10,
        c["n_symbols"] / size,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / n,
        len(set(words)) / n,
        (size - len(raw.translate(None, _UPPER))) / size,
        (size - len(raw.translate(None, _DIGITS))) / size,
        np.log1p(size / lines) / 10,
    ]
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        found = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        out[N_COUNTS:] = np.sqrt(found / found.sum())
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        z = float(features(text) @ self.weights) + self.bias
        return round(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))), 6)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(zp: np.ndarray, zu: np.ndarray, prior: float, wp=None, wu=None) -> tuple[float, float]:
    """Risk of the positives as positives, and the unlabelled text's negative risk less the positives' part."""
    loss = lambda z, w: np.average(np.logaddexp(0, -z), weights=w)
    return prior * loss(zp, wp), loss(-zu, wu) - prior * loss(-zp, wp)


def minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, wp=None, wu=None) -> Model:
    """Minimise the non-negative risk over positives ``p`` and unlabelled rows ``u`` (Adam, whole samples).

    ``wp`` and ``wu`` weigh the rows; without them all count alike.
    """
    wp, wu = (np.ones(len(x)) if w is None else w for x, w in ((p, wp), (u, wu)))
    wp, wu = wp / wp.sum(), wu / wu.sum()
    mean = wu @ u
    scale = np.sqrt(wu @ (u - mean) ** 2) + 1e-3
    p, u = (p - mean) / scale, (u - mean) / scale
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        positive = prior * (sp - 1) * wp
        negative_p, negative_u = -prior * sp * wp, su * wu
        if risks(zp, zu, prior, wp, wu)[1] >= 0:
            gp, gu = positive + negative_p, negative_u
        else:
            gp, gu = -negative_p, -negative_u
        grad = np.append(p.T @ gp + u.T @ gu + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model((w / scale).astype(np.float64), float(b - (w / scale) @ mean))


def fit(train: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Train on documents ``train`` and on those labels whose documents it may use."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    total = marks.agg(F.count("*").alias("n"), F.count_if(F.col("q") == 1).alias("good")).first()
    prior = min(max(total["good"] / total["n"], 0.01), 0.99) if total["n"] else 0.5
    constant = Model(np.zeros(N_COUNTS + (1 << BITS)), float(np.log(prior / (1 - prior))))
    order = F.xxhash64(F.lit(23), "doc_id")
    docs = train.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    there = docs.select(F.col("id").alias("doc_id")).distinct()
    good = marks.where("q = 1").join(there, "doc_id", "left_semi")
    good = good.orderBy(order, "doc_id").limit(POSITIVES).select(F.col("doc_id").alias("good_id"))
    n = docs.count()
    if not n or not total["good"]:
        return constant

    @F.arrow_udf("binary")
    def vectors(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())

    share = int(min(1.0, UNLABELLED / n) * (1 << 30))
    flagged = docs.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").select(
        "id",
        "text",
        F.col("good_id").isNotNull().alias("p"),
        (F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30)) < share).alias("u"),
    )
    # Repeated rows come all or none: they are one row with a weight, combined before the shuffle.
    tag = F.xxhash64(F.lit(31), "text").alias("tag")
    sample = flagged.where("p or u").groupBy("id", "p", "u", tag).agg(F.min("text").alias("text"), F.count("*").alias("weight"))
    sample = sample.select("id", "tag", "p", "u", "weight", vectors("text").alias("x"))

    def minimise_all(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "tag"], kind="stable")
        x, weight = np.array([np.frombuffer(b, np.float32) for b in part["x"]]), part["weight"].to_numpy(float)
        p, u = part["p"].to_numpy(bool), part["u"].to_numpy(bool)
        if not p.any() or not u.any():
            return pd.DataFrame({"w": [], "b": []})
        model = minimise(x[p], x[u], prior, wp=weight[p], wu=weight[u])
        return pd.DataFrame({"w": [model.weights.tobytes()], "b": [model.bias]})

    # One task, as the sample is bounded.
    fitted = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(minimise_all, "w binary, b double").collect()
    return Model(np.frombuffer(fitted[0]["w"]), fitted[0]["b"]) if fitted else constant


def score_quality(df: DataFrame, model: Model, text_col: str = "text", result: str = "quality") -> tuple[DataFrame, str]:
    """The frame with one more column of type ``QUALITY``, and that column's name."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(QUALITY)
    def quality(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            scores = [shared.value.score(t.as_py()) for t in texts]
            yield pa.array([{"score": s, "predicted": int(s >= THRESHOLD)} for s in scores], _QUALITY)

    name = free_name(df, result)
    return df.withColumn(name, quality(F.col(text_col))), name
