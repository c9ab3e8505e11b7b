"""Language identification: nearest of several centroids per language by cosine.

A text becomes a vector of hashed byte 3-grams of its lower-cased letters
(2^13 buckets, 1 + log tf, times idf, length 1).  The idf counts all training
documents.  Spherical k-means clusters the vectors of each language into
``CENTROIDS`` centroids, over a sample of about ``SAMPLE`` different training
documents per language (those whose hash falls under the language's share); a
language with fewer documents is used whole.  It starts from halves along the
direction in which a cluster spreads most and ends before a cluster would hold less
than ``LEAST`` of its language.  A text gets the language of the centroid with the
highest cosine.  It is marked rejected if that cosine is below the language's bound
for texts of its length: the ``OUTER`` quantile of the sampled texts' own cosines
within each of ``BANDS`` bands of the number of different n-grams.

Scale: one pass counts document frequencies and languages, one vectorises the
sample, one predicts; documents are never shuffled.  Driver, broadcast and each
language's fitting task hold only data whose size the parameters bound (at most
``MAX_LANGS`` languages, else an error).

Edge cases: a null text, or one without any letter, is ``und`` with score 0 and
not rejected; documents without a language do not train; with no training
document at all everything is ``und``; repeated rows train as one row with their
number as its weight, so they do not enlarge the sample, and are predicted as often
as they come; a null id belongs to no fold and trains; a language whose texts are
all alike has one centroid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

BITS = 13
CENTROIDS = 4
SAMPLE = 1000
MAX_LANGS = 1000
ROUNDS = 10
#: Least share of its language that a cluster holds.
LEAST = 0.05
BANDS = 5
OUTER = 0.02
UNKNOWN = "und"  # fixed value

LANGUAGE = "struct<lang: string, score: double, rejected: boolean>"
_LANGUAGE = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = bytes(c if c > 127 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's 3-grams, ascending, and how often each occurs."""
    words = (text or "").lower().encode().translate(_NO_LETTER).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    found = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = counts(text)
    v = (1 + np.log(tf)) * idf[at]
    return at, v / max(np.sqrt((v * v).sum()), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def halves(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether a row lies in the upper half along the direction in which the rows spread most."""
    rest = x - np.average(x, axis=0, weights=weight)
    along = rest[np.argmax((rest * rest).sum(1))]
    for _ in range(ROUNDS):
        along = rest.T @ (weight * (rest @ along))
        along /= max(np.linalg.norm(along), 1e-12)
    place = rest @ along
    order = np.argsort(place, kind="stable")
    below = np.cumsum(weight[order])
    middle = place[order[np.searchsorted(below, below[-1] / 2)]]
    upper = place > middle
    return upper if upper.any() else place >= middle


def centers_of(x: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    sums = np.array([weight[own == c] @ x[own == c] for c in range(own.max() + 1)])
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, weight: np.ndarray | None = None, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of the rows of ``x``, and the cluster of each row; each holds ``LEAST`` of the weight."""
    weight = np.ones(len(x)) if weight is None else weight
    least = LEAST * weight.sum()
    own, final = np.zeros(len(x), np.int64), set()
    while own.max() + 1 < k:  # halve the largest cluster that can be halved
        sizes = np.bincount(own, weight)
        open_ = [c for c in range(len(sizes)) if c not in final]
        if not open_:
            break
        c = max(open_, key=lambda c: sizes[c])
        at = np.flatnonzero(own == c)
        upper = at[halves(x[at], weight[at])]
        if min(weight[upper].sum(), sizes[c] - weight[upper].sum()) < max(least, 1e-12):
            final.add(c)
        else:
            own[upper] = len(sizes)
    for _ in range(ROUNDS):
        moved = np.argmax(x @ centers_of(x, weight, own).T, 1)
        if (moved == own).all() or np.bincount(moved, weight, own.max() + 1).min() < least:
            break
        own = moved
    return centers_of(x, weight, own), own


def bounds(cos: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each band of sizes, and the ``OUTER`` quantile of the cosines in it."""
    order = np.argsort(size, kind="stable")
    below = np.cumsum(weight[order]) - weight[order]
    starts = np.unique(size[order[np.searchsorted(below, below[-1] * np.arange(BANDS) / BANDS)]])
    band = np.searchsorted(starts, size, "right") - 1
    out = []
    for k in range(len(starts)):
        c, w = cos[band == k], weight[band == k]
        up = np.argsort(c, kind="stable")
        out.append(c[up[np.searchsorted(np.cumsum(w[up]), OUTER * w.sum())]])
    return starts.astype(float), np.array(out)


class Model:
    """``centers`` by row, each with its language and that language's bounds by length."""

    def __init__(self, langs: list[str], centers: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.langs, self.centers, self.bounds, self.idf = langs, centers, bounds, idf

    def predict(self, text: str | None) -> dict:
        if not self.langs or not has_letter(text):
            return {"lang": UNKNOWN, "score": 0.0, "rejected": False}
        at, v = vector(text, self.idf)
        cos = self.centers[:, at] @ v
        best = int(np.argmax(cos))
        score = round(min(max(float(cos[best]), 0.0), 1.0), 6)
        starts, least = self.bounds[best]
        band = max(int(np.searchsorted(starts, len(at), "right")) - 1, 0)
        return {"lang": self.langs[best], "score": score, "rejected": bool(cos[best] < least[band])}


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    rows = train.where(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")
    )
    per_lang = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(per_lang) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                df[counts(t.as_py())[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "df"])

    df, n = np.zeros(1 << BITS), sum(r["count"] for r in per_lang)
    found = rows.select("text").mapInArrow(frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    for r in found.collect():
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1

    # Of a language with n documents, those whose hash lies in the lowest SAMPLE / n of all hashes.
    share = {r["lang"]: SAMPLE / r["count"] for r in per_lang}
    picked = F.pmod(F.xxhash64(F.lit(17), "id", "text"), F.lit(1 << 30))
    limit: Column = F.lit(0)
    for lang, part in sorted(share.items()):
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, part) * (1 << 30)))).otherwise(limit)
    shared = train.sparkSession.sparkContext.broadcast(idf)

    @F.arrow_udf("struct<at: array<int>, v: array<float>>")
    def vectors(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            out = []
            for t in texts:
                at, v = vector(t.as_py(), shared.value)
                out.append({"at": at.tolist(), "v": v.tolist()})
            yield pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))]))

    def fit_lang(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "tag"], kind="stable")
        x, weight = np.zeros((len(part), 1 << BITS)), part["weight"].to_numpy(float)
        for i, (at, v) in enumerate(zip(part["at"], part["v"])):
            x[i, at] = v
        weight, x = weight[x.any(1)], x[x.any(1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "center": [], "starts": [], "least": []})
        centers, _ = cluster(x, weight)
        starts, least = bounds((x @ centers.T).max(1), (x > 0).sum(1), weight)
        return pd.DataFrame({
            "lang": key[0], "center": [c.astype("<f8").tobytes() for c in centers],
            "starts": [starts] * len(centers), "least": [least] * len(centers),
        })

    # Repeated rows come all or none: they are one row with a weight, combined before the shuffle.
    tag = F.xxhash64(F.lit(19), "text").alias("tag")
    sample = (
        rows.where(picked < limit).groupBy("lang", "id", tag).agg(F.min("text").alias("text"), F.count("*").alias("weight"))
        .select("lang", "id", "tag", "weight", vectors("text").alias("x")).select("lang", "id", "tag", "weight", "x.at", "x.v")
    )
    schema = "lang string, center binary, starts array<double>, least array<double>"
    fitted = sample.groupBy("lang").applyInPandas(fit_lang, schema).collect()
    fitted.sort(key=lambda r: (r["lang"], bytes(r["center"])))
    centers = np.array([np.frombuffer(r["center"], "<f8") for r in fitted]).reshape(len(fitted), 1 << BITS)
    limits = [(np.array(r["starts"]), np.array(r["least"])) for r in fitted]
    return Model([r["lang"] for r in fitted], centers, limits, idf)


def identify(df: DataFrame, model: Model, text_col: str = "text", result: str = "language") -> tuple[DataFrame, str]:
    """The frame with one more column of type ``LANGUAGE``, and that column's name."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(LANGUAGE)
    def language(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array([shared.value.predict(t.as_py()) for t in texts], _LANGUAGE)

    name = free_name(df, result)
    return df.withColumn(name, language(F.col(text_col))), name
