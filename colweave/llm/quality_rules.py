"""Quality rules: counts per text, and a log-likelihood ratio of hashed n-grams.

Each run of three UTF-8 bytes is hashed to one of 2^15 buckets.  Two
multinomials are counted over the buckets: the raw corpus (every document) and
the trusted target (documents whose label says quality 1).  A document's score is
the mean over its n-grams of log p_target - log p_raw, both with ``SMOOTHING``
added to every bucket; a document below ``THRESHOLD`` nats an n-gram is rejected.
Threshold and hash are fixed, so the verdict on a text depends on the two counted
distributions alone.

Scale: one pass counts, one pass scores.  A task emits at most one row per bucket,
so that shuffle grows with the tasks, not with the n-grams.  Both counts cover all
their documents.  Documents that a bitmap of the trusted ids leaves open (the
trusted ones and few others) are joined with the ids and move their text once; the
rest is counted where it is read.  The model has a fixed size.

Edge cases: a null or empty text has no words and fails the base; a text of fewer
than three bytes has score 0; without any trusted document every score is 0; a
document with several labels is trusted if the least is 1; null labels and ids
are no labels; repeated documents count each time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, frugal, plain_words
from .near_dedup import id_filter

BITS = 15
SMOOTHING = 1.0
THRESHOLD = -0.5
MIN_WORDS = 50
_SYMBOLS = b"#*$%&|<>"  # fixed value

RULES = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
    "base_failed: boolean, llr: double, kept: boolean>"
)
_RULES = pa.struct(
    [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("llr", pa.float64()), ("kept", pa.bool_())]
)


def grams(raw: bytes) -> np.ndarray:
    """Bucket of each run of three bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit, last = 0, 0  # words before ``last`` are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit += i + 3 - max(i, last)
            last = i + 3
    return hit


def base_counts(text: str | None) -> dict:
    text = text or ""
    words, raw = plain_words(text), text.encode()
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\f")]
    n, repeats = len(words), repeated_words(words)
    return {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in " \t\n\r\x0b\f"),
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats,
        "base_failed": n < MIN_WORDS or 100 * repeats > 50 * n,
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id")


def count_grams(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per bucket: its n-grams in all documents (``raw``) and in trusted ones (``target``)."""
    trusted = trusted_ids(labels)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    maybe = F.col("id").isNotNull()
    if rows.schema["id"].dataType == trusted.schema["doc_id"].dataType:  # else equal ids may hash apart
        maybe = maybe & id_filter(trusted.select(F.col("doc_id").alias("id")))(F.col("id"))
    rows = rows.withColumn("maybe", maybe)
    unsure = rows.where("maybe").join(trusted.withColumnRenamed("doc_id", "trusted_id"), F.col("id") == F.col("trusted_id"), "left")
    flagged = unsure.select("text", F.col("trusted_id").isNotNull().alias("good"))
    flagged = flagged.unionByName(rows.where("not maybe").select("text", F.lit(False).alias("good")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    found = np.bincount(grams(text.as_py().encode()), minlength=1 << BITS)
                    raw += found
                    if good.as_py():
                        target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"]
        )

    counted = flagged.mapInArrow(frugal(count), "bucket int, raw bigint, target bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """Log-likelihood ratio per bucket (a vector of fixed length)."""
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in count_grams(docs, labels, text_col, id_col).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(1 << BITS)
    share = [np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x))) for x in (target, raw)]
    return share[0] - share[1]


def judge(text: str | None, ratios: np.ndarray, threshold: float = THRESHOLD) -> dict:
    counts = base_counts(text)
    found = grams((text or "").encode())
    llr = float(ratios[found].mean()) if len(found) else 0.0
    return counts | {"llr": llr, "kept": not counts["base_failed"] and llr >= threshold}


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    threshold: float = THRESHOLD,
    result: str = "rules",
) -> tuple[DataFrame, str]:
    """The documents with one more column of type ``RULES``, and that column's name."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col, id_col))

    @F.arrow_udf(RULES)
    @frugal
    def rules(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ratios = model.value
        for texts in it:
            yield pa.array([judge(t.as_py(), ratios, threshold) for t in texts], _RULES)

    name = free_name(docs, result)
    return docs.withColumn(name, rules(F.col(text_col))), name
