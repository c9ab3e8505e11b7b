"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens.

``STAGES`` are applied in order, each to all rows its predecessor kept, written as
Parquet and read again between them.  All but the last return the columns of
``documents``.  Rows with null texts fail the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colweave.llm import bpe, decontaminate, near_dedup, quality_rules, queries, secrets
from colweave.llm.common import table
from colweave.plans.workspace import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near-duplicates of the pipeline: shared shingles of at least 80 in 100.
SIMILARITY = (80, 100)

#: Bytes that a worker remembers of the tokenizer's pieces: the other stages run on the same executors.
CACHE_BYTES = 8 << 20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged, x = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col(f"{x}.kept")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id."""
    return near_dedup.keep_representatives(docs, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits, x = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.where(F.size(f"{x}.spans") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars`` follows the text where it is there."""
    found, x = secrets.find_secrets(docs, overlapping=True)
    out = found.withColumn("text", secrets.redact(F.col("text"), F.col(x))).drop(x)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids."""
    tokenizer = bpe.Tokenizer(spark, *queries.vocabulary(), cache_bytes=CACHE_BYTES, keep=False)
    encoded, ids = tokenizer.encode(docs.select("doc_id", "text"))
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("minhash_dedup", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is written to the checkpoint folder."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.table(docs, f"{k}_{name}")
    return docs


#: Hashed n-grams, entropy windows and merges are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None
