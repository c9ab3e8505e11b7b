"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe,
    chat,
    decontaminate,
    language,
    lexical,
    licences,
    near_dedup,
    phrases,
    pii,
    quality_model,
    quality_rules,
    reputation,
    secrets,
)
from .common import fold, table
from .sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hits, h = decontaminate.benchmark_hits(docs, table(spark, sf, "benchmark"))
    n_hit = F.aggregate(f"{h}.spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return hits.select(
        "doc_id",
        F.col(f"{h}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{h}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{h}.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found, x = licences.find_licences(docs)
    names = F.array_sort(F.array_distinct(F.transform(f"{x}.matches", lambda m: m["licence"])))
    return found.select(
        "doc_id",
        F.col(f"{x}.n_sentences").alias("n_sentences"),
        F.size(f"{x}.matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
    )


def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    judged = reputation.judge_urls(table(spark, sf, "pages"), table(spark, sf, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(F.coalesce(fold() != 2, F.lit(True))))
    told, x = language.identify(docs.select("doc_id", "text"), model)
    return told.select(
        "doc_id",
        F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
        F.col(f"{x}.lang").alias("lang_pred"),
        F.col(f"{x}.score").alias("score"),
        F.col(f"{x}.rejected").alias("rejected"),
    )


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    model = quality_model.fit(docs.where(fold() != 2), labels.where(fold() != 2))
    scored, x = quality_model.score_quality(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
        F.col(f"{x}.score").alias("score"),
        F.col(f"{x}.predicted").alias("predicted"),
    )


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged, x = quality_rules.quality_rules(docs, table(spark, sf, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"{x}.{n}").alias(n) for n in names])


def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    hard = F.lit("</s>[INST] ok [/INST]")
    rows = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(rows)).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", hard.alias("text")
    )
    chats = chat.format_chats(turns.unionByName(extra))
    told = chats.select("conv_id", "valid", chat.formatted(F.col("segments")).alias("f"), chat.loss_text(F.col("segments")).alias("loss"))
    read = told.withColumn("turns", chat.read_turns(F.col("f")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("f").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found, x = secrets.find_secrets(docs, overlapping=True)
    spans = F.col(x)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(spans, secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary of the queries."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tokenizer = bpe.Tokenizer(spark, *vocabulary())
    encoded, ids = tokenizer.encode(docs)
    decoded, back = tokenizer.decode(encoded.select("doc_id", ids), ids)
    return decoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(back), 256).alias("decoded_sha256"),
    )


def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf, "documents"))


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found, x = pii.find_pii(docs, pii.fit(docs))
    spans = F.col(x)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        F.sha2(pii.listed(spans, pii.KINDS[:4]), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
        count(4).alias("n_context"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_decontaminate,
        op3_license_scans,
        op4_url_filters,
        op5_language_id,
        op6_quality_classifier,
        op7_quality_rules,
        op8_chat_formatting,
        op9_secret_scans,
        op10_byte_bpe,
        op11_phrase_collocations,
        op12_lexical_search,
        op13_pii,
    )
}
ORACLE_SQL = ORACLES
