import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colweave.functions import gramcount
from colweave.operators import scoring as S, tfidf
from colweave.plans.workspace import Workspace

DOCS = [("banana", 3), ("bandana", 1), ("an", 2), ("", 1), ("canal ban", 1)]
PAIRS = [("banana", "bandana"), ("banana", "banana"), ("an", "an"), ("xyzxyz", "banana"), ("canal", "ban canal")]


def gram_counts(text):
    return Counter(text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1))


def brute_force(a, b):
    n = sum(times for _, times in DOCS)
    df = Counter()
    for doc, times in DOCS:
        for g in gram_counts(doc):
            df[g] += times
    idf = {g: math.log((1 + n) / (1 + c)) + 1 for g, c in df.items()}
    va, vb = ({g: c * idf[g] for g, c in gram_counts(t).items() if g in idf} for t in (a, b))
    norm = math.sqrt(sum(x * x for x in va.values())) * math.sqrt(sum(x * x for x in vb.values()))
    return sum(x * vb.get(g, 0.0) for g, x in va.items()) / norm if norm else 0.0


@pytest.mark.parametrize("broadcast_grams", [10_000, 8, 1])
def test_cosine(spark, broadcast_grams):
    """The same cosines with the vocabulary broadcast whole, by its head, and hardly at all."""
    docs = spark.createDataFrame(DOCS, "doc string, times long")
    vocabulary = Workspace(spark).table(tfidf.document_frequency(docs), "vocabulary")
    assert vocabulary.where("gram = ''").first()["df"] == 8
    pairs = spark.createDataFrame(PAIRS, "a string, b string").withColumn("ek", S.pair_key(F.col("a"), F.col("b")))
    cosines = tfidf.cosine(pairs, vocabulary, broadcast_grams)
    got = {(r["a"], r["b"]): r["tfidf"] or 0.0 for r in pairs.join(cosines, "ek", "left").collect()}
    assert got == pytest.approx({p: brute_force(*p) for p in PAIRS})
    assert got["an", "an"] == 0.0


def test_pair_key_keeps_splits_apart(evaluate):
    keys = evaluate(S.pair_key, ("a", "bc"), ("ab", "c"), ("a", "bc"), ("1:a", "b"))
    assert keys[0] == keys[2] and len(set(map(bytes, keys))) == 3


def test_weights_get_tasks_by_their_terms(spark, monkeypatch):
    """However small the values are as a file: no task weighs much more than its share of the grams."""
    monkeypatch.setattr(tfidf, "TASK_TERMS", 10)
    docs = spark.createDataFrame(DOCS, "doc string, times long")
    vocabulary = Workspace(spark).table(tfidf.document_frequency(docs), "vocabulary")
    values = spark.range(100).select(F.col("id").alias("vk"), F.concat(F.lit("banana"), F.col("id")).alias("el"))
    assert tfidf.unit_weights(values, vocabulary, terms=990).rdd.getNumPartitions() == 100
    seen = []
    whole = tfidf.unit_weights
    monkeypatch.setattr(tfidf, "unit_weights", lambda *args: seen.append(args[-1]) or whole(*args))
    pairs = spark.createDataFrame(PAIRS, "a string, b string").withColumn("ek", S.pair_key(F.col("a"), F.col("b")))
    tfidf.cosine(pairs, vocabulary)
    assert seen == [3 * sum(len(a) + len(b) for a, b in PAIRS)]


def test_grams_are_counted_slice_by_slice(monkeypatch):
    """Whatever the slices: characters outside the BMP, NULs, equal documents, documents longer than a slice."""
    texts = ["banana", "", "an", "\U0001f600x\U0001f600x\U0001f600x", "a\0\0\0\0b\0\0\0", "banana", "äöüß" * 9]
    times = [3, 1, 2, 5, 1, 4, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(times, pa.int64())], ["doc", "times"])
    want = Counter()
    for text, n in zip(texts, times):
        for g in gram_counts(text):
            want[g] += n
    for chars, bits in [(1 << 20, 62), (10, 62), (1 << 20, 12), (1, 62)]:
        monkeypatch.setattr(gramcount, "SLICE_CHARS", chars)
        monkeypatch.setattr(gramcount, "KEY_BITS", bits)
        got = Counter()
        for out in gramcount.count_grams((3, 4, 5))(iter([batch])):
            for gram, df in zip(*(c.to_pylist() for c in out.columns)):
                got[gram] += df
        assert got == want


def test_grams_are_counted_in_tasks_by_the_input(spark, monkeypatch):
    """Small documents are few bytes and many grams: their tasks are not left to AQE."""
    monkeypatch.setattr(tfidf, "task_count", lambda *frames: 13)
    docs = spark.createDataFrame([(f"doc {i}", 1) for i in range(300)], "doc string, times long").groupBy("doc").agg(F.sum("times").alias("times"))
    seen = []
    counted = gramcount.count_grams
    monkeypatch.setattr(tfidf, "count_grams", lambda sizes: seen.append(sizes) or counted(sizes))
    table = tfidf.document_frequency(docs)
    assert seen == [(3, 4, 5)]
    assert "REPARTITION_BY_NUM" in table._jdf.queryExecution().executedPlan().toString()
    assert table.where("gram = ''").first()["df"] == 300 and table.where("gram = 'doc'").first()["df"] == 300


def test_cosine_moves_no_terms_with_a_broadcast_vocabulary(spark):
    """One shuffle of the pairs' texts: no join of terms with weights, no text sorted by another key."""
    docs = spark.createDataFrame(DOCS, "doc string, times long")
    vocabulary = Workspace(spark).table(tfidf.document_frequency(docs), "vocabulary")
    pairs = spark.createDataFrame(PAIRS, "a string, b string").withColumn("ek", S.pair_key(F.col("a"), F.col("b")))
    plan = tfidf.cosine(pairs, vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1
