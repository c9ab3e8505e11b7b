"""Character 3-5-gram TF-IDF as tables.

The vocabulary is ``(gram, df)``; the empty gram carries the number of
documents, so one pass fits both.  Cosines are a join of the grams a pair
shares with the unit weights of its two values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.gramcount import count_grams
from ..functions.text import grams, normalize, strip_space
from ..plans.profiles import Profile
from ..plans.workspace import task_count

GRAM_SIZES = (3, 4, 5)  # fixed values
#: Most vocabulary rows ever broadcast: a gram holds at most five characters, so
#: the broadcast stays within tens of megabytes whatever the data.
BROADCAST_GRAMS = 400_000
#: Terms (grams of values, repeats included) per task that weighs them: what a task holds follows from it.
TASK_TERMS = 1_000_000


def gram_list(norm: Column) -> Column:
    return F.concat(*[grams(norm, n) for n in GRAM_SIZES])


def _raw_cells(df: DataFrame, *arrays: str) -> DataFrame:
    cells = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return df.select(F.explode(cells).alias("c")).select(F.col("c.raw").alias("raw"))


def corpus(profile: Profile, source: DataFrame, dash: DataFrame, aligned: DataFrame) -> DataFrame:
    """Distinct documents and how often each counts, under the profile's policy."""
    if profile.corpus == "all_cells":
        cells = _raw_cells(source, "cells").unionByName(_raw_cells(dash, "cells"))
        return _counted(cells)
    cells = _raw_cells(aligned, "d_cells", "s_cells")
    if profile.corpus == "common_cells":
        return _counted(cells)
    if profile.corpus == "common_distinct_with_id":
        cells = cells.unionByName(aligned.select(F.col("id").alias("raw")))
    elif profile.corpus != "common_distinct":
        raise ValueError(f"profile {profile.name} fits no corpus")
    # A blank stands in for null and is one document; the text "nan" is not one.
    text = F.coalesce("raw", F.lit(""))
    kept = cells.where(F.lower(strip_space(text)) != "nan")
    return kept.select(normalize(text).alias("doc")).distinct().withColumn("times", F.lit(1).cast("long"))


def _counted(cells: DataFrame) -> DataFrame:
    filled = cells.where(F.col("raw").isNotNull() & (F.col("raw") != ""))
    # Equal cells collapse before their text is normalised and cut into grams.
    return filled.groupBy(normalize(F.col("raw")).alias("doc")).agg(F.count(F.lit(1)).alias("times"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """``(gram, df)`` of distinct documents ``(doc, times)``.

    Cutting grams is CPU that AQE would not see in the bytes of the documents, hence the explicit
    partition number.  A task adds up the documents of a slice before Spark sees a row per gram.
    """
    spread = docs.select("doc", F.col("times").cast("long")).repartition(task_count(docs), "doc")
    counted = spread.select("doc", "times").mapInArrow(count_grams(GRAM_SIZES), "gram string, df long")
    total = spread.select(F.lit("").alias("gram"), F.col("times").alias("df"))
    return counted.unionByName(total).groupBy("gram").agg(F.sum("df").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def inverse_frequency(vocabulary: DataFrame) -> DataFrame:
    """``(gram, df, idf)`` of a vocabulary table."""
    n = vocabulary.where(F.col("gram") == "").select(F.max("df")).scalar()
    return vocabulary.where(F.col("gram") != "").select(
        "gram", "df", idf(F.col("df"), F.coalesce(n, F.lit(0))).alias("idf")
    )


def _with_idf(
    terms: DataFrame, vocabulary: DataFrame, broadcast_grams: int
) -> DataFrame:
    """Join terms with their idf; grams outside the vocabulary drop out.

    A vocabulary of at most ``broadcast_grams`` rows (counted, not guessed) is
    broadcast.  Beyond that only its head is: grams whose document frequency
    exceeds the total over ``broadcast_grams``, of which there can be no more
    than that.  They are the grams half the terms carry; the rare rest, with no
    hot key left, is joined by shuffle.
    """
    table = inverse_frequency(vocabulary).select("gram", "df", "idf")
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.sum("df").alias("total")).first()
    if size["rows"] <= broadcast_grams:
        return terms.join(F.broadcast(table.drop("df")), "gram")
    cut = F.col("df") > F.lit(size["total"] / broadcast_grams)
    head = F.broadcast(table.where(cut).drop("df"))
    tail = table.where(~cut).drop("df")
    common = terms.join(head, "gram")
    rare = terms.join(head, "gram", "left_anti").join(tail.hint("merge"), "gram")
    return common.unionByName(rare)


def unit_weights(
    values: DataFrame, vocabulary: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, terms: int = 0
) -> DataFrame:
    """``(vk, gram, w)`` of distinct values ``(vk, el)``, L2-normalised per value.

    ``terms`` is how many grams the values have at most: their file is far smaller than that.
    Values of one ``vk`` may differ in further columns, which name them too and are kept.
    """
    spread = values.repartition(max(task_count(values), terms // TASK_TERMS + 1), "vk")
    keys = [c for c in values.columns if c != "el"]
    # Grouping and norm are by (parts of) the partitioning key: no further shuffle.
    terms = (
        spread.select(*keys, F.explode(gram_list(F.col("el"))).alias("gram"))
        .groupBy(*keys, "gram")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    weighted = _with_idf(terms, vocabulary, broadcast_grams).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "gram", (F.col("w") / norm).alias("w"))


def value_key(c: Column) -> Column:
    return F.unhex(F.md5(c))


def cosine(
    pairs: DataFrame, vocabulary: DataFrame, broadcast_grams: int = BROADCAST_GRAMS
) -> DataFrame:
    """``(ek, tfidf)`` of pairs ``(ek, a, b)``; pairs sharing no gram have no row (cosine 0).

    With a vocabulary that is broadcast, both values of a pair are weighed in the pair's task: the
    pairs' texts are shuffled once and no term is.  Beyond that each distinct value is weighed
    once, and the grams a pair shares are joined with the weights.
    """
    chars = pairs.agg(F.sum((F.length("a") + F.length("b")).cast("long"))).first()[0]
    most = len(GRAM_SIZES) * (chars or 0)
    if vocabulary.count() <= broadcast_grams:
        both = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("el")) for i, c in enumerate("ab")])
        values = pairs.select(F.col("ek").alias("vk"), F.inline(both))
        weights = unit_weights(values, vocabulary, broadcast_grams, most)
        # By gram first; pairs stay in their tasks.
        product = [F.sum(F.when(F.col("side") == i, F.col("w"))).alias(w) for i, w in enumerate(("wa", "wb"))]
        shared = weights.groupBy("vk", "gram").agg(*product).where("wa is not null and wb is not null")
        return shared.groupBy(F.col("vk").alias("ek")).agg(F.sum(F.col("wa") * F.col("wb")).alias("tfidf"))
    values = (
        pairs.select(F.col("a").alias("el"))
        .unionByName(pairs.select(F.col("b").alias("el")))
        .distinct()
        .select(value_key(F.col("el")).alias("vk"), "el")
    )
    weights = unit_weights(values, vocabulary, broadcast_grams, most)
    shared = F.array_intersect(gram_list(F.col("a")), gram_list(F.col("b")))
    terms = pairs.select(
        "ek", value_key(F.col("a")).alias("va"), value_key(F.col("b")).alias("vb"), F.explode(shared).alias("gram")
    )
    wa = weights.select(F.col("vk").alias("va"), "gram", F.col("w").alias("wa"))
    wb = weights.select(F.col("vk").alias("vb"), "gram", F.col("w").alias("wb"))
    # Both sides are exploded terms whose size the planner underrates: never broadcast them.
    return (
        terms.join(wa.hint("merge"), ["va", "gram"])
        .join(wb.hint("merge"), ["vb", "gram"])
        .groupBy("ek")
        .agg(F.sum(F.col("wa") * F.col("wb")).alias("tfidf"))
    )
