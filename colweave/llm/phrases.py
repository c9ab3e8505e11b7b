"""Phrase collocations: the best scored phrases of two to four words of each language.

A candidate occurs at least ``LEAST`` times.  Its score is the least, over its cuts
into a first and a second part, of ``SCALE`` * 2a / (l + r), rounded down.  A candidate
is dropped if a longer candidate holds it and occurs at least ``COVER`` per cent as
often; as counts fall with length, only extensions by one word have to be looked at.

Growth is best first.  Words and word pairs are counted for the whole corpus; every
pair is a prefix (and a suffix) of longer phrases.  A phrase that begins with p scores
at most 2 f(p) / (f(first word of p) + f(p)), one that ends with s at most
2 f(s) / (f(last word of s) + f(s)), whatever follows or precedes.  A round opens, per
language, the prefixes and suffixes whose bound reaches a threshold, the score of the
language's ``k``-th best pair, and counts what grows from them: triples from open pairs,
quadruples from open triples.  All phrases at or above the threshold are then known with
their parts and extensions, so a language is settled, ties included, if ``top`` of them
survive.  For the others the next round takes a larger ``k``; a threshold of 0 ends it.

Scale: a word is named by 64 bits of its hash together with its language (two words of
one name are noticed, and other names taken).  The texts are read once and written as chunks of
word numbers; phrases are tuples of names, counted in the tasks that read the chunks and
summed by Spark.  Tasks learn what is open from bitmaps
of a fixed greatest size, whose false positives only add rows that later joins leave out.
Nothing else reaches the driver, and no key gathers more than one row per task.

Edge cases: null texts have no words, null languages are ``und``; repeated rows count each
time; an empty table gives no phrase; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.workspace import Workspace
from .common import frugal

TOP, LEAST, COVER, SCALE = 2000, 30, 80, 1_000_000
#: Prefixes of the next round against those of this one.
WIDER = 8
#: Bits of an open-set bitmap: 16 for each member, at least 2^16 and at most these.
MAX_BITS = 27
#: Words of a chunk, and words that a task holds before it hands its counts on.
HELD_WORDS, HELD_GRAMS = 200_000, 500_000
#: Rows of a batch of counts that goes to Spark.
BATCH_ROWS = 1 << 16
_SALTS = 64

# Fixed values: ``.`` stands for every character that ends a piece; A-Z become a-z.
_TO = bytes(
    46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def tokens(text: str) -> list[bytes]:
    """Words, and ``.`` for the end of each piece."""
    return text.encode().translate(_TO).replace(b".", b" . ").split()


def _name(lang: str, word: bytes, seed: int) -> int:
    """A positive name of 63 bits."""
    return (xxhash.xxh3_64_intdigest(lang.encode() + b"\x00" + word, seed) >> 1) or 1


# ---------------------------------------------------------------- bitmaps

def _mix(*names: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each tuple of names."""
    out = np.zeros(len(names[0]), np.uint64)
    for x in names:
        out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Bitmap:
    """A set of tuples of names as bits at their hashes; a broadcast of at most 2^MAX_BITS bits."""

    def __init__(self, spark: SparkSession, members: DataFrame, size: int):
        self.bits = bits = int(np.clip(int(16 * size).bit_length(), 16, MAX_BITS))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(_mix(*[c.to_numpy(zero_copy_only=False) for c in batch.columns]) >> np.uint64(64 - bits))
                part = np.left_shift(np.int64(1), (at & np.uint64(63)).astype(np.int64))
                slot, first = np.unique((at >> np.uint64(6)).astype(np.int32), return_index=True)
                if len(slot):
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bitwise_or.reduceat(part, first))], ["slot", "bits"])

        found = members.mapInArrow(frugal(places), "slot int, bits bigint").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits"))
        told = found.toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[told["slot"].to_numpy()] = told["bits"].to_numpy()
        self.words: Broadcast = spark.sparkContext.broadcast(words)

    def holds(self, *names: np.ndarray) -> np.ndarray:
        at = _mix(*names) >> np.uint64(64 - self.bits)
        return (self.words.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1


# ---------------------------------------------------------------- counting in the tasks


class _Numbers(dict):
    """Word of a language to its number in a chunk; 0 ends a piece.

    It knows the chunk's lists, not the chunk: a cycle would keep finished chunks in memory.
    """

    def __init__(self, lang: str, seed: int, names: list, words: list, langs: list):
        super().__init__({b".": 0})
        self.lang, self.seed, self.names, self.words, self.langs = lang, seed, names, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(_name(self.lang, word, self.seed))
        self.words.append(word)
        self.langs.append(self.lang)
        return at


class _Chunk:
    """Numbered words of some documents."""

    def __init__(self, seed: int):
        self.seed = seed
        self.numbers: dict[str, _Numbers] = {}
        self.names, self.words, self.langs, self.run = [0], [None], [""], [0]

    def add(self, lang: str, text: str) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(lang, self.seed, self.names, self.words, self.langs)
        self.run.extend(map(numbers.__getitem__, tokens(text)))
        self.run.append(0)

    @property
    def full(self) -> bool:
        return len(self.run) > HELD_WORDS

    def row(self) -> pa.RecordBatch:
        run = np.array(self.run, np.int32)
        counts = np.bincount(run, minlength=len(self.names))
        counts[0] = 0
        totals = Counter()
        for lang, n in zip(self.langs, counts.tolist()):
            totals[lang] += n
        totals.pop("", None) if not totals[""] else None
        langs = [*self.langs[1:], *totals]
        words = [*self.words[1:], *[None] * len(totals)]
        names = np.r_[np.array(self.names[1:], np.int64), np.zeros(len(totals), np.int64)]
        n = np.r_[counts[1:], np.array(list(totals.values()), np.int64)]
        fields = [pa.array(langs, pa.string()), pa.array(names), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)]
        counted = pa.ListArray.from_arrays([0, len(langs)], pa.StructArray.from_arrays(fields, ["lang", "name", "word", "n"]))
        own = np.array(self.names, np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([run.tobytes()]), counted], ["names", "run", "words"])


def encode(docs: DataFrame, seed: int) -> DataFrame:
    """Chunks of numbered words: the names of the numbers, the numbers in order (0 between pieces), and counts.

    ``words`` has lang, name, word and n; a null word with name 0 counts all words of a language.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(seed)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    chunk.add(lang, text.as_py())
                    if chunk.full:
                        yield chunk.row()
                        chunk = _Chunk(seed)
        yield chunk.row()

    words = "array<struct<lang: string, name: bigint, word: string, n: bigint>>"
    return docs.mapInArrow(frugal(read), f"names binary, run binary, words {words}")


def _merged(chunks: list[tuple[np.ndarray, np.ndarray]], frequent: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """One run of the chunks over common numbers of frequent words, 0 for all others, and the names of the numbers."""
    names, inverse = np.unique(np.concatenate([n for n, _ in chunks]), return_inverse=True)
    good = frequent.holds(names) & (names > 0)
    number = np.where(good, np.cumsum(good), 0).astype(np.int32)[inverse]
    ends = np.cumsum([0, *(len(n) for n, _ in chunks)])
    gap = np.zeros(1, np.int32)
    run = np.concatenate([x for at, (_, own) in zip(ends, chunks) for x in (number[own + at], gap)])
    return run, np.r_[np.zeros(1, np.int64), names[good]]


def _counted(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers below ``size``, and how often each occurs."""
    width = max(1, int(size - 1).bit_length())
    fit = 63 // width
    keys = []
    for at in range(0, len(columns), fit):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[at : at + fit]:
            key = (key << width) | c
        keys.append(key)
    if len(keys) == 1:
        key, counts = np.unique(keys[0], return_counts=True)
        keys = [key]
    else:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        changed = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(np.r_[True, changed]) if len(order) else order
        counts = np.diff(np.r_[first, len(order)])
        keys = [k[first] for k in keys]
    out = []
    for at, key in zip(range(0, len(columns), fit), keys):
        held = len(columns[at : at + fit])
        out += [(key >> (width * (held - 1 - j))) & ((1 << width) - 1) for j in range(held)]
    return out, counts.astype(np.int64)


def _grams(k: int, run: np.ndarray, names: np.ndarray, opened: list[Bitmap]) -> list[np.ndarray]:
    """Columns of names and the count of each k-gram of a run that may matter."""
    n = max(0, len(run) - k + 1)
    whole = run[:n] > 0
    for j in range(1, k):
        whole &= run[j : j + n] > 0
    at = np.flatnonzero(whole)
    of = lambda i: names[run[at + i]]
    if k == 3:
        prefix, suffix = opened
        at = at[prefix.holds(of(0), of(1)) | suffix.holds(of(1), of(2))]
    elif k == 4:
        prefix, suffix, best = opened
        first, last = (of(0), of(1), of(2)), (of(1), of(2), of(3))
        both = prefix.holds(*first) & suffix.holds(*last)
        at = at[both | best.holds(*first) | best.holds(*last)]
    parts, counts = _counted([run[at + j].astype(np.int64) for j in range(k)], len(names))
    return [*(names[p] for p in parts), counts]


def count_grams(chunks: DataFrame, k: int, frequent: Bitmap, opened: list[Bitmap]) -> DataFrame:
    """Names ``w1`` to ``wk`` and ``a`` of k-grams of frequent words, as far as ``opened`` asks for them."""
    columns = [f"w{j}" for j in range(1, k + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            run, names = _merged(held, frequent)
            held.clear()
            found = _grams(k, run, names, opened)
            for at in range(0, len(found[0]), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH_ROWS]) for x in found], [*columns, "a"])

        for batch in batches:
            for names, run in zip(batch.column(0), batch.column(1)):
                held.append((np.frombuffer(names.as_buffer(), np.int64), np.frombuffer(run.as_buffer(), np.int32)))
                if sum(len(r) for _, r in held) > HELD_GRAMS:
                    yield from rows()
        if held:
            yield from rows()

    counted = chunks.select("names", "run").mapInArrow(frugal(count), ", ".join(f"{c} bigint" for c in [*columns, "a"]))
    return counted.groupBy(*columns).agg(F.sum("a").alias("a"))


# ---------------------------------------------------------------- scores


def _share(a: Column, parts: Column) -> Column:
    """``SCALE`` * 2a / parts, rounded down, in exact arithmetic."""
    wide = a.cast("decimal(20,0)") * F.lit(2 * SCALE).cast("decimal(9,0)")
    return F.call_function("div", wide, parts)


def _sum(l: Column, r: Column) -> Column:
    return l.cast("decimal(20,0)") + r.cast("decimal(20,0)")


class _Counts:
    """Tables of counted phrases, and lookups of parts in them."""

    def __init__(self, words: DataFrame):
        self.tables = {1: words.select(F.col("name").alias("w1"), F.col("f").alias("a"))}

    def with_part(self, df: DataFrame, at: int, k: int, name: str) -> DataFrame:
        """The frame with the count of its words ``at`` to ``at + k - 1`` as a further column."""
        part = self.tables[k].select(*[F.col(f"w{j}").alias(f"w{at + j - 1}") for j in range(1, k + 1)], F.col("a").alias(name))
        return df.join(part, [f"w{at + j}" for j in range(k)])

    def scored(self, df: DataFrame, k: int) -> DataFrame:
        """Phrases of k words with l, r, score and the bounds of what begins or ends with them."""
        for cut in range(1, k):
            df = self.with_part(self.with_part(df, 1, cut, f"l{cut}"), cut + 1, k - cut, f"r{cut}")
        tried = [
            F.struct(_share(F.col("a"), _sum(F.col(f"l{c}"), F.col(f"r{c}"))).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))
            for c in range(1, k)
        ]
        df = df.withColumn("best", F.array_min(F.array(*tried)))
        return df.select(
            *[f"w{j}" for j in range(1, k + 1)],
            "a",
            F.col("best.l").alias("l"),
            F.col("best.r").alias("r"),
            F.col("best.score").alias("score"),
            _share(F.col("a"), _sum(F.col("l1"), F.col("a"))).alias("as_prefix"),
            _share(F.col("a"), _sum(F.col(f"r{k - 1}"), F.col("a"))).alias("as_suffix"),
        )


def _parts(k: int, at: int, of: int) -> list[Column]:
    return [F.col(f"w{at + j}").alias(f"w{j + 1}") for j in range(of)]


def _covered(phrases: DataFrame, longer: DataFrame, k: int, cover: int) -> DataFrame:
    """Phrases of k words with ``dropped``: an extension by one word occurs nearly as often."""
    names = [f"w{j}" for j in range(1, k + 1)]
    ends = longer.select(*_parts(k + 1, 1, k), "a").unionByName(longer.select(*_parts(k + 1, 2, k), "a"))
    most = ends.groupBy(*names).agg(F.max("a").alias("most"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    dropped = F.coalesce(wide("most", 100) >= wide("a", cover), F.lit(False))
    return phrases.join(most, names, "left").withColumn("dropped", dropped).drop("most")


def _best(phrases: DataFrame, top: int, *ties: Column) -> DataFrame:
    """Per language the first ``top`` rows with their ``rank``; languages are thinned in parts first."""
    order = [F.col("score").desc(), F.col("a").desc(), *ties]
    salt = F.pmod(F.xxhash64(*[c for c in phrases.columns if c.startswith("w")]), F.lit(_SALTS))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    thin = phrases.withColumn("salt", salt).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = thin.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    top: int = TOP,
    least: int = LEAST,
    cover: int = COVER,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's best phrases."""
    spark = docs.sparkSession
    work = Workspace(spark)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    seed = 0
    while True:  # until no two words share a name; nearly always once
        chunks = work.table(encode(docs, seed), f"chunks{seed}")
        counted = chunks.select(F.inline("words")).groupBy("lang", "name").agg(
            F.sum("n").alias("f"), F.min("word").alias("word"), F.max("word").alias("other")
        )
        words = work.table(counted.where((F.col("f") >= least) | (F.col("name") == 0)), f"words{seed}")
        if words.where("word <> other").isEmpty():
            break
        seed += 1
    totals = words.where("name = 0").select("lang", F.col("f").alias("n"))
    words = words.where("name > 0").select("lang", "name", "word", "f")
    counts = _Counts(words)
    frequent = Bitmap(spark, words.select("name"), words.count())
    enough = F.col("a") >= least

    counted = work.table(count_grams(chunks, 2, frequent, []).where(enough), "counted2")
    counts.tables[2] = counted
    pairs = counts.scored(counted, 2).join(words.select(F.col("name").alias("w1"), "lang"), "w1")
    pairs = work.table(pairs, "pairs")

    settled: list[DataFrame] = []
    k, left = top, None
    while True:
        step = len(settled)
        last = _best(pairs if left is None else pairs.join(left, "lang", "left_semi"), k)
        limit = last.groupBy("lang").agg(F.when(F.max("rank") == k, F.min("score")).otherwise(F.lit(0)).alias("limit"))
        limit = work.table(limit, f"limit{step}")

        def opened(phrases: DataFrame, k: int, bound: str) -> Bitmap:
            names = [f"w{j}" for j in range(1, k + 1)]
            rows = phrases.where(F.col(bound) >= F.col("limit")).select(*names)
            return Bitmap(spark, rows, rows.count())

        level2 = pairs.join(limit, "lang")
        triples = count_grams(chunks, 3, frequent, [opened(level2, 2, "as_prefix"), opened(level2, 2, "as_suffix")])
        counts.tables[3] = work.table(triples.where(enough), f"counted3_{step}")
        level3 = counts.scored(counts.tables[3], 3)
        level3 = level3.join(words.select(F.col("name").alias("w1"), "lang"), "w1").join(limit, "lang")
        level3 = work.table(level3, f"triples{step}")
        found = count_grams(
            chunks, 4, frequent, [opened(level3, 3, "as_prefix"), opened(level3, 3, "as_suffix"), opened(level3, 3, "score")]
        )
        counted4 = work.table(found.where(enough), f"counted4_{step}")
        level4 = counts.scored(counted4, 4)
        level4 = level4.join(words.select(F.col("name").alias("w1"), "lang"), "w1").join(limit, "lang")

        good = F.col("score") >= F.col("limit")
        pad = lambda df: df.withColumns({f"w{j}": F.lit(None).cast("bigint") for j in (3, 4) if f"w{j}" not in df.columns})
        kept = [
            _covered(level2.where(good), counts.tables[3], 2, cover),
            _covered(level3.where(good), counted4, 3, cover),
            level4.where(good).withColumn("dropped", F.lit(False)),
        ]
        columns = ["lang", "w1", "w2", "w3", "w4", "a", "l", "r", "score"]
        alive = [pad(x).where("not dropped").select(*columns) for x in kept]
        alive = work.table(alive[0].unionByName(alive[1]).unionByName(alive[2]), f"alive{step}")
        number = alive.groupBy("lang").agg(F.count("*").alias("alive"))
        state = limit.join(number, "lang", "left").select(
            "lang", ((F.col("limit") == 0) | (F.coalesce("alive", F.lit(0)) >= top)).alias("done")
        )
        state = work.table(state, f"state{step}")
        settled.append(alive.join(state.where("done").select("lang"), "lang", "left_semi"))
        left = state.where("not done").select("lang")
        if left.isEmpty():
            break
        k *= WIDER

    phrases = settled[0]
    for more in settled[1:]:
        phrases = phrases.unionByName(more)
    for j in range(1, 5):
        word = words.select(F.col("name").alias(f"w{j}"), F.col("word").alias(f"t{j}"))
        phrases = phrases.join(word, f"w{j}", "left")
    text = F.concat_ws(" ", *[F.col(f"t{j}") for j in range(1, 5)])
    phrases = phrases.withColumn("phrase", text)
    ranked = _best(phrases, top, F.col("phrase")).join(totals, "lang")
    ranked = ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return work.last(ranked, "phrases")
