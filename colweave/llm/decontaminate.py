"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is the word.  Every window of ``window`` consecutive benchmark
words is a pattern; an item with fewer words is one shorter pattern.  Patterns
of one length m share a shift table over blocks of two words: how far the end of
the search window may move without missing an occurrence.  A block that no
pattern holds lets the search jump m - 1 words, a block that ends a pattern has
shift 0 and selects a bucket of patterns by their last block, narrowed by their
first word; comparison of the words themselves confirms.

Documents stay where they are: no shuffle, one pass.  The benchmark goes to the
executors in broadcasts of about ``BLOCK_BYTES`` of text each (items are dealt by
hash, one item is never split, equal rows are one).  A worker holds the tables of
one broadcast at a time, however large the benchmark is: it gathers documents of
``HELD_BYTES`` and searches them for one block after the other.

Edge cases: null, empty and word-free texts have no words and no hits; an item
without words has no window; an item without an id marks words but is not
listed; repeated items and repeated documents are each handled as they come.
"""

from __future__ import annotations

import functools
import math
import pickle
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.workspace import Workspace
from .common import alnum_words, free_name

WINDOW = 10
#: Benchmark text per broadcast; its windows take some hundred times as many bytes in a worker.
BLOCK_BYTES = 2 << 20
#: Document text that a worker gathers before it goes through several blocks.
HELD_BYTES = 32 << 20

HITS = "struct<n_words: bigint, spans: array<struct<start: bigint, stop: bigint>>, items: array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


class Patterns:
    """Shift table and buckets for patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, dict[tuple, set]]] = {}

    def add(self, words: tuple, item: str | None) -> None:
        b, m = self.block, self.length
        for end in range(b, m + 1):
            block = words[end - b : end]
            self.shift[block] = min(self.shift.get(block, self.jump), m - end)
        items = self.buckets.setdefault(words[m - b :], {}).setdefault(words[0], {}).setdefault(words, set())
        if item is not None:
            items.add(item)

    def search(self, words: tuple) -> Iterator[tuple[int, set]]:
        """Start and items of every occurrence."""
        b, m, shift, jump = self.block, self.length, self.shift, self.jump
        end, n = m, len(words)
        while end <= n:
            block = words[end - b : end]
            skip = shift.get(block, jump)
            if skip:
                end += skip
                continue
            start = end - m
            items = self.buckets[block].get(words[start], {}).get(words[start:end])
            if items is not None:
                yield start, items
            end += 1


def compile_patterns(benchmark: Iterable[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for item, text in benchmark:
        words = tuple(alnum_words(text))
        m = min(window, len(words))
        for start in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, Patterns(m)).add(words[start : start + m], item)
    return list(by_length.values())


@functools.lru_cache(maxsize=1)
def _compiled(token: str, packed, window: int) -> list[Patterns]:
    return compile_patterns(pickle.loads(packed.value), window)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, as sorted spans that do not touch."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def gathered(batches: Iterable[pa.Array], most: int) -> Iterator[list[pa.Array]]:
    """Batches in runs of ``most`` bytes and more; the last run may be shorter."""
    run, size = [], 0
    for batch in batches:
        run.append(batch)
        size += batch.nbytes
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def find_hits(text: str | None, compiled: list[Patterns], before: dict | None = None) -> dict:
    """Words, hit spans (in words) and items of one text, added to what earlier blocks found."""
    words = tuple(alnum_words(text))
    spans = [(s["start"], s["stop"]) for s in before["spans"]] if before else []
    items = set(before["items"]) if before else set()
    for patterns in compiled:
        last = -1
        for start, found in patterns.search(words):
            if start <= last:  # spans of one length come in order: join those that touch
                spans[-1] = (spans[-1][0], start + patterns.length)
            else:
                spans.append((start, start + patterns.length))
            last = start + patterns.length
            items |= found
    merged = [{"start": a, "stop": b} for a, b in merge_spans(spans)]
    return {"n_words": len(words), "spans": merged, "items": sorted(items)}


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    held_bytes: int = HELD_BYTES,
    result: str = "hits",
) -> tuple[DataFrame, str]:
    """The documents with one more column of type ``HITS``, and that column's name.

    ``n_words`` counts the text's words, ``spans`` are the hit words as disjoint
    sorted ranges of word positions, ``items`` the sorted ids (as text) of the
    items with a window in the text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    bytes_of = lambda df: df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, work = 1, None
    if bytes_of(items) > block_bytes:
        work = Workspace(spark)
        items = work.table(items.distinct(), "items")
        blocks = max(1, math.ceil(bytes_of(items) / block_bytes))

    def block(k: int):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(pickle.dumps([tuple(r) for r in rows]))

    shared = [(uuid.uuid4().hex, block(k)) for k in range(blocks)]
    if work is not None:
        work.drop()

    @F.arrow_udf(HITS)
    def search(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn = list(shared)
        for run in gathered(it, held_bytes) if len(turn) > 1 else ([batch] for batch in it):
            found: list[list] = [[None] * len(batch) for batch in run]
            for token, packed in turn:
                compiled = _compiled(token, packed, window)
                for hits, batch in zip(found, run):
                    hits[:] = [find_hits(t.as_py(), compiled, h) for t, h in zip(batch, hits)]
            turn.reverse()  # the next run begins with the tables at hand
            yield from (pa.array(hits, _HITS) for hits in found)

    name = free_name(docs, result)
    return docs.withColumn(name, search(F.col(text_col))), name
