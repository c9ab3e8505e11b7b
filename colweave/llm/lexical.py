"""Ranked lexical search over geometrically blocked posting lists.

Documents become integer vectors: the impact of a term is its weight times a saturated
term frequency, and a document's score for a query is the sum of the impacts of the
query's terms.  The vectors, restricted to the terms of the query set, are written once;
document frequencies, N and L are sums over all rows.

A task holds its vectors in segments of ``SEGMENT`` rows.  The posting list of a term in a
segment is cut into blocks of similar documents: evenly spaced members serve as centres and
each posting joins the centre of the greatest inner product of their projected, normalised
vectors.  A block's summary is the coordinatewise maximum of its members' impacts, for the
terms that occur in a query together with the list's term.  The sum of a summary over a
query's terms is no less than any member's score, so a block is skipped only if that sum is
below the tenth best score known.  Lists are taken by falling greatest impact; when the rest
of the lists together cannot reach the tenth best score, they end the query: what they hold
beyond the documents scored already lacks all earlier terms.  Only blocks of lists that a
query reaches are built; skipping loses nothing, so results are exact.

The first known scores come from a search of one in ``SEED_SHARE`` rows: a tenth best score
among some rows is never above that among all.

Scale: one pass over the texts, one over the much smaller vectors; a task returns ``k`` rows
for each query, and the ranking of those thins them before the exchange.  Queries are held
in every task, so they are dealt into sets of at most ``QUERY_BYTES``; each set is one run.

Edge cases: null and empty texts have no terms and are in no result, nor counted in N; rows
of one item form one query of all their terms, a null item is an item; items without terms
or matches have no rows; repeated documents rank each; null ids come last among equals.
Ids are integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.workspace import Workspace
from .common import alnum_words

K = 10
SEGMENT = 4096
BLOCK = 48
#: Dimensions of the projection that clusters see.
DIMENSIONS = 32
SEED_SHARE = 16
QUERY_BYTES = 2 << 20
#: Bytes of summaries that a segment keeps; what goes beyond is built again when asked for.
SUMMARY_BYTES = 96 << 20

_LAST = np.iinfo(np.int64).max
_VECTOR = "struct<n: bigint, terms: array<int>, counts: array<int>>"
_VECTOR_TYPE = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def vectors(text: Column, vocabulary) -> Column:
    """Number of terms of a text, and the vocabulary's numbers and counts in it."""

    @F.arrow_udf(_VECTOR)
    def vector(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = vocabulary.value
        for texts in it:
            out = []
            for t in texts:
                words = alnum_words(t.as_py())
                found = Counter(filter(None, map(number.get, words)))
                out.append({"n": len(words), "terms": list(found), "counts": list(found.values())})
            yield pa.array(out, _VECTOR_TYPE)

    return vector(text)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A set of queries: numbered terms with their weights, and which terms meet in a query."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        #: Per query its term numbers; per number its weight.
        self.terms, self.weights = terms, weights
        near: dict[int, list[np.ndarray]] = {}
        for own in terms:
            for t in own.tolist():
                near.setdefault(t, []).append(own)
        self.near = {t: np.unique(np.concatenate(x)) for t, x in near.items()}


class Best:
    """The k best (score, id) so far of one query; equal scores by rising id."""

    def __init__(self, k: int, floor: int = 0):
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """No score below this matters."""
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        s, d = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((d, -s))[: self.k]
        self.scores, self.ids = s[order], d[order]


class Segment:
    """An inverted index of some rows, its lists blocked by similarity."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: Queries):
        self.ids, self.ends, self.terms, self.impacts, self.queries = ids, ends, terms, impacts, queries
        self.rows = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.list_rows, self.list_impacts = self.rows[order], impacts[order]
        size = len(queries.weights)
        self.list_ends = np.searchsorted(terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, terms, impacts)
        # Projection: each term goes to one signed dimension; rows have length 1.
        sign = np.where((np.arange(size) * 2654435761 >> 13) & 1, 1.0, -1.0)
        self.flat = np.zeros((len(ids), DIMENSIONS), np.float32)
        np.add.at(self.flat, (self.rows, terms * 40503 % 65521 % DIMENSIONS), (impacts * sign[terms]).astype(np.float32))
        self.flat /= np.maximum(np.linalg.norm(self.flat, axis=1, keepdims=True), 1e-9)
        self.column = np.full(size, -1)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = 0

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all entries of some rows, and the place of each one's row in ``rows``."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        place = np.repeat(np.arange(len(rows)), sizes)
        first = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) - first[place] + self.ends[rows][place], place

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a list by block, the blocks' ends, and their summaries for ``queries.near[term]``."""
        if term in self.blocks:
            return self.blocks[term]
        rows = self.list_rows[self.list_ends[term] : self.list_ends[term + 1]]
        centres = rows[np.linspace(0, len(rows) - 1, -(-len(rows) // BLOCK)).astype(np.int64)]
        group = np.argmax(self.flat[rows] @ self.flat[centres].T, axis=1)
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], np.unique(group[order], return_inverse=True)[1]
        near = self.queries.near[term]
        at, place = self.entries(rows)
        self.column[near] = np.arange(len(near))
        column = self.column[self.terms[at]]
        self.column[near] = -1
        good = column >= 0
        summary = np.zeros((group[-1] + 1, len(near)), np.int64)
        np.maximum.at(summary, (group[place[good]], column[good]), self.impacts[at[good]])
        found = rows, np.searchsorted(group, np.arange(group[-1] + 2)), summary
        if self.held + summary.nbytes > SUMMARY_BYTES:
            self.blocks.clear()
            self.held = 0
        self.held += summary.nbytes
        self.blocks[term] = found
        return found

    def search(self, own: np.ndarray, best: Best, seen: np.ndarray, asked: np.ndarray) -> None:
        """Bring ``best`` up to date; ``seen`` (a flag a row) and ``asked`` (a flag a term) come and go as zeros."""
        own = own[self.most[own] > 0]
        own = own[np.argsort(-self.most[own], kind="stable")]
        rest = np.cumsum(self.most[own][::-1])[::-1]
        asked[own] = 1
        for term, left in zip(own.tolist(), rest.tolist()):
            if left < best.least:
                break
            rows, ends, summary = self.blocked(term)
            columns = np.searchsorted(self.queries.near[term], own)
            bound = summary[:, columns].sum(1)
            order = np.argsort(-bound, kind="stable")
            for start in range(0, len(order), 8):
                chosen = order[start : start + 8]
                chosen = chosen[bound[chosen] >= best.least]
                if not len(chosen):
                    break
                members = np.concatenate([rows[ends[b] : ends[b + 1]] for b in chosen.tolist()])
                members = members[~seen[members]]
                if not len(members):
                    continue
                seen[members] = True
                at, place = self.entries(members)
                found = np.zeros(len(members), np.int64)
                np.add.at(found, place, self.impacts[at] * asked[self.terms[at]])
                best.add(found, self.ids[members])
        asked[own] = 0
        seen[:] = False


def impacts(tf: np.ndarray, terms: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight times (1000000000 * tf) div (1000 * tf + 8 * m)."""
    tf = tf.astype(np.int64)
    return weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def length_norm(n: int, n_docs: int, all_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // all_terms


def _searched(rows: DataFrame, queries, floors, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """Per task the best rows (query, id, score) over its segments."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = [Best(k, f) for f in floors.value]
        flags = np.zeros(len(asked.weights), np.int64)
        held: list[pa.RecordBatch] = []

        def done() -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = part["id"].fill_null(_LAST).to_numpy()
            terms = part["terms"].combine_chunks()
            ends = terms.offsets.to_numpy().astype(np.int64)
            flat = terms.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            counts = part["counts"].combine_chunks().values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            m = np.array([length_norm(n, n_docs, all_terms) for n in part["n"].to_pylist()], np.int64)
            values = impacts(counts, flat, np.repeat(m, np.diff(ends)), asked.weights)
            segment = Segment(ids, ends, flat, values, asked)
            seen = np.zeros(len(ids), bool)
            for own, found in zip(asked.terms, best):
                segment.search(own, found, seen, flags)

        for batch in batches:
            for start in range(0, batch.num_rows, SEGMENT):
                held.append(batch.slice(start, SEGMENT))
                if sum(b.num_rows for b in held) >= SEGMENT:
                    done()
        if sum(b.num_rows for b in held):
            done()
        number = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        ids = np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])
        scores = np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=ids == _LAST), pa.array(scores)], ["query", "id", "score"])

    return rows.mapInArrow(search, "query int, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_sets(items: DataFrame, item_col: str, text_col: str, query_bytes: int) -> list[list]:
    """(item, terms) rows in sets of bounded size: items are dealt by hash, by the bytes of their distinct texts."""
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    sets = max(1, -(-2 * size // query_bytes))
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", _UP, _UP.lower()), F.lit(f"[{_TERM}]+"), F.lit(0)))
    words = items.select("item", F.explode(terms).alias("t")).groupBy("item").agg(F.collect_set("t").alias("terms"))
    words = words.withColumn("set", F.pmod(F.xxhash64("item"), F.lit(sets)))
    return [words.where(F.col("set") == i).select("item", "terms").collect() for i in range(sets)]


# Characters of terms, ASCII upper case.
_TERM = r"^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text: str = "text",
    k: int = K,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Per item its k best documents: item, rank (from 1), id, score."""
    spark = docs.sparkSession
    work = Workspace(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for part, rows in enumerate(_query_sets(items, item_col, item_text, query_bytes)):
        known = sorted({t for r in rows for t in r["terms"]})
        number = {t.encode(): i for i, t in enumerate(known, 1)}
        words = spark.sparkContext.broadcast(number)
        made = docs.where(F.col("text").isNotNull()).select("id", vectors(F.col("text"), words).alias("v"))
        made = work.table(made.select("id", "v.*").where("n > 0"), f"vectors{part}")
        n_docs, all_terms = made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
        frequency = dict(made.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([0, *(term_weight(n_docs, frequency.get(i, 0)) for i in range(1, len(known) + 1))], np.int64)
        own = [np.array(sorted(number[t.encode()] for t in r["terms"]), np.int64) for r in rows]
        queries = spark.sparkContext.broadcast(Queries(own, weights))
        # Rows without any term of the set score nothing.
        held = made.where("size(terms) > 0")
        floors = [0] * len(rows)
        some = _searched(held.where(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_SHARE)) == 0), queries, spark.sparkContext.broadcast(floors), n_docs, all_terms, k)
        for r in _best(some, k).where(F.col("rank") == k).collect():
            floors[r["query"]] = r["score"]
        found = _best(_searched(held, queries, spark.sparkContext.broadcast(floors), n_docs, all_terms, k), k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"query int, item {items.schema[item_col].dataType.simpleString()}")
        found = found.join(names, "query").select("item", "rank", "id", "score")
        out = found if out is None else out.unionByName(found)
    return work.last(out, "found")
