"""Near-duplicates: Chosen-path set similarity join over 5-word shingles.

1. *Sets.*  Each document's shingles are hashed to 64 bits; documents with equal
   sets form a class, and only classes go on, so exact copies cost nothing more.
   A class has a signature: one byte of each of ``MINS`` minwise hashes.
2. *Trees.*  ``TREES`` independent trees branch the classes: a node hands a class
   to a child for each minwise token that its random choice picks (``BRANCH`` in
   expectation), and two classes meet in a child if they share a picked token.  A
   pair of similarity J shares a root branch with probability 1 - exp(-J * TREES *
   BRANCH): 0.99996 at J = 0.85.
3. *Small nodes* (at most ``SMALL`` classes) are compared exhaustively, all
   signatures against all.  Pairs whose signatures agree too little (4.5 standard
   deviations below the wanted similarity) or whose sizes rule the similarity out
   are dropped; a spanning forest of the rest is confirmed first.  All pairs that
   confirmed links have not connected by then are confirmed inside their nodes: the
   full sets of the members with such a pair go there, and a pair of several nodes
   is looked at where it meets first.  Only links leave a node, so rows grow with the
   members, not with their pairs.
4. *Large nodes* are split into random blocks, which give a spanning forest and a
   medoid each; the best medoid becomes the node's hub and is compared with every
   member.  A node whose members are all connected by confirmed links is done; of
   the others every member is branched on, ``INNER_BRANCH`` children each by tokens of
   ``JOINED`` minwise values, down to ``DEPTH``; children of one component go no further.  Where a node is still
   large and unconnected there, the members outside its largest component are
   compared with all others, block against block, without loss.
5. *Confirmation* counts the common shingles of the full sets.  Components of the
   confirmed links give the least id reachable.

No pair inside a component is needed once the component is connected, so a group
of n near copies costs about n confirmations, not n^2.  Work is keyed by node, by
class or by pair; the driver sees counts only.  Tables that several steps read are
written to the checkpoint folder.

Chance: hashes of 64 bits stand for shingles and sets (among 10^9 different sets,
about 0.03 pairs share one); the recall of step 2 and 3 is as stated.

Edge cases: texts without words have an empty set, size 0, and are linked with
nothing; texts of fewer than five words have one shingle; rows without an id are
members like any other, but no component is named after them while it has a row
with an id; rows that repeat an id are each returned; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.workspace import Workspace
from .common import free_name, frugal
from .components import components

WORDS = 5
SIMILARITY = (85, 100)
MINS = 128
TREES = 6
BRANCH = 2.0
#: Children of a member of a large node, in expectation, and minwise values that their tokens join.
INNER_BRANCH, JOINED = 3.0, 3
SMALL = 200
DEPTH = 2
#: Standard deviations that a signature's agreement may lie below the wanted similarity.
SLACK = 4.5
#: Size of the bitmaps that spare documents a shuffle.
FILTER_BITS = 1 << 25
#: Rows of 16 bytes that are broadcast, once they are counted, in place of a bitmap or an exchange.
FEW = 1 << 17
#: Rows, and full sets, that a task of a step on the written tables is given.
TASK_ROWS, TASK_SETS = 20_000, 2_000

SKETCH = "struct<n: bigint, cid: bigint, sig: binary, roots: array<bigint>>"
FULL_SET = "struct<cid: bigint, shingles: array<bigint>>"
_SKETCH = pa.struct([("n", pa.int64()), ("cid", pa.int64()), ("sig", pa.binary()), ("roots", pa.list_(pa.int64()))])
_U = np.uint64
_SEEDS = np.frombuffer(hashlib.shake_128(b"near-duplicates").digest(8 * (2 * MINS + WORDS + TREES + 257)), np.uint64) | _U(1)
_MINWISE = (_SEEDS[:MINS] >> _U(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (_SEEDS[MINS : 2 * MINS] >> _U(32)).astype(np.uint32)
_PLACES, _TREE = _SEEDS[2 * MINS : 2 * MINS + WORDS], _SEEDS[2 * MINS + WORDS : 2 * MINS + WORDS + TREES]
_WEIGHTS = np.cumprod(np.full(1024, _SEEDS[-1]))
#: A number per byte: 0 for separators, the same for both cases of an ASCII letter.
_BYTES = np.array([0 if c in b" \t\n\r\x0b\f" else _SEEDS[-257 + (c + 32 if 65 <= c <= 90 else c)] for c in range(256)], np.uint64)
_AT = np.arange(MINS, dtype=np.uint64) << _U(32)
_PICK, _PICK_INNER = (_U(int(b / MINS * 2**32)) for b in (BRANCH, INNER_BRANCH))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased.

    Bytes are replaced by random numbers (separators by 0), weighted by their place in
    the word and summed, modulo 2^64.
    """
    raw = np.frombuffer((text or "").encode(), np.uint8)
    value = _BYTES[raw]
    in_word = value != 0
    starts = np.flatnonzero(in_word & np.concatenate([[True], ~in_word[:-1]])) if len(raw) else raw
    if not len(starts):
        return np.zeros(0, np.uint64)
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    longest = int(spans.max())
    weight = _WEIGHTS if longest <= len(_WEIGHTS) else np.cumprod(np.full(longest, _WEIGHTS[0]))
    return mix(np.add.reduceat(value[starts[0] :] * weight[place], starts - starts[0]))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(WORDS, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for place in range(k):
        total = total + h[place : place + len(total)] * _PLACES[place]
    return np.unique(mix(total))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The set's least value under each of ``MINS`` hash functions (uint32)."""
    x = (hashes >> _U(32)).astype(np.uint32)
    out = np.full(MINS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 1024):
        values = x[None, start : start + 1024] * _MINWISE[:, None]
        values += _OFFSETS[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def roots(mins: np.ndarray) -> np.ndarray:
    """Root branches of the trees that a set enters."""
    token = mix(_AT | mins.astype(np.uint64))
    draw = mix(token[None, :] ^ _TREE[:, None])
    return draw[(draw >> _U(32)) < _PICK]


def sketch(text: str | None) -> dict:
    found = shingles(text)
    if not len(found):
        return {"n": 0, "cid": None, "sig": None, "roots": []}
    mins = minwise(found)
    sig = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return {"n": len(found), "cid": set_id(found), "sig": sig.tobytes(), "roots": roots(mins).astype(np.int64).tolist()}


@frugal
def _sketches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([sketch(t.as_py()) for t in texts], _SKETCH)


def set_id(found: np.ndarray) -> int | None:
    """The id of the class of a set of shingles; none for an empty one."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True) if len(found) else None


@frugal
def _set_ids(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([set_id(shingles(t.as_py())) for t in texts], pa.int64())


@frugal
def _full_sets(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        ids, values, ends = [], [np.zeros(0, np.int64)], [0]
        for t in texts:
            found = shingles(t.as_py())
            ids.append(set_id(found))
            values.append(found.view(np.int64))
            ends.append(ends[-1] + len(found))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
        yield pa.StructArray.from_arrays([pa.array(ids, pa.int64()), lists], ["cid", "shingles"])


def signatures(column: pa.Array) -> np.ndarray:
    """A binary column of signatures as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINS)


@frugal
def _children(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Children of a node that a class enters, by the node's path and the class's signature.

    A token joins the bytes of ``JOINED`` neighbouring minwise values: unrelated classes share
    one in 2^24, and classes that have only a passage in common few.
    """
    for paths, sigs in it:
        path, values = paths.to_numpy(zero_copy_only=False).view(np.uint64), signatures(sigs).astype(np.uint64)
        count = MINS - JOINED + 1
        joined = sum(values[:, j : j + count] << _U(8 * j) for j in range(JOINED))
        out, ends = [np.zeros(0, np.uint64)], [0]
        for start in range(0, len(path), 1000):
            token = mix(_AT[None, :count] | joined[start : start + 1000])
            draw = mix(token ^ mix(path[start : start + 1000] + _U(1))[:, None])
            picked = (draw >> _U(32)) < _PICK_INNER
            out.append(draw[picked])
            ends.extend((ends[-1] + np.cumsum(picked.sum(1))).tolist())
        flat = pa.array(np.concatenate(out).view(np.int64))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _agreement(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in it:
        yield pa.array((signatures(a) == signatures(b)).sum(1).astype(np.int32))


def id_filter(ids: DataFrame):
    """A test of id columns that holds for every id of ``ids`` and for few others.

    A bitmap of ``FILTER_BITS`` hashed ids, whatever their number: driver and
    executors hold that many bits.  The more ids there are, the more others pass, so
    an exact join must follow.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    placed = ids.select(place(F.col("id")).alias("p"))
    part = placed.groupBy(F.shiftright("p", 15).alias("k")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767).cast("long"))).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in part.collect():  # at most FILTER_BITS bits
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def test(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for places in it:
            at = places.to_numpy(zero_copy_only=False)
            yield pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda column: F.arrow_udf(test, "boolean")(place(column))


def least_agreement(similarity: tuple[int, int]) -> int:
    """Signature bytes that a pair of the wanted similarity shares but for ``SLACK`` deviations."""
    j = similarity[0] / similarity[1]
    return max(1, int(MINS * j - SLACK * math.sqrt(MINS * j * (1 - j))))


def possible_pairs(comp: np.ndarray, n: np.ndarray, sig: np.ndarray, similarity: tuple[int, int]) -> tuple:
    """Index pairs of a node that may be similar and lie in different components, with their agreement."""
    agree = np.stack([(row == sig).sum(1) for row in sig])
    low, high = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    good = (agree >= least_agreement(similarity)) & (low * similarity[1] >= high * similarity[0])
    a, b = np.nonzero(np.triu(good & (comp[:, None] != comp), 1))
    return a, b, agree


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, comp: np.ndarray, cid: np.ndarray) -> list[int]:
    """Positions of the pairs that form a forest of greatest agreement over the components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    low, high = np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b])
    picked = []
    for i in np.lexsort((high, low, -weight)).tolist():
        x, y = root(int(comp[a[i]])), root(int(comp[b[i]]))
        if x != y:
            parent[x] = y
            picked.append(i)
    return picked


def common_shingles(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``a`` and ``b``."""
    if not len(a):
        return np.zeros(0, np.int64)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < 4 * len(used):
        pairs = zip(a.tolist(), b.tolist())
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    # Many pairs of few sets: products of incidence matrices, some columns (shingles) at a time.
    rows = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    columns = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(used), len(used)), np.float64)
    for start in range(0, int(columns[-1]) + 1, 4096):
        low, high = np.searchsorted(columns, [start, start + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[rows[low:high], columns[low:high] - start] = 1
        total += part @ part.T
    return total[at[: len(a)], at[len(a) :]].astype(np.int64)


def meet_first(a: np.ndarray, b: np.ndarray, path: int, around: np.ndarray) -> np.ndarray:
    """Whether the members at ``a`` and ``b`` of a node share no node of a lesser path; ``around`` has each member's nodes."""
    lesser = [x[x < path] for x in around]
    places, at = np.unique(np.concatenate(lesser), return_inverse=True)
    held = np.zeros((len(lesser), len(places)), np.float32)
    held[np.repeat(np.arange(len(lesser)), [len(x) for x in lesser]), at] = 1
    return (held @ held.T)[a, b] == 0


def _with_partner(similarity: tuple[int, int]):
    """The rows of each node that have a possible partner, as far as the two do not meet in a lesser node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def rows() -> pa.RecordBatch:
            *plain, sig, around = (np.concatenate(c) for c in zip(*found))
            found.clear()
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MINS), len(sig), [None, pa.py_buffer(sig.tobytes())])
            columns = [*map(pa.array, plain), sigs.cast(pa.binary()), pa.array(list(around), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["path", "block", "cid", "comp", "n", "sig", "around"])

        for node in _nodes(batches):
            path, _, cid, comp, n, sig, around = node
            a, b, _ = possible_pairs(comp, n, sig, similarity)
            here = meet_first(a, b, path[0], around)
            own = np.union1d(a[here], b[here])
            if len(own):
                found.append(tuple(c[own] for c in node))
            if sum(len(f[0]) for f in found) >= 2_000:
                yield rows()
        if found:
            yield rows()

    return run


def _confirm_inside(similarity: tuple[int, int]):
    """Links (u, v) that join different components of each node, confirmed on the full sets its rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        for path, _, cid, comp, n, sig, sets, *around in _nodes(batches):
            a, b, agree = possible_pairs(comp, n, sig, similarity)
            if around:
                here = meet_first(a, b, path[0], around[0])
                a, b = a[here], b[here]
            common = common_shingles(sets, a, b)
            good = common * den >= (n[a] + n[b] - common) * num
            a, b = a[good], b[good]
            keep = spanning(a, b, agree[a, b], comp, cid)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(cid[a[keep]]), pa.array(cid[b[keep]])], ["u", "v"])

    return run


NODE = "path bigint, block bigint, cid bigint, comp bigint, n bigint, sig binary"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The nodes (path, block) of rows sorted by them, across batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [signatures(batch.column(5))]
        cols += [c.to_numpy(zero_copy_only=False) for c in batch.columns[6:]]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        for start, stop in zip([0, *cut[:-1]], cut):
            yield tuple(c[start:stop] for c in cols)
        rest = [c[cut[-1] if len(cut) else 0 :] for c in cols]
    if rest is not None:
        yield tuple(rest)


def _compare(similarity: tuple[int, int], medoids: bool):
    """A spanning forest (a, b) of each node; with ``medoids`` also its medoid, as (path, a = b, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            batch = pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], ["path", "a", "b", "score"])
            for o in out:
                o.clear()
            return batch

        for path, _, cid, comp, n, sig in _nodes(batches):
            if len(cid) < 2 and not medoids:
                continue
            a, b, agree = possible_pairs(comp, n, sig, similarity)
            keep = spanning(a, b, agree[a, b], comp, cid)
            a, b = a[keep], b[keep]
            x, y = cid[a], cid[b]
            for o, values in zip(out, (path[a], np.minimum(x, y), np.maximum(x, y), np.zeros(len(a)))):
                o.extend(values.tolist())
            if medoids:
                mean = agree.mean(1)
                best = np.lexsort((cid, -mean))[0]
                for o, value in zip(out, (int(path[0]), int(cid[best]), int(cid[best]), float(mean[best]))):
                    o.append(value)
            if len(out[0]) >= 10_000:
                yield flush()
        yield flush()

    return run


class _Search:
    """One run: classes, confirmed links and what has been looked at, in the workspace."""

    def __init__(self, docs: DataFrame, similarity: tuple[int, int]):
        self.spark = docs.sparkSession
        self.docs, self.similarity = docs, similarity
        self.work = Workspace(self.spark)
        self.k = 0
        self.comp: DataFrame | None = None
        self.checked: DataFrame | None = None
        self.sets: DataFrame | None = None
        #: Confirmed links that the components do not hold yet, and rows of both.
        self.pending: list[DataFrame] = []
        self.links = 0
        #: Rows of the documents, and of the nodes being looked at.
        self.n_docs = self.n_nodes = 0

    def tasks(self, rows: int, each: int = TASK_ROWS) -> int:
        """Tasks for a step on at most ``rows`` rows."""
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // each))

    def few(self, df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
        """The frame in no more partitions than its last step, on at most ``rows`` rows, has use for."""
        return df.coalesce(self.tasks(rows, each))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.k += 1
        return self.work.table(df, f"{self.k}_{name}")

    def counted(self, df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, dict]:
        self.k += 1
        return self.work.counted(df, f"{self.k}_{name}", **more)

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """Nodes (path, cid) with each class's component so far."""
        if self.comp is None:
            return nodes.withColumn("comp", F.col("cid"))
        known = self.comp.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        return nodes.join(known, "cid", "left").select("path", "cid", F.coalesce("root", "cid").alias("comp"))

    def open_nodes(self, nodes: DataFrame) -> DataFrame:
        """Nodes whose members are not all connected: (path, size)."""
        sizes = self.labelled(nodes).groupBy("path").agg(
            F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        return sizes.where("low < high").select("path", "size")

    def members(self, nodes: DataFrame, chosen: DataFrame, block: Column, *more: Column) -> DataFrame:
        """Rows of the chosen nodes as ``NODE`` and ``more``, one task per (path, block), sorted by it."""
        rows = self.labelled(nodes).join(chosen, "path")
        rows = rows.join(self.classes.select("cid", "n", "sig"), "cid").withColumn("block", block)
        rows = rows.select("path", "block", "cid", "comp", "n", "sig", *more)
        return rows.repartition(self.tasks(self.n_nodes), "path", "block").sortWithinPartitions("path", "block")

    def compare(self, rows: DataFrame, medoids: bool = False) -> DataFrame:
        run = _compare(self.similarity, medoids)
        return rows.mapInArrow(frugal(run), "path bigint, a bigint, b bigint, score double")

    def hub_pairs(self, nodes: DataFrame, large: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of each large node's hub and its members that may be similar."""
        hubs = found.where("a = b").groupBy("path").agg(F.max_by("a", F.struct("score", "a")).alias("hub"))
        sized = self.classes.select("cid", "n", "sig")
        hubs = hubs.join(sized.select(F.col("cid").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig")), "hub")
        rows = nodes.join(hubs, "path").where("cid <> hub").join(sized, "cid")
        num, den = self.similarity
        rows = rows.where(F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num)
        near = rows.withColumn("agree", F.arrow_udf(_agreement, "int")("sig", "hub_sig")).where(F.col("agree") >= least_agreement(self.similarity))
        return near.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))

    def texts_of(self, classes: DataFrame, n: int) -> DataFrame:
        """Documents of the ``n`` classes (cid): that of the least id, and maybe others."""
        if n <= FEW:
            reps = self.classes.join(F.broadcast(classes), "cid").select(F.col("rep").alias("wanted_id"))
            return self.docs.join(F.broadcast(reps), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
        return self.docs.where(id_filter(self.classes.join(classes, "cid").select(F.col("rep").alias("id")))(F.col("id")))

    def add_sets(self, pairs: DataFrame, most: int) -> None:
        """Full sets of the classes (at most so many) in ``pairs`` that are not there yet."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cid"), "cid", "left_anti")
        wanted, seen = self.counted(self.few(wanted, most), "wanted")
        if not seen["n"]:
            return
        # Any document of the class has its set: read the one with the least id again.
        texts = self.texts_of(wanted, seen["n"])
        # Not to be moved below the choice of the texts: the optimizer must not take the function for cheap.
        full = F.arrow_udf(_full_sets, FULL_SET).asNondeterministic()
        found = texts.select(full("text").alias("s")).select("s.cid", "s.shingles")
        own = F.broadcast(wanted) if seen["n"] <= FEW else wanted
        found = found.join(own, "cid").dropDuplicates(["cid"])
        found = self.keep(self.few(found, seen["n"], TASK_SETS), "sets")
        self.sets = found if self.sets is None else self.sets.unionByName(found)

    def sets_of(self, rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
        """Full sets of the classes in a column (of ``n`` rows), and maybe few others, for a join: the rest isn't moved."""
        own = rows.select(F.col(column).alias("id"))
        if n is not None and n <= FEW:
            return self.sets.join(F.broadcast(own), F.col("cid") == F.col("id"), "left_semi")
        return self.sets.where(id_filter(own)(F.col("cid")))

    def confirm(self, pairs: DataFrame, name: str, most: int) -> None:
        """Check candidate pairs (a, b), at most so many, on full sets, and note the links among them."""
        pairs = pairs.select("a", "b").distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs, seen = self.counted(self.few(pairs, most), f"{name}_pairs")
        n = seen["n"]
        if not n:
            return
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        self.add_sets(pairs, 2 * n)
        right = self.sets_of(pairs, "b", n).select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
        if n <= FEW:  # the sets of one side are joined where they lie
            left = self.sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")).join(F.broadcast(pairs), "a")
        else:
            left = pairs.join(self.sets_of(pairs, "a").select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        both = left.join(right, "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        num, den = self.similarity
        linked = common * den >= (F.size("x") + F.size("y") - common) * num
        links = both.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
        self.link(self.few(links, n, TASK_SETS), name)

    def confirm_all(self, nodes: DataFrame, small: DataFrame, name: str) -> None:
        """Check all pairs of small nodes that may be similar, where their members meet first, and note the links.

        A class is in a number of nodes that the trees bound, whatever its group's size.
        """
        around = F.collect_list("path").over(Window.partitionBy("cid")).alias("around")
        rows = self.members(nodes, small, F.lit(0).cast("long"), around)
        asked = rows.mapInArrow(frugal(_with_partner(self.similarity)), f"{NODE}, around array<bigint>")
        asked, seen = self.counted(asked, f"{name}_asked")
        n = seen["n"]
        if not n:
            return
        self.add_sets(asked.select(F.col("cid").alias("a"), F.col("cid").alias("b")), n)
        rows = asked.join(self.sets_of(asked, "cid", n), "cid")
        rows = rows.select("path", "block", "cid", "comp", "n", "sig", "shingles", "around")
        rows = rows.repartition(self.tasks(n, TASK_SETS), "path", "block").sortWithinPartitions("path", "block")
        self.link(rows.mapInArrow(frugal(_confirm_inside(self.similarity)), "u bigint, v bigint"), name)

    def link(self, found: DataFrame, name: str) -> None:
        """Note confirmed links (u, v)."""
        edges, seen = self.counted(found, f"{name}_edges")
        if seen["n"]:
            self.pending.append(edges)
            self.links += seen["n"]

    def settle(self) -> None:
        """Bring the components up to date with the links noted since; the stars so far stand for the links they came from."""
        if not self.pending:
            return
        links = [*([self.comp] if self.comp is not None else []), *self.pending]
        self.pending = []
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        self.k += 1
        self.comp = components(edges, self.work, f"{self.k}_stars", self.links)

    def search(self) -> None:
        """Find the classes and confirm the links between them."""
        sketched = self.docs.select("id", F.arrow_udf(_sketches, SKETCH)("text").alias("s")).select("id", "s.*")
        self.sketched, seen = self.counted(sketched, "sketches")
        self.n_docs = seen["n"]
        first = [F.first(c).alias(c) for c in ("n", "sig", "roots")]
        grouped = self.sketched.where("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), *first)
        self.classes, seen = self.counted(self.few(grouped, self.n_docs), "classes", roots=F.sum(F.size("roots")))
        roots = seen["roots"] or 0
        nodes = self.classes.select(F.explode("roots").alias("path"), "cid")
        # Only nodes that two classes share.
        shared = nodes.groupBy("path").agg(F.count("*").alias("c")).where("c > 1").select("path")
        nodes, seen = self.counted(self.few(nodes.join(shared, "path", "left_semi"), roots), "nodes")
        self.n_nodes = seen["n"]
        for depth in range(DEPTH + 1):
            nodes = self.level(nodes, depth)
            if nodes is None:
                break
        self.settle()

    def level(self, nodes: DataFrame, depth: int) -> DataFrame | None:
        """Compare the nodes of one depth; the nodes of the next, if there are any."""
        open_now, seen = self.counted(self.few(self.open_nodes(nodes), self.n_nodes), "open", largest=F.max("size"))
        if not seen["n"]:
            return None
        small, large = open_now.where(F.col("size") <= SMALL), open_now.where(F.col("size") > SMALL)
        pairs = self.compare(self.members(nodes, small.select("path"), F.lit(0).cast("long"))).select("a", "b")
        if seen["largest"] > SMALL:
            blocks = F.ceil(F.col("size") / SMALL)
            rows = self.members(nodes, large, F.pmod(F.xxhash64(F.lit(depth), "cid"), blocks))
            found = self.keep(self.compare(rows, medoids=True), "blocks")
            pairs = pairs.unionByName(found.where("a <> b").select("a", "b"))
            pairs = pairs.unionByName(self.hub_pairs(nodes, large, found))
        # A forest has fewer pairs than members, and so have the hubs.
        self.confirm(pairs, f"forest{depth}", 2 * self.n_nodes)
        self.settle()
        still = self.few(self.open_nodes(nodes), self.n_nodes)
        still, seen = self.counted(still, "still_open", largest=F.max("size"))
        if not seen["n"]:
            return None
        self.confirm_all(nodes, still.where(F.col("size") <= SMALL).select("path"), f"all{depth}")
        if seen["largest"] <= SMALL:
            return None
        rest = still.where(F.col("size") > SMALL)
        if depth == DEPTH:
            self.settle()
            self.finish(nodes, rest)
            return None
        inner = self.labelled(nodes).join(rest.select("path"), "path", "left_semi").join(self.classes.select("cid", "sig"), "cid")
        # The members of a large node are dealt out before they are branched on.
        inner = inner.repartition(self.tasks(self.n_nodes), "cid", "path").withColumn("to", F.arrow_udf(_children, "array<bigint>")("path", "sig"))
        below, seen = self.counted(inner.select(F.explode("to").alias("path"), "cid", "comp"), "children")
        # Only children that can still bring a link.
        open_below = below.groupBy("path").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        below = below.join(open_below.select("path"), "path", "left_semi").select("path", "cid")
        below, seen = self.counted(self.few(below, seen["n"]), "nodes")
        self.n_nodes = seen["n"]
        return below

    def finish(self, nodes: DataFrame, large: DataFrame) -> None:
        """Connect what is left of large nodes: members outside a node's largest component against all others.

        Both sides are cut into blocks, a pair of blocks is a node, and full sets are
        compared inside it.  Members of the largest component are not compared with
        each other; the others are.
        """
        rows = self.keep(self.few(self.labelled(nodes).join(large.select("path"), "path", "left_semi"), self.n_nodes), "large")
        parts = rows.groupBy("path", "comp").agg(F.count("*").alias("c"))
        parts = parts.groupBy("path").agg(
            F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all")
        )
        half = SMALL // 2
        inside, outside = F.ceil(F.col("most") / half), F.ceil((F.col("all") - F.col("most")) / half)
        rows = rows.join(parts, "path").select(
            "path", "cid", "comp", (F.col("comp") == F.col("main")).alias("in_main"), inside.alias("k"), outside.alias("m")
        )
        own = F.pmod(F.xxhash64(F.lit(-1), "cid"), F.when(F.col("in_main"), F.col("k")).otherwise(F.col("m")))
        # Read three times: joined once.
        rows = self.keep(self.few(rows.withColumn("own", own), self.n_nodes), "blocks_of")
        k, m, own = F.col("k"), F.col("m"), F.col("own")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        with_outside = F.transform(upto(m), lambda j: j * k + own)
        with_main = F.transform(upto(k), lambda j: own * k + j)
        with_others = F.transform(upto(m), lambda j: m * k + F.least(own, j) * m + F.greatest(own, j))
        blocks = F.when(F.col("in_main"), with_outside).otherwise(F.concat(with_main, with_others))
        self.add_sets(rows.select(F.col("cid").alias("a"), F.col("cid").alias("b")), self.n_nodes)
        members = rows.select("path", blocks.alias("blocks"), "cid", "comp")
        members = members.join(self.classes.select("cid", "n", "sig"), "cid").join(self.sets_of(rows, "cid"), "cid")
        members = members.select("path", F.explode("blocks").alias("block"), "cid", "comp", "n", "sig", "shingles")
        sorted_rows = members.repartition("path", "block").sortWithinPartitions("path", "block")
        links = sorted_rows.mapInArrow(frugal(_confirm_inside(self.similarity)), "u bigint, v bigint")
        self.link(links, "rest")

    def groups(self) -> DataFrame:
        """Per class: its component (root) and that component's least id (rep)."""
        named = self.classes.select("cid", "rep")
        if self.comp is None:
            return named.withColumn("root", F.col("cid"))
        known = self.comp.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        rooted = named.join(known, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
        return rooted.join(least, "root").select("cid", F.col("least").alias("rep"), "root")

    def result(self) -> DataFrame:
        # Rows without words are linked with nothing; as a null key they would all meet in one task.
        rows = self.sketched.where("cid is not null").join(self.groups().drop("root"), "cid", "left")
        empty = self.sketched.where("cid is null").withColumn("rep", F.lit(None).cast(rows.schema["rep"].dataType))
        out = rows.unionByName(empty)
        component = F.coalesce("rep", "id")
        return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

    def unsettled(self) -> DataFrame:
        """Pairs (id, cid) of which not every row stays; ``root`` is set where just one row of that component does.

        A component's candidates are its rows of the least id, or all if none has an
        id.  All other pairs are dropped, and of several candidates one row stays.
        """
        rows = self.sketched.where("cid is not null").join(self.groups(), "cid")
        pairs = rows.groupBy("id", "cid", "root", F.col("id").eqNullSafe(F.col("rep")).alias("first")).agg(F.count("*").alias("c"))
        pairs = self.keep(self.few(pairs, self.n_docs), "pairs")
        several = pairs.where("first").groupBy("root").agg(F.sum("c").alias("c")).where("c > 1").select("root")
        tied = pairs.where("first").join(several, "root").select("id", "cid", "root")
        both = pairs.where("not first").select("id", "cid", F.lit(None).cast("long").alias("root")).unionByName(tied)
        return self.keep(self.few(both, 2 * self.n_docs), "unsettled")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """Per document: its id, n_shingles, component_id and kept (it is its component's least id).

    Documents are linked if ``similarity[1] * |intersection| >= similarity[0] * |union|``
    for their sets of shingles.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    search = _Search(rows, similarity)
    search.search()
    result = search.few(search.result(), search.n_docs)
    return search.work.last(result.withColumnRenamed("id", id_col), "result")


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """One document of each component: the one of its least id, or any if none has an id.

    Rows are told apart by id and set of shingles, so an id of two texts loses only the
    one that has a smaller id in its component.  Of several rows of the least id, or
    without any, one stays.  Texts without words all stay.
    """
    search = _Search(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), similarity)
    search.search()
    unsettled = search.unsettled()
    search.work.drop_but(search.work.names[-1])
    taken = free_name(docs, "dropped_id"), free_name(docs, "class"), free_name(docs, "component"), free_name(docs, "row_tag")
    name, cid, root, tag = taken
    unsettled = unsettled.toDF(name, cid, root)

    def open_rows(pairs: DataFrame) -> Column:
        # Only documents that may be among the unsettled ones are moved to find out.
        return id_filter(pairs.select(F.col(name).alias("id")))(F.col(id_col))

    may_hold = open_rows(unsettled)
    classed = lambda rows: rows.withColumn(cid, F.arrow_udf(_set_ids, "bigint")(F.col(text_col)))
    same = lambda rows, pairs: rows[id_col].eqNullSafe(pairs[name]) & (rows[cid] == pairs[cid])
    unsure = classed(docs.where(may_hold))
    settled = unsure.join(unsettled, same(unsure, unsettled), "left_anti")
    out = docs.where(~may_hold).unionByName(settled.select(*docs.columns))
    tied = unsettled.where(F.col(root).isNotNull())
    if tied.isEmpty():
        return out
    # A tag holds only if it is written once.
    rows = classed(docs.where(open_rows(tied)))
    rows = rows.join(tied, same(rows, tied)).select(*[rows[c] for c in docs.columns], root)
    rows = search.keep(rows.withColumn(tag, F.monotonically_increasing_id()), "tied")
    first = rows.groupBy(root).agg(F.min(tag).alias(tag))
    return out.unionByName(rows.join(first, [root, tag], "left_semi").select(*docs.columns))
