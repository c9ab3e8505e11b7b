"""Byte-level BPE with a given public vocabulary: two-tier encoding, and decoding.

Tier 1: a minimal perfect hash over the vocabulary (hash, then displace: one
displacement per bucket of about four entries, exactly one slot per entry) says
whether a whole pre-token is an entry; the entry's bytes are compared, so a
foreign pre-token is never mistaken for one.  Tier 2, for the misses: the bytes
as a doubly linked list, and a heap of mergeable neighbours by (rank, position),
so a pre-token of n bytes takes O(n log n) steps, however long it is.

Pre-tokens never contain a space behind another character, so a text is first cut
before single spaces; a worker remembers the ids of such pieces in a cache of
bounded size, which changes no result.

The vocabulary is read once on the driver from the path given and broadcast: its
size is fixed by the file (some 50,000 entries), not by the data.  Documents are
not shuffled.

Edge cases: null and empty texts have no ids and decode to no bytes; special
tokens are never produced; an id outside the vocabulary fails the decoding; very
long texts and pre-tokens are encoded whole; every row is encoded by itself, so
repeated rows, ids and extra columns do not matter.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import heapq
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, give_back

#: Bytes of remembered pre-tokens and ids per worker and generation (there are two), with what Python adds to an entry.
CACHE_BYTES = 100 << 20
_ENTRY_BYTES = 210
#: Texts of a batch whose Python strings and ids a worker holds at a time.
BATCH_ROWS = 500
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_BUCKET = 3


def _spread(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Second hash of keys for displacements ``d``, on arrays of uint64."""
    x = h ^ (d * np.uint64(_STEP))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def _spread_one(h: int, d: int) -> int:
    """The same on integers."""
    x = h ^ ((d * _STEP) & _MASK)
    x = ((x ^ (x >> 31)) * _MIX) & _MASK
    return x ^ (x >> 29)


class PerfectHash:
    """Minimal perfect hash of byte strings: key -> slot in 0..n-1, one slot per key."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.n_buckets = n, n // _BUCKET + 1
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("two vocabulary entries share a hash")
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for h in hashes:
            buckets[h % self.n_buckets].append(h)
        displace = np.zeros(self.n_buckets, np.int64)
        free = np.ones(n, bool)
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                break
            own, d = np.array(buckets[b], np.uint64), 1
            while True:  # the first displacement that sends every key to a free slot of its own
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = np.sort(_spread(own[None, :], tries[:, None]) % np.uint64(n), axis=1)
                good = free[slots].all(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
                if good.any():
                    break
                d += 64
            at = int(np.argmax(good))
            displace[b] = d + at
            free[slots[at]] = False
        # Buckets of one key name a free slot outright.
        single = [b for b in range(self.n_buckets) if len(buckets[b]) == 1]
        displace[single] = -np.flatnonzero(free)[: len(single)] - 1
        self.displace = displace.tolist()

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n_buckets]
        return -d - 1 if d < 0 else _spread_one(h, d) % self.n


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a file of base64 and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: A heap's numbers hold a rank above a position of so many bits: small numbers for all but very long pre-tokens.
_SHORT, _LONG = 13, 32
_NONE: dict[int, int] = {}


def merge_pairs(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """For every entry as the left part: the ranks of the entries it makes, by the right part."""
    out = [_NONE] * (max(ranks.values()) + 1)
    for entry, rank in ranks.items():
        for k in range(1, len(entry)):
            left, right = ranks.get(entry[:k]), ranks.get(entry[k:])
            if left is not None and right is not None:
                if out[left] is _NONE:
                    out[left] = {}
                out[left][right] = rank
    return out


def byte_pairs(of_byte: list[int], pairs: list[dict[int, int]]) -> list[list[int]]:
    """Rank of every two bytes, -1 for none."""
    return [[pairs[a].get(b, -1) for b in of_byte] for a in of_byte]


def merge_bytes(piece: bytes, of_byte: list[int], starts: list[list[int]], pairs: list[dict[int, int]]) -> list[int]:
    """Ids of a pre-token: lowest rank first, leftmost among equals."""
    push, pop, swap = heapq.heappush, heapq.heappop, heapq.heapreplace
    ids = [of_byte[b] for b in piece]  # -1 for a part merged into the one before
    n = len(ids)
    bits = _SHORT if n >> _SHORT == 0 else _LONG
    low = (1 << bits) - 1
    #: Rank of each part with its next one; -1 for none, and for parts merged away.
    pair = [starts[a][b] for a, b in zip(piece, piece[1:])]
    heap = [(r << bits) | i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return ids
    heapq.heapify(heap)
    pair.append(-1)
    after = list(range(1, n + 1))  # start of the next part; the last part's is n
    before = list(range(-1, n - 1))
    while heap:
        top = heap[0]
        i, rank = top & low, top >> bits
        if pair[i] != rank:
            pop(heap)  # a part of this pair has been merged meanwhile
            continue
        mid = after[i]
        end = after[i] = after[mid]
        ids[i], ids[mid], pair[mid] = rank, -1, -1
        r = -1
        if end < n:
            before[end] = i
            r = pairs[rank].get(ids[end], -1)
        pair[i] = r
        if r >= 0:
            swap(heap, (r << bits) | i)
        else:
            pop(heap)
        left = before[i]
        if left >= 0:
            r = pair[left] = pairs[ids[left]].get(rank, -1)
            if r >= 0:
                push(heap, (r << bits) | left)
    return [i for i in ids if i >= 0]


class Vocabulary:
    """Ranks, the perfect hash and the entry in each of its slots; what is broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ranks of 2^20 and more are not packed")
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self.slots: list[tuple[bytes, int]] = [(b"", 0)] * len(ranks)
        for key, rank in ranks.items():
            self.slots[self.whole.slot(key)] = (key, rank)


class Encoder:
    """Encodes texts; ids are remembered and joined as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, cache_bytes: int = CACHE_BYTES):
        self.whole, self.slots = vocabulary.whole, vocabulary.slots
        self.of_byte = [vocabulary.ranks[bytes([b])] for b in range(256)]
        self.pairs = merge_pairs(vocabulary.ranks)
        self.starts = byte_pairs(self.of_byte, self.pairs)
        # The merge library's \s is Unicode White_Space.
        own = vocabulary.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(own)
        self.known = vocabulary.pattern == KNOWN_PATTERN
        #: Bytes that the young generation of each kind may still take, and may take at most.
        self.most = {"spaced": cache_bytes * 7 // 8, "bare": cache_bytes // 8}
        self.room = dict(self.most)
        #: Packed ids of pieces behind a space (without it), and of other pre-tokens; the ``old`` ones fall out next.
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.old_spaced: dict[str, bytes] = {}
        self.old_bare: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.known:
            word = text.rstrip(_MARKS)
            letters = word[1:] if word[:1] == " " else word
            if letters.isascii() and letters.isalpha():
                return [word] if len(word) == len(text) else [word, text[len(word) :]]
        return self.pattern.findall(text)

    def pre_token(self, text: str) -> list[int]:
        piece = text.encode()
        key, rank = self.slots[self.whole.slot(piece)]
        return [rank] if key == piece else merge_bytes(piece, self.of_byte, self.starts, self.pairs)

    def pack(self, pre_token: str) -> bytes:
        ids = self.pre_token(pre_token)
        return struct.pack(f"<{len(ids)}i", *ids)

    def after_space(self, piece: str) -> bytes:
        """Ids of a space and a piece of text behind it."""
        ids = self.spaced.get(piece) or self.old_spaced.get(piece)
        if ids is None:
            first, *more = self.pre_tokens(" " + piece)
            if more:
                head = self.after_space(first[1:]) if len(first) > 1 else self.pack(first)
                ids = head + b"".join(map(self.without_space, more))
            else:
                ids = self.pack(first)
        if len(piece) <= 64:
            if self.full("spaced", piece, ids):
                self.spaced, self.old_spaced = {}, self.spaced
            self.spaced[piece] = ids
        return ids

    def full(self, kind: str, piece: str, ids: bytes) -> bool:
        """Whether a generation has to end before it takes another entry, whose bytes are counted."""
        size = _ENTRY_BYTES + 4 * len(piece) + len(ids)
        self.room[kind] -= size
        if self.room[kind] >= 0:
            return False
        self.room[kind] = self.most[kind] - size
        return True

    def without_space(self, pre_token: str) -> bytes:
        ids = self.bare.get(pre_token) or self.old_bare.get(pre_token)
        if ids is None:
            ids = self.pack(pre_token)
        if len(pre_token) <= 64:
            if pre_token not in self.bare and self.full("bare", pre_token, ids):
                self.bare, self.old_bare = {}, self.bare
            self.bare[pre_token] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return b"".join(map(self.without_space, self.pattern.findall(text)))
        first, spaced = cut(text)
        out = list(map(self.spaced.get, spaced))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self.after_space(spaced[i])
        return b"".join([*map(self.without_space, self.pre_tokens(first)), *out])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


# Fixed value: the pattern for which the two short cuts below hold.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Behind a word of ASCII letters these make one pre-token.
_MARKS = ".,;:!?*$%&|#)"
# White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space beside white space is no cut.
_EDGES = [e for c in _WHITE for e in (c + " ", " " + c)]
_ASCII_EDGES = [e for e in _EDGES if e.isascii()]
_CUT = regex.compile(r"(?<=\P{White_Space})(?=\x20\P{White_Space})")


def cut(text: str) -> tuple[str, list[str]]:
    """A text cut at every single space between two other characters: what stands before the first, and behind each.

    Such a space always starts a pre-token, and no pre-token looks further back.
    """
    edges = _ASCII_EDGES if text.isascii() else _EDGES
    if text[0] != " " and text[-1] != " " and not any(e in text for e in edges):
        first, *rest = text.split(" ")
        return first, rest
    ends = [m.start() for m in _CUT.finditer(text)]
    return text[: ends[0]] if ends else text, [text[a + 1 : b] for a, b in zip(ends, [*ends[1:], len(text)])]


#: What a worker holds for the tokenizer it last worked for.
_held: dict[str, object] = {}


def _of_worker(key: str, make):
    """``make()``, kept until another key is asked for; what was kept is let go before something new is made."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


@contextlib.contextmanager
def _no_cycles() -> Iterator[None]:
    """The collector of reference cycles rests: encoding makes none, but would have the caches looked through."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Tokenizer:
    """Encoding and decoding of columns with one vocabulary.

    Workers remember pieces in caches of ``cache_bytes`` a generation, and keep them between
    tasks unless ``keep`` is false: where other work shares the executors, memory goes first.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, *, cache_bytes: int = CACHE_BYTES, keep: bool = True):
        self.cache_bytes, self.keep = cache_bytes, keep
        ranks = read_ranks(path)
        self.shared = spark.sparkContext.broadcast(Vocabulary(ranks, pattern))
        by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for entry, rank in ranks.items():
            by_id[rank] = entry
        self.by_id = spark.sparkContext.broadcast(by_id)
        self.token = uuid.uuid4().hex

    def encode(self, df: DataFrame, text_col: str = "text", result: str = "ids") -> tuple[DataFrame, str]:
        """The frame with one more column, array<int>, and that column's name."""
        shared, token, cache_bytes, keep = self.shared, self.token, self.cache_bytes, self.keep

        @F.arrow_udf("array<int>")
        def ids(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _of_worker(f"encode {token}", lambda: Encoder(shared.value, cache_bytes))
            for batch in it:
                for at in range(0, len(batch), BATCH_ROWS):
                    texts = batch.slice(at, BATCH_ROWS)
                    with _no_cycles():
                        packed = [encoder.packed(t) for t in texts.to_pylist()]
                    ends = np.cumsum([0, *map(len, packed)]) // 4
                    flat = np.frombuffer(b"".join(packed), "<i4")
                    yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            if not keep:
                _held.clear()
                encoder = None
                give_back()

        name = free_name(df, result)
        return df.withColumn(name, ids(F.col(text_col))), name

    def decode(self, df: DataFrame, ids_col: str = "ids", result: str = "decoded") -> tuple[DataFrame, str]:
        """The frame with one more column, binary, and that column's name; null ids decode to no bytes."""
        entries = self.by_id

        @F.arrow_udf("binary")
        def decoded(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            take = entries.value.__getitem__
            for lists in it:
                ids, at = lists.values.to_numpy(), lists.offsets.to_pylist()
                known = lists.is_valid().to_pylist()
                out = [b"".join(map(take, ids[a:b].tolist())) if k else b"" for a, b, k in zip(at, at[1:], known)]
                yield pa.array(out, pa.binary())

        name = free_name(df, result)
        return df.withColumn(name, decoded(F.col(ids_col))), name
