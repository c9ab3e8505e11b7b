"""Edit-distance measures.

Levenshtein is native.  ``ratio`` (normalised indel similarity) and
``partial_ratio`` (best ``ratio`` of the shorter value against any window of
its length in the longer one, windows clipped at both ends included) need one
Arrow UDF.  It combs the semi-local LCS braid of a whole batch of pairs at once
(Tiskin's string-substring combing): one O(len(a) * len(b)) pass yields the LCS
of the shorter value with *every* window of the longer, so the window search
costs nothing extra and long texts need no cut.

A caller that only wants scores above a bar says what a pair still needs.  Its LCS
then comes first, bit-parallel (one bit per character of the shorter value, 64 to a
block): it gives ``ratio``, and as no window shares more than the whole, ``partial``
is at most 2 LCS / (length of the shorter + LCS).  Pairs that miss the bar even so
are not combed.
"""

from __future__ import annotations

import difflib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Executors need no copy of this package: the UDFs travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FUZZY_TYPE = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("partial", T.DoubleType())])
# Array cells one numpy step may touch; bounds a task's memory, not the input.
BLOCK_LANES = 1 << 16


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty values are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)


def _comb(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Start position, in each long string, of the strand leaving at every column.

    ``short`` is (pairs, m) and ``long`` (pairs, n).  Two strands meeting in a
    cell turn back on a character match or when they have crossed before.
    Negative starts entered from the side.
    """
    pairs, m = short.shape
    n = long.shape[1]
    kind = np.int16 if m + n < 32000 else np.int32
    flipped = np.ascontiguousarray(short[:, ::-1])
    side = np.tile(np.arange(m, dtype=kind), (pairs, 1))
    top = np.tile(np.arange(m, m + n, dtype=kind), (pairs, 1))
    for d in range(m + n - 1):
        first = max(0, m - 1 - d)
        last = min(m, m + n - 1 - d)
        shift = d - m + 1
        rows = slice(first, last)
        cols = slice(first + shift, last + shift)
        h, v = side[:, rows], top[:, cols]
        turn = (flipped[:, rows] == long[:, cols]) | (h > v)
        step = (v - h) * turn
        h += step
        v -= step
    return top.astype(np.int32) - m


#: Blocks of 64 characters up to which pairs are worked on side by side; longer ones go one by one.
SIDE_BLOCKS = 4


def _lcs_side_by_side(shorts: list[np.ndarray], longs: list[np.ndarray]) -> np.ndarray:
    """LCS lengths of pairs with at most ``SIDE_BLOCKS`` blocks, one step per character of the longest value."""
    pairs = len(shorts)
    m = np.array([len(x) for x in shorts])
    blocks = -(-int(m.max()) // 64)
    symbols, codes = np.unique(np.concatenate([_pad(shorts, -1), _pad(longs, -2)], axis=1), return_inverse=True)
    codes = codes.reshape(pairs, -1)
    width = int(m.max())
    row = np.arange(pairs)
    spots = np.zeros((pairs, len(symbols), blocks), np.uint64)
    for i in range(width):
        spots[row, codes[:, i], i >> 6] |= np.uint64(1) << np.uint64(i & 63)
    filler = np.flatnonzero(symbols == -1)
    spots[:, filler] = 0
    state = np.full((pairs, blocks), ~np.uint64(0))
    for j in range(width, codes.shape[1]):
        hit = spots[row, codes[:, j]]
        both = state & hit
        total = state + both
        carry = total < both
        for b in range(1, blocks):
            total[:, b] += carry[:, b - 1]
            carry[:, b] |= carry[:, b - 1] & (total[:, b] == 0)
        state = total | (state & ~hit)
    place = np.arange(blocks * 64)
    bits = np.unpackbits(np.ascontiguousarray(state).view(np.uint8), axis=1, bitorder="little")
    return ((bits == 0) & (place < m[:, None])).sum(1)


def _lcs_alone(short: np.ndarray, long: np.ndarray) -> int:
    """LCS length of one pair; the blocks are the digits of one long integer."""
    spots: dict[int, int] = {}
    for c in np.unique(short).tolist():
        spots[c] = int.from_bytes(np.packbits(short == c, bitorder="little").tobytes(), "little")
    full = state = (1 << len(short)) - 1
    for hit in map(spots.get, long.tolist()):
        if hit is not None:
            both = state & hit
            state = ((state + both) | (state - both)) & full
    return len(short) - state.bit_count()


def lcs_lengths(shorts: list[np.ndarray], longs: list[np.ndarray]) -> np.ndarray:
    """LCS length of each pair of code arrays, the first no longer than the second."""
    out = np.zeros(len(shorts), np.int64)
    side = []
    for k, (x, y) in enumerate(zip(shorts, longs)):
        if len(x) <= 64 * SIDE_BLOCKS:
            side.append(k)
        else:
            out[k] = _lcs_alone(x, y)
    for block in _blocks([(len(shorts[k]), len(longs[k])) for k in side]):
        at = [side[i] for i in block]
        out[at] = _lcs_side_by_side([shorts[k] for k in at], [longs[k] for k in at])
    return out


def _window_scores(
    starts: np.ndarray, m: np.ndarray, n: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Whole-string ratio and best window ratio from combed strands, per pair."""
    pairs, width = starts.shape
    column = np.arange(width)[None, :]
    m2, n2 = m[:, None], n[:, None]
    strand = (column < n2) & (starts >= 0)
    row = np.broadcast_to(np.arange(pairs)[:, None], starts.shape)

    def tally(at: np.ndarray, where: np.ndarray) -> np.ndarray:
        flat = row[where] * (width + 1) + at[where]
        return np.bincount(flat, minlength=pairs * (width + 1)).reshape(pairs, width + 1)

    ended = np.cumsum(strand, axis=1)  # strands leaving up to and including a column
    total = ended[:, -1]
    ratio = 2.0 * (n - total) / (m + n)

    # Full windows [i, i + m): strands that start at or after i and leave before i + m.
    opens = np.maximum(column - m2 + 1, 0) + np.zeros_like(starts)
    inside = strand & (starts >= opens)
    lost = np.cumsum(tally(opens, inside) - tally(starts + 1, inside), axis=1)[:, :width]
    full = np.where(column <= n2 - m2, (m2 - lost) / m2, 0.0)

    # Clipped windows: prefixes [0, j) and suffixes [i, n) shorter than m.
    length = column + 1
    prefix = np.where(length < np.minimum(m2, n2 + 1), 2.0 * (length - ended) / (m2 + length), 0.0)
    begun = np.cumsum(tally(starts, strand), axis=1)[:, :width]
    later = total[:, None] - begun + tally(starts, strand)[:, :width]
    rest = n2 - column
    suffix = np.where(
        (rest > 0) & (rest < m2), 2.0 * (rest - later) / np.maximum(m2 + rest, 1), 0.0
    )
    return ratio, np.maximum(np.maximum(full, prefix), suffix).max(axis=1)


def _pad(codes: list[np.ndarray], filler: int) -> np.ndarray:
    out = np.full((len(codes), max(len(c) for c in codes)), filler, dtype=np.int32)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def _blocks(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Indices of similarly sized pairs, grouped so that padding and memory stay small."""
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k][1], sizes[k][0]))
    block: list[int] = []
    widest = 0
    for k in order:
        m, n = sizes[k]
        wide = max(widest, m + n)
        small = sizes[block[0]] if block else (m, n)
        if block and (wide * (len(block) + 1) > BLOCK_LANES or n > 1.25 * small[1] + 8):
            yield block
            block, wide = [], m + n
        block.append(k)
        widest = wide
    if block:
        yield block


def indel_scores(
    a: list[str],
    b: list[str],
    bar: np.ndarray | None = None,
    weights: tuple[float, float] = (0.0, 0.0),
) -> tuple[np.ndarray, np.ndarray]:
    """``ratio`` and ``partial_ratio`` of aligned lists of strings.

    With a ``bar``, pairs for which ``weights`` times (ratio, partial) stay below it
    whatever the partial ratio get 0 in its place.  A bar that is not a number asks for all.
    """
    ratio = np.zeros(len(a))
    partial = np.zeros(len(a))
    left: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, (x, y) in enumerate(zip(a, b)):
        if x == y:
            ratio[k] = partial[k] = 1.0
        elif x and y:
            short, long = sorted((_codes(x), _codes(y)), key=len)
            left.append((k, short, long))
    if bar is not None and left:
        common = lcs_lengths([s for _, s, _ in left], [t for _, _, t in left])
        m, n = (np.array([len(job[i]) for job in left]) for i in (1, 2))
        at = np.array([k for k, _, _ in left])
        ratio[at] = 2.0 * common / (m + n)
        most = weights[0] * ratio[at] + weights[1] * 2.0 * common / (m + common)
        left = [job for job, stop in zip(left, most < bar[at]) if not stop]
    jobs = []
    for k, short, long in left:
        jobs.append((k, short, long))
        if len(short) == len(long):  # equal lengths: windows of either one count
            jobs.append((k, long, short))
    for block in _blocks([(len(s), len(t)) for _, s, t in jobs]):
        where = np.array([jobs[i][0] for i in block])
        shorts = [jobs[i][1] for i in block]
        longs = [jobs[i][2] for i in block]
        m = np.array([len(s) for s in shorts])
        n = np.array([len(t) for t in longs])
        whole, best = _window_scores(_comb(_pad(shorts, -1), _pad(longs, -2)), m, n)
        ratio[where] = whole
        np.maximum.at(partial, where, best)
    return ratio, partial


def _scored(a: pd.Series, b: pd.Series, *more) -> pd.DataFrame:
    keep = (a.notna() & b.notna()).to_numpy()
    out = np.full((len(a), 2), np.nan)
    bars = [more[0][keep].to_numpy(), more[1]] if more else []
    out[keep, 0], out[keep, 1] = indel_scores(a[keep].tolist(), b[keep].tolist(), *bars)
    return pd.DataFrame(out, columns=["ratio", "partial"])


@F.pandas_udf(FUZZY_TYPE)
def _indel_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _scored(a, b)


def _indel_above(weights: tuple[float, float]):
    @F.pandas_udf(FUZZY_TYPE)
    def udf(a: pd.Series, b: pd.Series, bar: pd.Series) -> pd.DataFrame:
        return _scored(a, b, bar, weights)

    return udf


@F.pandas_udf(T.DoubleType())
def _difflib_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if x is None or y is None else difflib.SequenceMatcher(a=x, b=y).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def indel_struct(
    a: Column, b: Column, bar: Column | None = None, weights: tuple[float, float] = (0.0, 0.0)
) -> Column:
    """Struct of ``ratio`` and ``partial``; null when either input is null.

    ``partial`` is 0 where the weighted sum of both cannot reach the ``bar``.
    """
    return _indel_udf(a, b) if bar is None else _indel_above(weights)(a, b, bar)


def difflib_ratio(a: Column, b: Column) -> Column:
    return _difflib_udf(a, b)


def fuzzy_struct(
    a: Column,
    b: Column,
    backend: str = "indel",
    bar: Column | None = None,
    weights: tuple[float, float] = (0.0, 0.0),
) -> Column:
    """``ratio`` and ``partial`` for rows where both inputs are non-null."""
    if backend == "difflib":
        score = difflib_ratio(a, b)
        return F.struct(score.alias("ratio"), score.alias("partial"))
    if backend == "indel":
        return indel_struct(a, b, bar, weights)
    raise ValueError(f"unknown fuzzy backend: {backend}")


def lcs_like(a_norm: Column, b_norm: Column, backend: str = "indel") -> Column:
    """``partial_ratio`` (or the difflib ratio); 0 when either value is empty."""
    both = (a_norm != "") & (b_norm != "")
    score = fuzzy_struct(F.when(both, a_norm), F.when(both, b_norm), backend)["partial"]
    return F.when(both, score).otherwise(F.lit(0.0))
