"""Document frequencies of character n-grams, counted slice by slice inside a task.

Spark deals out the documents and adds up the counts.  Within a slice of documents every
window of n characters is a number, so distinct windows of a document and their counts
over documents are two sorts of integers.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need no copy of this package: the function travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a slice; bounds a task's memory, not the input.
SLICE_CHARS = 1 << 20
#: Bits of a number that holds a document's place in its slice and a window.
KEY_BITS = 62


def _slice_grams(texts: list[str], times: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    """Distinct windows of ``n`` characters and the summed ``times`` of the documents that hold them."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    windows = len(codes) - n + 1
    if windows < 1:
        return [], np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    symbols = (np.cumsum(used) - 1)[codes]
    alphabet = np.flatnonzero(used).astype(np.uint32)
    wide, places = (len(alphabet) - 1).bit_length(), len(texts).bit_length()
    key, bits, packed = np.zeros(windows, np.int64), 0, True
    for i in range(n):
        if bits + wide + places > KEY_BITS:
            # Number the windows so far anew, so that the next character fits.
            key, bits, packed = np.unique(key, return_inverse=True)[1].astype(np.int64), windows.bit_length(), False
        key = (key << wide) | symbols[i : i + windows]
        bits += wide
    # All characters of a window lie in one document.
    whole_windows = doc[:windows] == doc[n - 1 :]
    start = np.flatnonzero(whole_windows)
    if not len(start):
        return [], np.zeros(0, np.int64)
    held = ((key << places) | doc[:windows])[whole_windows]
    if packed:
        held = np.sort(held)
    else:
        order = np.argsort(held, kind="stable")
        held = held[order]
    first = np.ones(len(held), bool)
    first[1:] = held[1:] != held[:-1]
    key, owner = held[first] >> places, held[first] & ((1 << places) - 1)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(times[owner], new)
    if not packed:
        return [whole[p : p + n] for p in start[order][first][new].tolist()], sums
    letters = [(key[new] >> (wide * (n - 1 - i))) & ((1 << wide) - 1) for i in range(n)]
    text = alphabet[np.stack(letters, axis=1)].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[p : p + n] for p in range(0, len(text), n)], sums


def _long_grams(text: str, n: int) -> list[str]:
    """Distinct windows of one document of more than a slice, slice by slice."""
    seen: set[str] = set()
    for at in range(0, len(text), SLICE_CHARS):
        piece = text[at : at + SLICE_CHARS + n - 1]
        seen.update(_slice_grams([piece], np.ones(1, np.int64), n)[0])
    return list(seen)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    texts: list[str] = []
    times: list[int] = []
    held = 0
    for batch in batches:
        for text, n in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            if texts and held + len(text) > SLICE_CHARS:
                yield texts, np.array(times, np.int64)
                texts, times, held = [], [], 0
            texts.append(text)
            times.append(n.as_py())
            held += len(text)
    if texts:
        yield texts, np.array(times, np.int64)


def count_grams(sizes: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``(doc, times)`` to ``(gram, df)``, one row per gram and slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, times in _slices(batches):
            for n in sizes:
                if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
                    found = _long_grams(texts[0], n)
                    sums = np.full(len(found), times[0], np.int64)
                else:
                    found, sums = _slice_grams(texts, times, n)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(sums, pa.int64())], ["gram", "df"])

    return run
