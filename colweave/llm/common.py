"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Bytes that part words, and ASCII upper case to lower case.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, case kept; none for null."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.encode().translate(_LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any non-ASCII character, with A-Z lower-cased."""
    return text.encode().translate(_ALNUM).split() if text else []


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out of every training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def give_back() -> None:
    """Return the memory that a task let go to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches whose worker, reused by later tasks, keeps no memory that this one has freed."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of the frame has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
