"""Cells that hold several values: container detection and the four split modes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import (
    DELIMITERS,
    contains_norm,
    escape_regex,
    normalize,
    normalize_stripped,
    strip_space,
    strip_wrappers,
    stripped,
)

# Fixed values.
BRACKETS = [("{", "}"), ("[", "]"), ("(", ")")]
SPLIT_MODES = ("dedup", "dedup_strict", "delim", "wrapped")


def _delimiter_parts(norm: Column) -> Column:
    # A normalised cell holds no whitespace but single blanks and is lower case,
    # so normalising a part again is just stripping its ends.
    parts = F.transform(F.split(norm, f"[{DELIMITERS}]+"), lambda p: strip_wrappers(p))
    return F.filter(parts, lambda p: p != "")


def split_norm(norm: Column, mode: str) -> Column:
    """Items of a normalised cell under one of the three delimiter modes.

    ``dedup`` falls back to the whole value when only delimiters are left,
    ``dedup_strict`` does not, ``delim`` keeps repeats and does not fall back.
    """
    parts = _delimiter_parts(norm)
    if mode == "delim":
        return parts
    unique = F.array_distinct(parts)
    if mode == "dedup_strict":
        return unique
    if mode == "dedup":
        return F.when((F.size(unique) == 0) & (norm != ""), F.array(norm)).otherwise(unique)
    raise ValueError(f"unknown delimiter split mode: {mode}")


# The ``*_of`` forms take a cell already stripped (``text.stripped``): lambdas share no
# subexpressions, so the engine strips once per cell and passes the result on.


def is_wrapped_of(text: Column) -> Column:
    cond = F.lit(False)
    for opening, closing in BRACKETS:
        cond = cond | (F.startswith(text, F.lit(opening)) & F.endswith(text, F.lit(closing)))
    return cond


def container_type_of(text: Column) -> Column:
    return (
        F.when(text == "", F.lit("empty"))
        .when(is_wrapped_of(text), F.lit("wrapped_list"))
        .when(text.rlike(f"[{DELIMITERS}]"), F.lit("delimited_list"))
        .otherwise(F.lit("single"))
    )


def wrapped_elements_of(text: Column, wrapped: Column) -> Column:
    inner = strip_space(text.substr(F.lit(2), F.length(text) - 2))
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: strip_space(p)), lambda p: p != "")
    return F.when(wrapped, F.transform(parts, lambda p: normalize(p))).otherwise(
        F.array().cast("array<string>")
    )


def is_wrapped(raw: Column) -> Column:
    """First and last character of the trimmed cell are a bracket pair."""
    return is_wrapped_of(stripped(raw))


def wrapped_elements(raw: Column) -> Column:
    """Comma items of a bracketed cell, each normalised; empty for other cells.

    Parts that are blank as written are dropped before normalising, so a quoted
    empty item stays as ``""``.
    """
    text = stripped(raw)
    return wrapped_elements_of(text, is_wrapped_of(text))


def split_wrapped(raw: Column) -> Column:
    """Split mode ``wrapped``: bracketed cells by comma, any other cell as one element."""
    text = stripped(raw)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(is_wrapped_of(text), wrapped_elements(raw))
        .otherwise(F.array(normalize_stripped(text)))
    )


def container_type(raw: Column) -> Column:
    """``empty``, ``wrapped_list``, ``delimited_list`` or ``single``."""
    return container_type_of(stripped(raw))


def listlike_member(a_norm: Column, b_norm: Column) -> Column:
    """``a`` stands in ``b`` between delimiters or the ends of the cell.

    The whole value is matched, so a multi-item ``a`` can match inside a longer list.
    """
    pattern = F.concat(
        F.lit(f"(?:^|[{DELIMITERS}]) *"), escape_regex(a_norm), F.lit(f" *(?=[{DELIMITERS}]|$)")
    )
    return F.when(contains_norm(a_norm, b_norm), F.regexp_like(b_norm, pattern)).otherwise(
        F.lit(False)
    )
