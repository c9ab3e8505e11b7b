"""Text functions as Column expressions.

``norm`` arguments are values already passed through :func:`normalize`; the
engine normalises once per cell and carries the result instead of repeating it
in every measure.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
WRAPPER_CHARS = "{}[]()\"' "
DELIMITERS = ",|;/"

# Python's notion of whitespace: Unicode White_Space plus the four separators.
SPACE = r"[\s\x1c-\x1f]"
# Python's notion of a word character.
WORD = r"[\p{L}\p{N}_]"


def strip_space(c: Column) -> Column:
    """Trim any Unicode whitespace (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def strip_wrappers(c: Column) -> Column:
    return F.btrim(c, F.lit(WRAPPER_CHARS))


def stripped(raw: Column) -> Column:
    """The cell as text without outer whitespace; null becomes ``""``."""
    return strip_space(F.coalesce(raw.cast("string"), F.lit("")))


def normalize_stripped(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip_wrappers(text), rf"(?U){SPACE}+", " "))


def normalize(c: Column) -> Column:
    """Null becomes ``""``; trim, strip wrappers and quotes, collapse blanks, lower-case."""
    return normalize_stripped(stripped(c))


def word_tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit("([a-z0-9]+)"), F.lit(1))


def tokenize(raw: Column) -> Column:
    """Alphanumeric runs of the text as written, lower-cased."""
    runs = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.transform(runs, lambda t: F.lower(t))


def grams(norm: Column, n: int) -> Column:
    """All length-``n`` windows, none when the value is shorter.

    One regex pass with a look-ahead capture: linear in the text and correct
    outside the BMP, where per-position ``substring`` is quadratic.
    """
    return F.regexp_extract_all(norm, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def char_ngrams(norm: Column, n: int = 3) -> Column:
    """Like :func:`grams`, but a shorter non-empty value is its own gram."""
    return (
        F.when(norm == "", F.array().cast("array<string>"))
        .when(F.length(norm) < n, F.array(norm))
        .otherwise(grams(norm, n))
    )


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def exact_match(a_norm: Column, b_norm: Column) -> Column:
    return flag((a_norm == b_norm) & (a_norm != ""))


def contains_norm(a_norm: Column, b_norm: Column) -> Column:
    """Is non-empty ``a`` inside ``b``."""
    return (a_norm != "") & F.contains(b_norm, a_norm)


def substring_match(a_norm: Column, b_norm: Column) -> Column:
    return flag(contains_norm(a_norm, b_norm))


def item_match(a_norm: Column, b_items: Column) -> Column:
    return flag((a_norm != "") & F.array_contains(b_items, a_norm))


def share_found(a_items: Column, b_items: Column) -> Column:
    """Share of the distinct items of ``a`` found in ``b``; 0 when ``a`` has none."""
    distinct = F.size(F.array_distinct(a_items))
    return F.when(distinct > 0, F.size(F.array_intersect(a_items, b_items)) / distinct).otherwise(
        F.lit(0.0)
    )


def word_count(norm: Column) -> Column:
    core = F.btrim(norm)
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, " ")))


def is_long_text(norm: Column, chars: int, words: int) -> Column:
    return (norm != "") & ((F.length(norm) >= chars) | (word_count(norm) >= words))


def is_short_text(norm: Column, chars: int, words: int) -> Column:
    return (norm == "") | (F.length(norm) <= chars) | (word_count(norm) <= words)


def escape_regex(c: Column) -> Column:
    """Backslash every ASCII punctuation character, so the value matches literally."""
    return F.regexp_replace(c, r"(\p{Punct})", r"\\$1")


def boundary_substring(a_norm: Column, b_norm: Column) -> Column:
    """``a`` occurs in ``b`` with a word boundary on both ends.

    The plain containment test runs first, so the per-row pattern is compiled
    only for the few pairs that pass it.
    """
    before = F.when(a_norm.rlike(rf"\A{WORD}"), F.lit(rf"(?<!{WORD})")).otherwise(
        F.lit(rf"(?<={WORD})")
    )
    after = F.when(a_norm.rlike(rf"{WORD}\z"), F.lit(rf"(?!{WORD})")).otherwise(
        F.lit(rf"(?={WORD})")
    )
    pattern = F.concat(before, escape_regex(a_norm), after)
    return F.when(contains_norm(a_norm, b_norm), F.regexp_like(b_norm, pattern)).otherwise(
        F.lit(False)
    )


def overlap_precision(a_norm: Column, b_norm: Column) -> Column:
    """Matched length over the length of ``b``; 0 without containment."""
    return F.when(contains_norm(a_norm, b_norm), F.length(a_norm) / F.length(b_norm)).otherwise(
        F.lit(0.0)
    )


def overlap_recall(a_norm: Column, b_norm: Column) -> Column:
    return substring_match(a_norm, b_norm)


def clamp(score: Column, cap: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(float(cap)))
