"""Secret scans: base patterns, and sliding-window Shannon entropy of candidate strings.

Everything is a column expression: no Python runs on the executors, and documents
are not shuffled.  Base spans come from three fixed patterns.  Candidates of a
character class (``CLASSES``) are maximal runs of its characters of at least its
window's length that hold a digit and, where the class asks for it, both cases.
A window of fixed length slides over a candidate; counts per character are kept,
the entering and the leaving one change by one, and the sum of c * log2(c), from
which the entropy follows, changes by the two differences.  A candidate whose
greatest window entropy reaches the class's bound is a span of kind ``entropy``.
The ``//`` of a URL's head is no part of a candidate, and strings of the allow-list
do not count: one of the pieces left between them has to be a secret by itself.
A piece with a slash whose parts all read like words or numbers is a path or link, no secret.
Entropy spans that overlap a base span are kept or left out, as the caller chooses;
those inside a base span say nothing new and are always left out.

Offsets are code points, ends exclusive.  They come from the lengths of matches
and of the pieces between them, and only texts with a match pay for them.

Edge cases: null and empty texts have no spans; texts are searched whole; every
row is handled by itself, so ids, repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class and the entropy they must reach in a window."""

    characters: str
    window: int
    bits: float
    mixed_case: bool

    @property
    def pattern(self) -> str:
        own = "[" + self.characters.replace("-", r"\-") + "]"
        run = rf"{own}{{{self.window},}}+"
        if "/" not in self.characters:
            return rf"(?<!{own}){run}"
        return rf"(?:(?<!{own})(?!(?<=:)//)|(?<=://)){run}"


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Upper-case hexadecimal (lower case is a base kind), base64 of either alphabet, and
#: keys of one case with digits (base36, base32).
CLASSES = (
    CharClass(_DIGITS + "ABCDEF", 24, 2.8, False),
    CharClass(_DIGITS + _LOWER + _LOWER.upper() + "+/_-", 20, 3.6, True),
    CharClass(_DIGITS + _LOWER, 24, 3.5, False),
    CharClass(_DIGITS + _LOWER.upper(), 24, 3.5, False),
)
#: Words, capitals and numbers that a part of a path is made of.
_WORDS = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: Parts of fewer characters tell nothing; longer ones may hold one word, capital run or number more than one in four characters.
PATH_PART = 5
PATH_CHARS = 4
#: Parts of examples; what else a candidate holds decides.
ALLOWED = ("EXAMPLE", "example", "0123456789", "abcdefghij", "ABCDEFGHIJ", "placeholder")

SPANS = "array<struct<start: int, kind: int, stop: int>>"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (start, kind, stop) of the matches for which ``keep(match, index)`` holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, i: Column) -> Column:
        found = F.get(matches, i)
        at = state["at"] + F.length(F.get(between, i))
        stop = at + F.length(found)
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        out = F.when(keep(found, i), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    indices = F.sequence(F.lit(0), F.size(matches) - 1)
    return F.aggregate(indices, start, step, lambda s: s["out"])


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression is computed wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_entropy(candidate: Column, characters: str, window: int) -> Column:
    """Greatest Shannon entropy, in bits, of any ``window`` consecutive characters."""
    chars = F.split(candidate, "")
    index = F.transform(chars, lambda c: F.instr(F.lit(characters), c) - 1)
    weight = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 1)])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(characters)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
    )

    def changed(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, i: F.when(i == at, c + by).otherwise(c))

    def step(index: Column, state: Column, i: Column) -> Column:
        entering, leaving = F.get(index, i), F.get(index, i - window)
        had = F.get(state["counts"], entering)
        grown = changed(state["counts"], entering, 1)
        total = state["sum"] + F.get(weight, had + 1) - F.get(weight, had)
        full = i >= window
        left = F.get(grown, leaving)
        total = F.when(full, total + F.get(weight, left - 1) - F.get(weight, left)).otherwise(total)
        counts = F.when(full, changed(grown, leaving, -1)).otherwise(grown)
        bits = F.lit(math.log2(window)) - total / window
        best = F.when(i >= window - 1, F.greatest(state["best"], bits)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

    places = F.sequence(F.lit(0), F.length(candidate) - 1)
    return _bound(index, lambda x: F.aggregate(places, zero, lambda s, i: step(x, s, i), lambda s: s["best"]))


def _is_path(run: Column) -> Column:
    """Whether a run has a slash and every part between its marks reads like words and numbers."""

    def worded(part: Column) -> Column:
        words = F.length(F.regexp_replace(part, _WORDS, "x"))
        return (F.length(part) < PATH_PART) | ((words - 1) * PATH_CHARS <= F.length(part))

    return run.contains("/") & F.forall(F.split(run, "[/_+-]+"), worded)


def _entropy_spans(text: Column, kind: CharClass) -> Column:
    def looks(rest: Column) -> Column:
        fits = (F.length(rest) >= kind.window) & rest.rlike("[0-9]") & rest.rlike("[A-Za-z]")
        if kind.mixed_case:
            fits = fits & rest.rlike("[a-z]") & rest.rlike("[A-Z]")
        if "/" in kind.characters:
            fits = fits & ~_is_path(rest)
        return F.when(fits, window_entropy(rest, kind.characters, kind.window) >= kind.bits).otherwise(False)

    def secret(found: Column, _: Column) -> Column:
        return F.exists(F.split(found, "|".join(ALLOWED)), looks)

    return _spans(text, kind.pattern, KINDS.index("entropy"), secret)


def find_secrets(
    df: DataFrame, text_col: str = "text", result: str = "spans", *, overlapping: bool = False
) -> tuple[DataFrame, str]:
    """The frame with one more column of type ``SPANS``, sorted, and that column's name; ``kind`` indexes ``KINDS``.

    With ``overlapping``, entropy spans that reach beyond a base span are kept, as redaction needs them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPANS)
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    always = lambda found, i: F.lit(True)
    long_enough = lambda found, i: F.length(F.get(value, i)) >= ASSIGN_LEAST

    def searched(pattern: str, spans: Column) -> Column:
        return F.when(text.rlike(pattern), spans).otherwise(none)

    base = F.concat(
        searched(ASSIGN, _spans(text, ASSIGN, 0, long_enough)),
        F.when(text.contains("AKIA"), searched(ACCESS, _spans(text, ACCESS, 1, always))).otherwise(none),
        searched(HEX, _spans(text, HEX, 2, always)),
    )
    found = F.concat(*[searched(c.pattern, _entropy_spans(text, c)) for c in CLASSES])
    name = free_name(df, result)
    out = df.withColumn(name, F.struct(base.alias("base"), found.alias("found")))
    if overlapping:
        covers = lambda b, e: (b["start"] <= e["start"]) & (e["stop"] <= b["stop"])
    else:
        covers = lambda b, e: (b["start"] < e["stop"]) & (e["start"] < b["stop"])
    apart = F.filter(F.col(name)["found"], lambda e: ~F.exists(F.col(name)["base"], lambda b: covers(b, e)))
    return out.withColumn(name, F.array_sort(F.array_distinct(F.concat(F.col(name)["base"], apart)))), name


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mark; null stays null."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substr(text, state["at"] + 1))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of the given kinds as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    chosen = F.filter(spans, lambda s: s["kind"].isin(*[KINDS.index(k) for k in kinds]))
    return F.array_join(F.transform(chosen, text), ",")
