"""Row scorers on distinct value pairs.

``resolve`` settles on the joined row whatever needs no fuzzy measure (nulls,
blanks, equal elements, fast paths, pairs that provably miss the threshold), so
only open pairs carry their text into a shuffle.  ``score_open`` scores each
distinct element pair of the open rows once and takes the best per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import containers as C, fuzzy, text as X
from ..plans.profiles import Profile
from ..plans.workspace import Workspace, task_count
from . import tfidf

METRICS = (
    "exact",
    "substring",
    "list_item",
    "token_containment",
    "char3_containment",
    "rf_partial",
    "rf_ratio",
    "levenshtein",
    "tfidf",
    "final",
)
#: Rounding slack of the pruning bound.
SLACK = 1e-9


# ---- element scores -------------------------------------------------------------------------


def containment_score(profile: Profile, d: Column, s: Column) -> dict[str, Column]:
    """``d`` and ``s`` carry raw, norm, tokens and grams; ``s`` also its items."""
    w = profile.weights
    # Only the dashboard value as written must be non-empty for an exact match here.
    exact = X.flag((d["norm"] == s["norm"]) & (d["raw"] != ""))
    substring = X.substring_match(d["norm"], s["norm"])
    item = X.item_match(d["norm"], s["items"])
    token = X.share_found(d["tokens"], s["tokens"])
    char = X.share_found(d["grams"], s["grams"])
    score = (
        w["exact"] * exact
        + w["substring"] * substring
        + w["list_item"] * item
        + w["token"] * token
        + w["char"] * char
    )
    return {
        "score": X.clamp(score),
        "substring_hit": substring,
        "token_containment": token,
        "list_item_hit": item,
    }


def native_features(profile: Profile, a: Column, b: Column) -> dict[str, Column]:
    """What a scorer derives from the two values without fuzzy measures."""
    if profile.scorer in ("unified", "rowwise"):
        out = {
            "exact": X.exact_match(a, b),
            "substring": X.substring_match(a, b),
            "list_item": X.item_match(a, C.split_norm(b, profile.split)),
        }
        if profile.scorer == "unified":
            out["token_containment"] = X.share_found(X.word_tokens(a), X.word_tokens(b))
            out["char3_containment"] = X.share_found(X.char_ngrams(a), X.char_ngrams(b))
        return out
    if profile.scorer == "hybrid":
        return {}
    return {"boundary": X.boundary_substring(a, b)}


def unified_metrics(
    profile: Profile, native: dict[str, Column], ratio: Column, partial: Column, lev: Column, cosine: Column
) -> dict[str, Column]:
    w = profile.weights
    out = {
        **native,
        "rf_partial": partial,
        "rf_ratio": ratio,
        "levenshtein": lev,
        "tfidf": cosine,
    }
    out["final"] = X.clamp(reduce(lambda x, y: x + y, [out[k] * w[k] for k in w]))
    return out


def rowwise_score(
    profile: Profile, native: dict[str, Column], ratio: Column, partial: Column, cosine: Column
) -> Column:
    w = profile.weights
    score = (
        w["exact"] * native["exact"]
        + w["substring"] * native["substring"]
        + w["list_item"] * native["list_item"]
        + w["rf_partial"] * partial
        + w["rf_ratio"] * ratio
        + w["tfidf"] * cosine
    )
    return X.clamp(score)


def blend(profile: Profile, ratio: Column, partial: Column, lev: Column, cosine: Column) -> Column:
    w = profile.weights
    return (
        w["partial"] * partial + w["ratio"] * ratio + w["levenshtein"] * lev + w["tfidf"] * cosine
    )


def hybrid_score(
    profile: Profile, a: Column, b: Column, ratio: Column, partial: Column, lev: Column, cosine: Column
) -> Column:
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(profile.equal_score))
        .when(F.contains(b, a), F.lit(profile.substring_score))
        .otherwise(F.least(blend(profile, ratio, partial, lev, cosine), F.lit(1.0)))
    )


def _gated(
    p: Profile, a: Column, b: Column, partial: Column, cosine: Column, boosts: list[float], loose: float
) -> Column:
    """Boost for a plain, a short-in-long and a long-in-long value, each long case with its penalty."""
    plain, short_yes, short_no, long_yes, long_no = boosts
    precision = X.overlap_precision(a, b)
    strict_ok = (
        (precision >= p.min_precision) | (cosine >= p.min_tfidf) | (partial >= p.min_partial)
    )
    loose_ok = (
        (precision >= p.min_precision / 2) | (cosine >= p.min_tfidf / 2) | (partial >= loose)
    )
    is_long = X.is_long_text(b, p.long_chars, p.long_words)
    is_short = X.is_short_text(a, p.short_chars, p.short_words)
    return (
        F.when(~is_long, F.lit(plain))
        .when(is_short & strict_ok, F.lit(short_yes))
        .when(is_short, F.lit(short_no))
        .when(loose_ok, F.lit(long_yes))
        .otherwise(F.lit(long_no))
    )


# Boosts for (not long, short ok, short not ok, long ok, long not ok).
EXACT_BOOSTS, EXACT_LOOSE = [0.40, 0.25, -0.20, 0.20, -0.10], 0.85
SUBSTRING_BOOSTS, SUBSTRING_LOOSE = [0.25, 0.15, -0.15, 0.10, -0.10], 0.80


def guarded_score(
    profile: Profile,
    a: Column,
    b: Column,
    boundary: Column,
    ratio: Column,
    partial: Column,
    lev: Column,
    cosine: Column,
) -> Column:
    base = blend(profile, ratio, partial, lev, cosine)
    exact = _gated(profile, a, b, partial, cosine, EXACT_BOOSTS, EXACT_LOOSE)
    inside = F.when(
        boundary,
        _gated(profile, a, b, partial, cosine, SUBSTRING_BOOSTS, SUBSTRING_LOOSE),
    ).otherwise(F.lit(0.0))
    if profile.equal_score is None:
        score = X.clamp(base + F.when(a == b, exact).otherwise(inside), profile.score_cap)
    else:
        score = F.when(a == b, F.lit(profile.equal_score)).otherwise(
            X.clamp(base + inside, profile.score_cap)
        )
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)


def element_scores(
    profile: Profile,
    a: Column,
    b: Column,
    ratio: Column,
    partial: Column,
    lev: Column,
    cosine: Column,
    native: dict[str, Column] | None = None,
) -> dict[str, Column]:
    """Scores of one element pair from its measures; ``native`` passes stored features."""
    native = native_features(profile, a, b) if native is None else native
    if profile.scorer == "unified":
        return unified_metrics(profile, native, ratio, partial, lev, cosine)
    if profile.scorer == "rowwise":
        return {"score": rowwise_score(profile, native, ratio, partial, cosine)}
    if profile.scorer == "hybrid":
        return {"score": hybrid_score(profile, a, b, ratio, partial, lev, cosine)}
    return {"score": guarded_score(profile, a, b, native["boundary"], ratio, partial, lev, cosine)}


# ---- per-cell features ----------------------------------------------------------------------


def _staged(cells: Column, *stages) -> Column:
    """Extend the cell structs stage by stage.

    Each stage maps a cell to its new fields and sees those of the stages before,
    so nothing is computed twice: lambda bodies share no subexpressions.
    """
    fields = ["ord", "raw"]

    def extend(stage, have):
        def body(c):
            new = stage(c)
            fields.extend(new)
            return F.struct(*[c[f].alias(f) for f in have], *[v.alias(k) for k, v in new.items()])

        return body

    for stage in stages:
        cells = F.transform(cells, extend(stage, tuple(fields)))
    return cells


def _norm(c):
    return {"norm": X.normalize(c["raw"])}


def _element_set(c):
    """Element set of a cell: the whole value when splitting leaves nothing, blanks dropped.

    A score is the best over element pairs, so order and repeats do not matter and
    a sorted set lets cells with the same elements collapse into one.
    """
    found = F.when(F.size(c["parts"]) == 0, F.array(c["norm"])).otherwise(c["parts"])
    # The scorers normalise an element once more; after the first pass that only strips its ends.
    clean = F.filter(F.transform(found, lambda p: X.strip_wrappers(p)), lambda p: p != "")
    return {"els": F.when(F.size(clean) > 1, F.array_sort(F.array_distinct(clean))).otherwise(clean)}


def cell_features(profile: Profile, cells: Column, side: str) -> Column:
    """Everything a scorer needs of one cell, computed once per cell rather than per pair."""
    if profile.scorer == "containment":

        def measures(c):
            out = {
                "tokens": X.word_tokens(c["norm"]),
                "grams": F.array_distinct(X.char_ngrams(c["norm"])),
            }
            if side == "source":
                out["items"] = C.split_norm(c["norm"], profile.split)
            return out

        return _staged(cells, _norm, measures)
    if profile.scorer in ("unified", "rowwise"):
        return _staged(cells, _norm, lambda c: {"els": F.array(c["norm"])})
    if profile.scorer in ("hybrid", "guarded"):
        return _staged(
            cells,
            _norm,
            lambda c: {"parts": C.split_norm(c["norm"], profile.split)},
            _element_set,
        )
    # Tagged: ``items`` of a bracketed cell serve the list test and are its elements.
    return _staged(
        cells,
        lambda c: {"text": X.stripped(c["raw"])},
        lambda c: {"norm": X.normalize_stripped(c["text"]), "kind": C.container_type_of(c["text"])},
        lambda c: {"items": C.wrapped_elements_of(c["text"], c["kind"] == "wrapped_list")},
        lambda c: {"parts": F.when(c["kind"] == "wrapped_list", c["items"]).otherwise(F.array(c["norm"]))},
        _element_set,
    )


def with_features(profile: Profile, aligned: DataFrame) -> DataFrame:
    return aligned.withColumns(
        {
            "d_cells": cell_features(profile, F.col("d_cells"), "dash"),
            "s_cells": cell_features(profile, F.col("s_cells"), "source"),
        }
    )


# ---- resolving on the row -------------------------------------------------------------------


#: Product of two values' lengths up to which their edit distance is taken on every row.
EDIT_CELLS = 4096


def _ceiling(profile: Profile, a: Column, b: Column, edits: bool = False) -> Column:
    """Upper bound of an unequal element pair's score, from lengths and containment, with ``edits`` also from the distance.

    Values that match c characters in order are at most la + lb - 2c edits apart, so c is at most
    half of what la + lb exceeds the distance by.  No window shares more than the whole.
    """
    w = profile.weights
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    low, high = F.least(la, lb), F.greatest(la, lb)
    cosine = X.flag(low >= min(tfidf.GRAM_SIZES))

    def blended(distance: Column) -> Column:
        common = F.greatest((la + lb - distance) / 2.0, F.lit(0.0))
        ratio = 2.0 * common / (la + lb)
        if profile.fuzzy_backend == "difflib":
            partial = lev = ratio
        else:
            partial, lev = 2.0 * common / (low + common), 1.0 - distance / high
        return blend(profile, ratio, partial, lev, cosine)

    bound = blended(high - low)
    if edits:
        # As a lambda's argument the distance is taken once.
        distance = F.when(la * lb <= EDIT_CELLS, F.levenshtein(a, b)).otherwise(high - low)
        bound = F.transform(F.array(distance), blended)[0]
    if profile.scorer == "hybrid":
        return F.when(F.contains(b, a), F.lit(profile.substring_score)).otherwise(bound)
    return bound + F.when(F.contains(b, a), F.lit(max(SUBSTRING_BOOSTS))).otherwise(F.lit(0.0))


def _may_reach(profile: Profile, d_els: Column, s_els: Column, penalty: Column, floor: float) -> Column:
    bar = F.lit(floor - SLACK)
    # Most cells are single values: their test compiles, the nested lambdas are interpreted.
    single = (F.size(d_els) == 1) & (F.size(s_els) == 1)
    a, b = d_els[0], s_els[0]
    reach = (_ceiling(profile, a, b) * penalty >= bar) & (_ceiling(profile, a, b, edits=True) * penalty >= bar)
    return F.when(single, reach).otherwise(
        F.exists(
            d_els, lambda a: F.exists(s_els, lambda b: _ceiling(profile, a, b) * penalty >= bar)
        )
    )


def resolve(profile: Profile, pairs: DataFrame, *keep: str, prune: bool = False) -> DataFrame:
    """Settle cell pairs natively where possible.

    Adds ``state`` (``null``, ``known`` or ``open``), the ``known`` score, the
    ``tag``, the ``penalty`` and, for open rows only, the two element sets.  With
    ``prune`` a pair whose ceiling is below its hit threshold becomes a known miss.
    """
    d, s = F.col("d"), F.col("s")
    filled = d["raw"].isNotNull() & s["raw"].isNotNull()
    penalty = F.lit(1.0)
    tag = F.lit("similarity")
    known = F.lit(None).cast("double")
    if profile.scorer in ("hybrid", "guarded", "tagged"):
        if profile.scorer == "tagged":
            kinds = [F.lit(x) for kv in profile.container_penalty.items() for x in kv]
            penalty = F.coalesce(F.create_map(*kinds)[s["kind"]], F.lit(1.0))
        known = F.when((F.size(d["els"]) == 0) | (F.size(s["els"]) == 0), F.lit(0.0))
        if profile.best_equal is not None:
            known = known.when(
                F.arrays_overlap(d["els"], s["els"]), F.lit(profile.best_equal) * penalty
            )
        if prune and profile.prune_floor is not None:
            # The ceiling is that of unequal elements; equal ones left open must stay.
            miss = ~_may_reach(
                profile, d["els"], s["els"], penalty, profile.threshold("similarity")
            )
            # Several elements on both sides are joined by their grams later, not tried pair by pair here.
            miss = ~both_several(d["els"], s["els"]) & miss
            if profile.best_equal is None:
                miss = miss & ~F.arrays_overlap(d["els"], s["els"])
            known = known.when(miss, F.lit(0.0))
    if profile.scorer == "tagged":
        fast = [
            ((d["norm"] == "") | (s["norm"] == ""), "none", 0.0),
            ((s["kind"] == "single") & (d["norm"] == s["norm"]), "direct", profile.direct_score),
            ((s["kind"] == "wrapped_list") & F.array_contains(s["items"], d["norm"]), "list", profile.list_score),
            ((s["kind"] == "delimited_list") & C.listlike_member(d["norm"], s["norm"]), "listlike", profile.listlike_score),
        ]
        tag = reduce(
            lambda acc, x: F.when(x[0], F.lit(x[1])).otherwise(acc), reversed(fast), F.lit("similarity")
        )
        scores = F.create_map(
            *[F.lit(x) for _, name, value in fast for x in (name, float(value))]
        )
        known = F.when(F.col("tag") == "similarity", known).otherwise(scores[F.col("tag")])
        pairs = pairs.withColumn("tag", F.when(filled, tag))
        tag = F.col("tag")
    settled = pairs.select(
        *keep, "d", "s", F.when(filled, tag).alias("tag"), F.when(filled, penalty).alias("penalty"),
        F.when(filled, known).alias("known"), filled.alias("filled"),
    )
    is_open = F.col("filled") & F.col("known").isNull()
    return settled.select(
        *keep,
        F.col("d.ord").alias("d_ord"),
        F.col("s.ord").alias("s_ord"),
        F.when(~F.col("filled"), "null").when(is_open, "open").otherwise("known").alias("state"),
        "known",
        "tag",
        F.when(is_open, F.col("penalty")).alias("penalty"),
        F.when(is_open, F.col("d.els")).alias("d_els"),
        F.when(is_open, F.col("s.els")).alias("s_els"),
    )


def collapse(resolved: DataFrame) -> DataFrame:
    """Equal cell pairs of a column pair become one row with a count, combined map-side first."""
    keys = ["d_ord", "s_ord", "state", "known", "tag", "penalty", "d_els", "s_els"]
    return (
        resolved.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ck", F.monotonically_increasing_id())
    )


# ---- open pairs -----------------------------------------------------------------------------


def pair_key(a: Column, b: Column) -> Column:
    """128-bit key of a value pair; the length prefix keeps ``a|b`` splits apart."""
    return F.unhex(F.md5(F.concat(F.length(a).cast("string"), F.lit(":"), a, b)))


def measure(profile: Profile, pairs: DataFrame, prune_at: float | None = None) -> DataFrame:
    """``ratio``, ``partial`` and ``lev`` of distinct pairs ``(ek, a, b)``.

    Pairs that cannot reach ``prune_at`` may get a partial ratio of 0.

    Equal, empty and contained values have closed forms; only the rest reaches
    the UDF.  The explicit repartition spreads the pairs over all tasks: their
    cost is CPU, which AQE would not see when it merges small partitions.
    """
    a, b = F.col("a"), F.col("b")
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    low, high = F.least(la, lb), F.greatest(la, lb)
    equal, empty = a == b, (a == "") | (b == "")
    inside = F.contains(b, a) | F.contains(a, b)
    hard = ~equal & ~empty
    if profile.fuzzy_backend == "indel":
        hard = hard & ~inside
    if profile.scorer == "hybrid":
        hard = hard & ~F.contains(b, a)
    spread = pairs.repartition(task_count(pairs), "ek")
    bar, weights = None, (0.0, 0.0)
    if prune_at is not None:
        # What ratio and partial ratio have to bring; values that do not contain each other get no boost.
        w = profile.weights
        weights = (w["ratio"], w["partial"])
        alike = F.when(F.arrays_overlap(*[X.grams(x, min(tfidf.GRAM_SIZES)) for x in (a, b)]), F.lit(w["tfidf"]))
        bar = F.lit(prune_at - SLACK) - w["levenshtein"] * fuzzy.levenshtein_similarity(a, b) - F.coalesce(alike, F.lit(0.0))
        bar = F.when(F.col("hard"), bar)
    scored = spread.withColumn("hard", hard).withColumn(
        "f",
        fuzzy.fuzzy_struct(
            F.when(F.col("hard"), a), F.when(F.col("hard"), b), profile.fuzzy_backend, bar, weights
        ),
    )
    closed = F.when(equal, F.lit(1.0)).when(empty, F.lit(0.0))
    ratio = closed.when(F.col("hard"), F.col("f.ratio")).otherwise(2.0 * low / (la + lb))
    partial = closed.when(F.col("hard"), F.col("f.partial")).otherwise(F.lit(1.0))
    if profile.fuzzy_backend == "difflib":
        lev = ratio
    else:
        lev = closed.when(F.col("hard"), fuzzy.levenshtein_similarity(a, b)).otherwise(low / high)
    native = [v.alias(k) for k, v in native_features(profile, a, b).items()]
    return scored.select(
        "ek", "a", "b", ratio.alias("ratio"), partial.alias("partial"), lev.alias("lev"), *native
    )


# ---- element pairs --------------------------------------------------------------------------


def both_several(d_els: Column, s_els: Column) -> Column:
    """Whether all pairs of two element sets are more than the elements themselves."""
    return (F.size(d_els) > 1) & (F.size(s_els) > 1)


def every_element_pair(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of ``(d_els, s_els)`` to one row per element pair ``(a, b)``."""
    return rows.select(*keep, F.explode("d_els").alias("a"), "s_els").select(*keep, "a", F.explode("s_els").alias("b"))


def unlike_bound(profile: Profile, q: int, n: int) -> float:
    """Greatest score of two values of ``n`` characters or more that share no run of ``q`` characters.

    What two values match in order then falls into runs shorter than q, with an unmatched
    character between any two runs.  So of la + lb characters at most
    (la + lb + 1)(q - 1) / (2q - 1) match; of a window no longer than the shorter value at
    most ((q - 1)(m + 1)) / q do; and at least (max - q + 1) / q edits are needed.  All three
    measures fall with the length.  Without a common run of three the cosine is 0.
    """
    if q == 1:
        return 0.0
    ratio = min(1.0, 2 * (q - 1) / (2 * q - 1) * (1 + 1 / (2 * n)))
    window = min(float(n), (q - 1) * (n + 1) / q)
    partial = 2 * window / (n + window)
    lev = min(1.0, (q - 1) / q * (1 + 1 / n))
    if profile.fuzzy_backend == "difflib":
        partial = lev = ratio
    w = profile.weights
    return w["ratio"] * ratio + w["partial"] * partial + w["levenshtein"] * lev


def least_lengths(profile: Profile) -> list[int]:
    """For q = 1, 2, ...: the length from which values have to share a run of q characters to score a hit."""
    floor = profile.threshold("similarity") - SLACK
    out = [1]
    for q in range(2, min(tfidf.GRAM_SIZES) + 1):
        fits = [n for n in range(q, 200) if unlike_bound(profile, q, n) < floor]
        if not fits:
            break
        out.append(max(out[-1], fits[0]))
    return out


def alike_element_pairs(profile: Profile, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Element pairs ``(a, b)`` of each row that may score a hit, by an inverted index on shared runs.

    The longer the values, the longer the run that both must hold (``least_lengths``); a pair
    is joined on the runs of its shorter-run side, hashed, by element number, so no text moves.
    Every pair left out shares no such run and scores below the threshold.  The planner takes
    exploded runs, and texts of a small file, for small tables: no side is ever broadcast.
    """
    lengths = least_lengths(profile)

    def order(x: Column) -> Column:
        return sum((F.length(x) >= F.lit(n)).cast("int") for n in lengths)

    def run_keys(x: Column, q: int) -> Column:
        return F.transform(F.array_distinct(X.grams(x, q)), lambda run: F.xxhash64(F.lit(q), run))

    def index(els: str, other: str, place: str) -> DataFrame:
        orders = F.array_distinct(F.transform(other, order))
        sided = rows.select("ck", orders.alias("others"), F.posexplode(els).alias(place, "x"))
        sided = sided.withColumn("own", order(F.col("x")))
        own, others = F.col("own"), F.col("others")
        runs = []
        for q in range(1, len(lengths) + 1):
            asked = (own == q) & (F.array_max(others) >= q) | (own > q) & F.array_contains(others, q)
            runs.append(F.when(asked, run_keys(F.col("x"), q)).otherwise(F.array().cast("array<bigint>")))
        return sided.select("ck", place, F.explode(F.concat(*runs)).alias("run"))

    theirs = index("s_els", "d_els", "j").hint("merge")
    pairs = index("d_els", "s_els", "i").hint("merge").join(theirs, ["ck", "run"]).select("ck", "i", "j").distinct()
    found = rows.hint("merge").join(pairs.hint("merge"), "ck")
    return found.select(*keep, F.get("d_els", "i").alias("a"), F.get("s_els", "j").alias("b"))


def _closed_cosine(profile: Profile, prune_at: float | None) -> Column:
    """Cosine where it is known or cannot matter, else null."""
    a, b = F.col("a"), F.col("b")
    shortest = min(tfidf.GRAM_SIZES)
    short = (F.length(a) < shortest) | (F.length(b) < shortest)
    # Equal values are cells of the corpus themselves, the excluded text "nan" apart.
    known = F.when(short, F.lit(0.0)).when((a == b) & (a != "nan"), F.lit(1.0))
    if profile.scorer == "hybrid":
        known = known.when(F.contains(b, a), F.lit(0.0))
    if prune_at is not None:
        best = blend(profile, F.col("ratio"), F.col("partial"), F.col("lev"), F.lit(1.0))
        boost = F.when(F.contains(b, a), F.lit(max(EXACT_BOOSTS))).otherwise(F.lit(0.0))
        known = known.when(best + boost < F.lit(prune_at - SLACK), F.lit(0.0))
    # Longer shared grams hold a shared shortest one.
    unlike = ~F.arrays_overlap(X.grams(a, shortest), X.grams(b, shortest))
    return known.when(unlike, F.lit(0.0))


def score_open(
    profile: Profile,
    rows: DataFrame,
    vocabulary: DataFrame,
    ws: Workspace,
    prune: bool = False,
    broadcast_grams: int = tfidf.BROADCAST_GRAMS,
) -> DataFrame:
    """Scores of open rows ``(ck, d_els, s_els, penalty, ...)``: the row's columns plus its score.

    Element pairs are made distinct over all rows before anything costly runs, and
    rejoined by a 16-byte key, so text is shuffled once however often it repeats.
    """
    keep = [c for c in rows.columns if c not in ("d_els", "s_els")]
    exploded = every_element_pair(rows, keep)
    if prune and profile.prune_floor is not None:
        several = both_several(F.col("d_els"), F.col("s_els"))
        exploded = every_element_pair(rows.where(~several), keep).unionByName(
            alike_element_pairs(profile, rows.where(several), keep)
        )
        # Element pairs that cannot lift their row over the threshold; every open row has one that can.
        ceiling = _ceiling(profile, F.col("a"), F.col("b")) * F.col("penalty")
        can = ceiling >= F.lit(profile.threshold("similarity") - SLACK)
        exploded = exploded.where(can if profile.best_equal is not None else can | (F.col("a") == F.col("b")))
    exploded = exploded.withColumn("ek", pair_key(F.col("a"), F.col("b")))
    distinct = exploded.select("ek", "a", "b").distinct()
    prune_at = profile.prune_floor if prune else None
    measured = ws.table(
        measure(profile, distinct, prune_at).withColumn("cosine", _closed_cosine(profile, prune_at)), "elements"
    )
    cosines = tfidf.cosine(
        measured.where(F.col("cosine").isNull()).select("ek", "a", "b"), vocabulary, broadcast_grams
    )
    cosine = F.coalesce(F.col("cosine"), F.col("tfidf"), F.lit(0.0))
    full = measured.join(cosines, "ek", "left")
    stored = {k: F.col(k) for k in native_features(profile, F.col("a"), F.col("b"))}
    scores = element_scores(
        profile, F.col("a"), F.col("b"), F.col("ratio"), F.col("partial"), F.col("lev"), F.col("cos"), stored
    )
    scored = full.withColumn("cos", cosine).select("ek", *[v.alias(k) for k, v in scores.items()])
    joined = exploded.drop("a", "b").hint("merge").join(scored.hint("merge"), "ek").drop("ek")
    if profile.scorer in ("unified", "rowwise"):
        return joined.drop("penalty")  # one element pair per row
    if prune and profile.prune_floor is not None:
        # Rows of several elements without any pair alike enough are misses; no score is below 0.
        joined = joined.unionByName(rows.where(several).select(*keep, F.lit(0.0).alias("score")))
    best = joined.groupBy(*keep).agg(F.max("score").alias("score"))
    return best.withColumn("score", F.col("score") * F.col("penalty")).drop("penalty")
