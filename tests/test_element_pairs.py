"""The element join of many-valued cells against all element pairs."""

import random

import pytest
from pyspark.sql import functions as F

from colweave import match_columns
from colweave.functions import fuzzy
from colweave.operators import scoring as S
from colweave.plans.profiles import get_profile
from colweave.plans.workspace import Workspace
from test_fuzzy import lcs, partial


def tables(spark, seed=1, ids=6, size=120):
    """Cells of ``size`` values; the report's values are misspelt, single characters and short values among them."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    pool = [f"{word(rng.randint(3, 9))} {word(rng.randint(2, 7))}" for _ in range(300)] + ["x", "yz", "q7", "ab", "é"]
    source, dash = [], []
    for i in range(ids):
        chosen = rng.sample(pool, size)
        source.append((i, ", ".join(chosen), " | ".join(rng.sample(pool, 5))))
        wrong = [v[:2] + v[3:] + rng.choice(["", "s"]) + "!" for v in rng.sample(chosen, size // 3)]
        dash.append((i, "; ".join(wrong + [word(6) for _ in range(size // 3)])))
    dash.append((ids, "nothing, alike, here"))
    source.append((ids, "012345, 678901, 3", "55, 66, 77"))
    return spark.createDataFrame(source, "id int, names string, few string"), spark.createDataFrame(dash, "id int, item string")


PROFILES = [("weighted", {}), ("longguard", {}), ("hybrid", {}), ("weighted", {"min_ratio": 0.45})]


@pytest.mark.parametrize("profile, changes", PROFILES)
def test_joined_pairs_give_the_results_of_all_pairs(spark, monkeypatch, profile, changes):
    source, dash = tables(spark)
    counted = []
    measure = S.measure

    def counting(p, pairs, *more):
        counted.append(pairs.count())
        return measure(p, pairs, *more)

    monkeypatch.setattr(S, "measure", counting)

    def found():
        result = match_columns(source, dash, "id", profile=profile, **changes)
        rows = (result.candidates if result.candidates is not None else result.mapping).collect()
        return sorted([{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in rows], key=str)

    got, joined = found(), counted.pop()
    monkeypatch.setattr(S, "both_several", lambda d, s: F.size(d) < 0)
    monkeypatch.setattr(fuzzy, "indel_struct", lambda a, b, *bar, f=fuzzy.indel_struct: f(a, b))
    want, crossed = found(), counted.pop()
    assert got == want and got
    assert joined <= crossed
    if not changes:
        assert joined * 3 < crossed  # most pairs of the cross product share no run


def test_no_alike_pair_is_left_out(spark):
    """Every element pair whose measures can reach the threshold is joined."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
    rows = [(i, sorted({word() for _ in range(8)}), sorted({word() for _ in range(8)})) for i in range(25)]
    df = spark.createDataFrame(rows, "ck long, d_els array<string>, s_els array<string>")
    for floor in (0.45, 0.6, 0.7):
        profile = get_profile("weighted", min_ratio=floor)
        got = {(r.ck, r.a, r.b) for r in S.alike_element_pairs(profile, df, ["ck"]).collect()}
        w = profile.weights
        for ck, d, s in rows:
            for a in d:
                for b in s:
                    edits = fuzzy_lev(a, b)
                    cosine = any(a[i : i + 3] in b for i in range(len(a) - 2))
                    score = w["ratio"] * 2 * lcs(a, b) / (len(a) + len(b)) + w["partial"] * partial(a, b)
                    score += w["levenshtein"] * (1 - edits / max(len(a), len(b))) + w["tfidf"] * cosine
                    assert (ck, a, b) in got or score < floor, (a, b, score)


def fuzzy_lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounds_fall_with_the_length():
    for name in ("weighted", "hybrid", "tagged"):
        p = get_profile(name)
        for q in (2, 3):
            bounds = [S.unlike_bound(p, q, n) for n in range(q, 100)]
            assert bounds == sorted(bounds, reverse=True)
        lengths = S.least_lengths(p)
        assert lengths[0] == 1 and lengths == sorted(lengths)


def test_a_row_without_alike_elements_is_a_miss(spark):
    rows = [(1, 0, 0, 1, "similarity", 1.0, ["abcdef", "ghijkl"], ["012345", "678901"])]
    schema = "ck long, d_ord int, s_ord int, n int, tag string, penalty double, d_els array<string>, s_els array<string>"
    vocabulary = spark.createDataFrame([("", 4), ("abc", 1)], "gram string, df long")
    out = S.score_open(get_profile("weighted"), spark.createDataFrame(rows, schema), vocabulary, Workspace(spark), prune=True)
    assert [(r.ck, r.n, r.score) for r in out.collect()] == [(1, 1, 0.0)]


def test_exploded_runs_are_never_broadcast(spark):
    """The planner takes exploded runs and the rows' texts for small tables; on the driver they are not."""
    rows = spark.createDataFrame([(1, ["large ring", "hot bolt"], ["lage ring", "ho bolt"])], "ck long, d_els array<string>, s_els array<string>")
    found = S.alike_element_pairs(get_profile("weighted"), rows, ["ck"])
    assert {("large ring", "lage ring"), ("hot bolt", "ho bolt")} <= {(r["a"], r["b"]) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
