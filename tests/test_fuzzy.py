import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from colweave.functions import fuzzy


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    if not a or not b:
        return float(a == b)
    found = []
    for s, t in {(a, b), (b, a)}:
        if len(s) <= len(t):
            for start in range(1 - len(s), len(t)):
                found.append(ratio(s, t[max(start, 0) : start + len(s)]))
    return max(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc 😀", max_size=9), st.text("abc é", max_size=16)), min_size=1, max_size=12))
def test_against_brute_force(pairs):
    whole, best = fuzzy.indel_scores([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), x, y in zip(pairs, whole, best):
        assert x == pytest.approx(ratio(a, b), abs=1e-12)
        assert y == pytest.approx(partial(a, b), abs=1e-12)


def test_long_values_need_no_cut():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdef ") for _ in range(700))
    b = "".join(rng.choice("abcdef ") for _ in range(900))
    whole, _ = fuzzy.indel_scores([a], [b])
    assert whole[0] == pytest.approx(ratio(a, b), abs=1e-12)


def codes(text):
    return np.array([ord(c) for c in text], np.int32)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab é😀", min_size=1, max_size=150), st.text("abc", min_size=1, max_size=150)), min_size=1, max_size=8))
def test_bit_parallel_lcs(pairs):
    pairs = [sorted(p, key=len) for p in pairs]
    found = fuzzy.lcs_lengths([codes(a) for a, _ in pairs], [codes(b) for _, b in pairs])
    assert found.tolist() == [lcs(a, b) for a, b in pairs]
    assert [fuzzy._lcs_alone(codes(a), codes(b)) for a, b in pairs] == found.tolist()


@pytest.mark.parametrize("m", [63, 64, 65, 127, 128, 129, 255, 256, 257, 400])
def test_carries_cross_blocks(m):
    rng = random.Random(m)
    same = "a" * m
    a = "".join(rng.choice("ab") for _ in range(m))
    b = "".join(rng.choice("ab") for _ in range(m + 30))
    for x, y in ((same, "a" * (m + 5)), (same, "b" * m), (a, b), (a, "b" + a + "a")):
        assert fuzzy.lcs_lengths([codes(x)] * 2, [codes(y)] * 2).tolist() == [lcs(x, y)] * 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=12), st.text("abcd", max_size=20), st.floats(0, 1)), min_size=1, max_size=10))
def test_bars_stop_only_pairs_below_them(rows):
    a, b, bar = (list(x) for x in zip(*rows))
    bar = np.array(bar)
    bar[::4] = np.nan
    whole, best = fuzzy.indel_scores(a, b)
    ratio_, partial_ = fuzzy.indel_scores(a, b, bar, (0.3, 0.7))
    assert ratio_ == pytest.approx(whole)
    for full, part, total, at in zip(best, partial_, 0.3 * whole + 0.7 * best, bar):
        assert part == full or (part == 0 and total < at)


def test_long_pairs_in_bounded_time():
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(10_000)) for _ in range(2))
    whole, best = fuzzy.indel_scores([a, a], [b, b], np.array([0.99, 0.99]), (0.5, 0.5))
    assert best.tolist() == [0.0, 0.0] and 0.4 < whole[0] < 0.9
    assert fuzzy._lcs_alone(codes(a), codes(a + b)) == 10_000


def test_measures(evaluate):
    rows = [("kitten", "sitting"), ("", ""), ("", "x"), ("ab", "xxabxx"), (None, "x")]
    got = evaluate(fuzzy.indel_struct, *rows)
    assert [g and g["ratio"] for g in got[:4]] == pytest.approx([8 / 13, 1.0, 0.0, 0.5])
    assert [g and g["partial"] for g in got[:4]] == pytest.approx([partial("kitten", "sitting"), 1.0, 0.0, 1.0])
    lev = evaluate(fuzzy.levenshtein_similarity, *rows[:4])
    assert lev == pytest.approx([4 / 7, 1.0, 0.0, 1 / 3])
    want = [difflib.SequenceMatcher(a=a, b=b).ratio() for a, b in rows[:4]]
    assert evaluate(fuzzy.difflib_ratio, *rows[:4]) == pytest.approx(want)
    assert evaluate(fuzzy.lcs_like, *rows[:4]) == pytest.approx([partial("kitten", "sitting"), 0.0, 0.0, 1.0])
