"""Near-duplicates against all pairs, with every branch of the search forced on small data."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colweave.llm import near_dedup as N
from colweave.llm.components import ONE_TASK, components
from colweave.plans.workspace import Workspace


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def plain_components(rows, similarity):
    """Least id by row position, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if not a or not sets[j] or min(len(a), len(sets[j])) * similarity[1] < max(len(a), len(sets[j])) * similarity[0]:
                continue
            common = len(a & sets[j])
            if similarity[1] * common >= similarity[0] * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return [(name, len(s), least.get(root(i), name)) for i, ((name, _), s) in enumerate(zip(rows, sets))]


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = [(None, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (4, "ONE two"), (5, "é"), (None, "lone text without any id at all")]
    base = [f"v{i}" for i in range(120)]
    for i in range(70):  # a star: copies that are near the base but not each other
        rows.append((100 + i, varied(rng, base, rng.choice([0, 1, 1, 2, 3, 4]))))
    line = list(base)
    for i in range(12):  # a chain of edits
        line[5 * i % 120] = f"c{i}"
        rows.append((300 - i, " ".join(line)))
    for i in range(60):
        own = [f"x{rng.randrange(5000)}" for _ in range(rng.randint(1, 80))]
        rows.append((400 + i, " ".join(own)))
        if i % 3 == 0:
            rows.append((500 + i, varied(rng, own, 1)))
    rows.append((900, " ".join(f"long{i % 7000}" for i in range(20_000))))
    rows.append((901, rows[-1][1]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, depth, similarity", [(10, 1, (85, 100)), (4, 0, (80, 100))])
def test_against_all_pairs(spark, corpus, monkeypatch, small, depth, similarity):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "DEPTH", depth)
    docs = spark.createDataFrame([(*r, 7) for r in corpus], "doc_id long, text string, kept int")
    out = N.near_duplicates(docs, similarity=similarity).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key)
    assert got == sorted(plain_components(corpus, similarity), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_almost_similar_pairs_make_no_rows(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(300)]
    rows = [(i, varied(rng, base, 4)) for i in range(120)]  # about 0.76 to each other
    rows += [(200 + i, t + " z") for i, t in rows[:3]]
    made = {}
    counted = Workspace.counted

    def seen(self, df, name, **more):
        told = counted(self, df, name, **more)
        made[name.split("_", 1)[1]] = told[1]["n"]
        return told

    monkeypatch.setattr(Workspace, "counted", seen)
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(n, c) for n, _, c in plain_components(rows, N.SIMILARITY)}
    assert made["still_open"] > 1 and max(made.values()) <= 2 * made["nodes"] < 120 * 119 / 2, made


def test_a_pair_is_looked_at_in_one_node():
    around = np.empty(3, object)
    around[:] = [np.array(x) for x in ([-4, 3, 7], [3, 7], [7])]
    a, b = np.array([0, 0, 1]), np.array([1, 2, 2])
    assert N.meet_first(a, b, 7, around).tolist() == [False, True, True]
    assert N.meet_first(a[:1], b[:1], 3, around[:2]).tolist() == [True]


def test_representatives_and_empty(spark, corpus):
    docs = spark.createDataFrame([(*r, "s") for r in corpus], "doc_id long, text string, dropped_id string")
    kept = N.keep_representatives(docs)
    want = sorted(n for n, _, c in plain_components(corpus, N.SIMILARITY) if n == c and n is not None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_rows_are_dropped_one_by_one(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(200))
    rows = [(1, text("a")), (5, text("a") + " z"), (5, text("b")), (6, text("b").upper())]  # id 5 has two texts
    rows += [(7, text("c"))] * 3 + [(7, text("c") + " z"), (8, text("c")), (None, text("c"))]  # repeats of the least id
    rows += [(None, text("d"))] * 4 + [(None, text("d") + " z"), (None, "alone"), (2, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, class string")
    kept = N.keep_representatives(docs)
    assert kept.columns == docs.columns
    first = lambda r: (r.doc_id, (r.text or "-").split(" ")[0].lower())
    got = sorted(map(first, kept.collect()), key=str)
    assert got == sorted([(1, "a0"), (5, "b0"), (7, "c0"), (None, "d0"), (None, "alone"), (2, "-"), (None, "-")], key=str)
    assert N.keep_representatives(docs.where("doc_id = 1")).count() == 1


def test_hashes_and_signatures():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aAbé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "a" * 3000, " " + "b" * 2000 + " c\x0bd\x1ce "]
    assert [len(N.shingles(t)) for t in texts] == [len(plain_set(t)) for t in texts]
    by_words = {}
    for t in texts:
        for w, h in zip((t or "").encode().lower().split(), N.word_hashes(t).tolist()):
            assert by_words.setdefault(w, h) == h
    assert len(set(by_words.values())) == len(by_words)
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (N.minwise(N.mix(a[:900])) == N.minwise(N.mix(a[100:]))).mean()
    assert abs(same - 0.8) < 0.15


def test_one_long_word_leaves_the_other_hashes_alone(spark):
    words = [f"v{i}" for i in range(300)]
    plain, longer = " ".join(words), " ".join([*words, "b" * 2000])
    assert len(np.intersect1d(N.shingles(plain), N.shingles(longer))) == len(plain_set(plain) & plain_set(longer)) == 296
    out = N.near_duplicates(spark.createDataFrame([(1, plain), (2, longer)], "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {1}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(0, i) for i in range(500, 700)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame(edges, "u long, v long")
    for name, rows in (("one_task", len(edges)), ("rounds", ONE_TASK + 1)):
        found = components(links, Workspace(spark), name, rows).collect()
        assert {(r.u, r.v) for r in found} == {(x, root(x)) for x in parent if root(x) != x}
    assert components(links.limit(0), Workspace(spark), "none", 0).collect() == []


def test_unrelated_members_share_hardly_a_child():
    rng = np.random.default_rng(3)
    bytes_ = rng.integers(0, 256, (1000, N.MINS)).astype(np.uint8)
    near = bytes_[0].copy()
    near[rng.choice(N.MINS, 8, replace=False)] ^= 1
    paths = pa.array(np.full(1001, 7, np.int64))
    children = next(N._children(iter([(paths, pa.array([m.tobytes() for m in [*bytes_, near]]))]))).to_pylist()
    counts = Counter(c for x in children[:1000] for c in x)
    assert 2700 < counts.total() < 3300 and sum(n > 1 for n in counts.values()) < 5
    many = next(N._children(iter([(pa.array(np.arange(40)), pa.array([bytes_[0].tobytes()] * 40))]))).to_pylist()
    same = next(N._children(iter([(pa.array(np.arange(40)), pa.array([near.tobytes()] * 40))]))).to_pylist()
    assert sum(bool(set(a) & set(b)) for a, b in zip(many, same)) > 25
