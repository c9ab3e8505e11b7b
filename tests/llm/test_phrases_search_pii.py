"""Phrase collocations, ranked search and personal data against plain versions, on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from colweave.llm import lexical, phrases, pii

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, phrase string, spans int"


def frame(spark, rows):
    """Documents with columns named like results."""
    return spark.createDataFrame([(i, t, lang, "clash", 1) for i, t, lang in rows], DOCS)


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, top, least, cover):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {
            p[i : i + k]
            for p, a in found.items()
            for k in range(2, len(p))
            for i in range(len(p) - k + 1)
            if 100 * a >= cover * found[p[i : i + k]]
        }
        best = {p: min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p))) for p, a in found.items()}
        order = sorted((p for p in found if p not in gone), key=lambda p: (-best[p][0], -found[p], " ".join(p).encode()))
        for i, p in enumerate(order[:top]):
            score, k = best[p]
            out.append((lang, i + 1, " ".join(p), found[p], c[p[:k]], c[p[k:]], n[lang], score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "ünd", "E", "f", "g\x1c", "h"]
    fixed = ["new york city hall", "New York City", "the end of a day", "tab\tand\tspace"]
    rows = []
    for i in range(160):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(vocabulary, range(1, 9), k=6)) for _ in range(5)]
        rows.append((i, rng.choice([", ", " ", "\n", ";"]).join(parts), rng.choice(["en", "en", "en", "de", None])))
    return rows + rows[:30] + [(None, None, "en"), (1, "", None), (2, " \t.", "fr"), (3, "long " * 4000, "xx")]


@pytest.mark.parametrize("top, least, cover", [(2000, 4, 80), (7, 4, 80), (3, 10, 50), (1, 5, 101)])
def test_phrases_against_all_counts(spark, top, least, cover):
    rows = phrase_rows(top)
    out = phrases.mine_phrases(frame(spark, rows), top=top, least=least, cover=cover)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out.collect())
    assert got == plain_phrases(rows, top, least, cover)


def test_phrases_need_a_second_round(spark, monkeypatch):
    # The best pairs all lie inside longer phrases, so the first threshold leaves too few.
    rows = [(i, f"p{i % 9} q{i % 9} r{i % 9} s{i % 9}. " * 3 + f"x y{i % 5}", "en") for i in range(90)]
    monkeypatch.setattr(phrases, "WIDER", 2)
    got = phrases.mine_phrases(frame(spark, rows), top=8, least=5).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == plain_phrases(rows, 8, 5, 80)


def test_phrases_of_an_empty_table(spark):
    assert phrases.mine_phrases(frame(spark, [])).collect() == []


def test_chunks_and_merged_runs(monkeypatch):
    everything = type("All", (), {"holds": lambda self, *names: np.ones(len(names[0]), bool)})()
    monkeypatch.setattr(phrases, "HELD_WORDS", 5)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b,", "c", "d.", "e"], k=rng.randint(0, 9))) for _ in range(40)]
    held, want = [], Counter()
    for at in range(0, 40, 4):
        chunk = phrases._Chunk(0)
        for t in texts[at : at + 4]:
            chunk.add("en", t)
            for piece in re.split("[.,]", t):
                w = piece.split()
                want.update(tuple(phrases._name("en", x.encode(), 0) for x in w[i : i + 4]) for i in range(len(w) - 3))
        row = chunk.row().to_pylist()[0]
        assert {x["word"]: x["n"] for x in row["words"]} == Counter(w for t in texts[at : at + 4] for w in re.split("[., ]+", t) if w) | {
            None: sum(bool(w) for t in texts[at : at + 4] for w in re.split("[., ]+", t))
        }
        held.append((np.frombuffer(row["names"], np.int64), np.frombuffer(row["run"], np.int32)))
    assert chunk.full
    *names, counts = phrases._grams(4, *phrases._merged(held, everything), [everything] * 3)
    assert dict(zip(zip(*[n.tolist() for n in names]), counts.tolist())) == want


def test_counted_rows_of_wide_numbers():
    rng = np.random.default_rng(7)
    for size in (2, 1 << 15, 1 << 22, 1 << 31):
        columns = [rng.integers(max(0, size - 3), size, 500) for _ in range(4)]
        parts, counts = phrases._counted(columns, size)
        got = dict(zip(zip(*[p.tolist() for p in parts]), counts.tolist()))
        assert got == Counter(zip(*[c.tolist() for c in columns]))
        assert [len(x) for x in phrases._counted([c[:0] for c in columns], size)[0]] == [0] * 4


def test_phrase_scores_beyond_64_bits(spark):
    big = 1 << 62
    df = spark.createDataFrame([(big, big, big + 2)], "a long, l long, r long")
    got = df.select(phrases._share(df["a"], phrases._sum(df["l"], df["r"]))).head()[0]
    assert got == 2_000_000 * big // (2 * big + 2)


def test_bitmap_holds_its_members(spark):
    rng = np.random.default_rng(1)
    names = rng.integers(1, 1 << 62, (500, 2))
    found = phrases.Bitmap(spark, spark.createDataFrame(names.tolist(), "w1 long, w2 long"), 500)
    assert found.holds(names[:, 0], names[:, 1]).all()
    assert found.holds(names[:, 1], names[:, 0]).mean() < 0.2


# ---------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k=10):
    docs = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t, _ in rows]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, all_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(w.translate(LOWER) for w in TERM.findall(text or ""))
    out = []
    for item, terms in queries.items():
        found = []
        for i, c, n in docs:
            m = 10 + (90 * n * n_docs) // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(3)
    words = [f"w{int(40 * rng.random() ** 2)}" for _ in range(60)] + ["É", "Straße", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))).upper(), "en") for i in range(700)]
    return rows + rows[:40] + [(None, rows[5][1], "en"), (9001, None, None), (9002, "", None), (9003, "w1 " * 9000, None)]


ITEMS = [(1, "W1 w2 W3 é"), (1, "w1 w30"), (2, None), (3, "--"), (4, "nothing here"), (None, "straße x1 w7"), (5, "w0 w1 w2 w3 w4 w5 w6 w9")]


@pytest.mark.parametrize("query_bytes", [lexical.QUERY_BYTES, 30])
def test_search_against_all_scores(spark, query_bytes):
    rows = search_rows()
    items = spark.createDataFrame(ITEMS + ITEMS[:2], "item_id int, text string")
    out = lexical.search(frame(spark, rows), items, query_bytes=query_bytes)
    got = [(r["item"], r["rank"], r["id"], r["score"]) for r in out.collect()]
    assert sorted(got, key=repr) == plain_search(rows, ITEMS)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.search(frame(spark, []), items).collect() == []
    assert lexical.search(frame(spark, search_rows()), items.limit(0)).collect() == []
    assert lexical.search(frame(spark, [(1, None, None), (2, "...", None)]), items).collect() == []


def test_summaries_bound_and_blocks_are_skipped():
    rng = np.random.default_rng(2)
    size = 400
    own = [np.sort(rng.choice(np.arange(1, size), 12, replace=False)) for _ in range(20)]
    queries = lexical.Queries(own, np.r_[0, rng.integers(1, 9000, size - 1)])
    asked = set(np.concatenate(own).tolist())
    per_row = [np.sort(rng.choice([t for t in range(1, size) if t in asked], rng.integers(1, 30), replace=False)) for _ in range(1500)]
    ends = np.cumsum([0, *map(len, per_row)])
    terms = np.concatenate(per_row)
    values = rng.integers(1, 10**9, len(terms))
    segment = lexical.Segment(np.arange(1500), ends, terms, values, queries)
    dense = np.zeros((1500, size), np.int64)
    dense[segment.rows, terms] = values
    for term in asked:
        rows, block_ends, summary = segment.blocked(term)
        assert sorted(rows) == np.flatnonzero(dense[:, term]).tolist()
        for b in range(len(summary)):
            assert (summary[b] == dense[rows[block_ends[b] : block_ends[b + 1]]][:, queries.near[term]].max(0)).all()
    flags, seen = np.zeros(size, np.int64), np.zeros(1500, bool)
    for q in own:
        best = lexical.Best(10)
        segment.search(q, best, seen, flags)
        score = dense[:, q].sum(1)
        want = sorted(zip(-score, range(1500)))[:10]
        assert [(-s, i) for s, i in zip(best.scores, best.ids)] == want
        assert not seen.any() and not flags.any()
        # A known tenth best score changes nothing but what is looked at.
        again = lexical.Best(10, int(best.scores[-1]))
        segment.search(q, again, seen, flags)
        assert (again.scores == best.scores).all() and (again.ids == best.ids).all()
    few = lexical.Segment(np.arange(1500), ends, terms, values, queries)
    few.search(own[0], lexical.Best(10, 10**12), seen, flags)
    assert not few.blocks


# ---------------------------------------------------------------- personal data


def plain_base(text):
    """The base patterns as they are stated."""
    out = []
    for kind, pattern in enumerate(
        (
            r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]",
        )
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == 2:
                doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_the_stated_patterns():
    rng = random.Random(11)
    for alphabet in ("ab1@.-+% ", "0123456789.", "0123456789 -", "+01234567 ().-x", "a0@.+-() 9é\n"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            assert pii.base_spans(text) == plain_base(text), text
    for text in ("4111 1111 1111 1111", "é 4111-1111-1111-1111", "x@y.z@q.w", "1.2.3.4.5.6.7.8", "1.2.3.0256", "+1 (555) 010-9999"):
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "1." * 150_000, "+1 " * 60_000, "a@b" * 60_000, "1-" * 100_000):
        assert [s for s in pii.base_spans(text) if s[0] != 1][:1] in ([], plain_base(text[:60])[:1])


def planted():
    """Addresses and unseen numbers after one context, further numbers after a second one, and clean texts."""
    rng = random.Random(8)
    rows = [f"Record {i % 3} ok. Our customer: who{i}@mail.example.com wrote today." for i in range(40)]
    ids = [f"KD-{rng.randint(10**5, 10**6 - 1)}" for i in range(6)]
    rows += [f"Then our customer: {x} wrote again, and the part {100 + i} came." for i, x in enumerate(ids * 2)]
    rows += [f"See file holder # {x} in the cellar" for x in [*ids, "ZZ-777123"]]
    rows += ["The model: A320-214 flies, build 20240101 is out, one room # 123456."] * 30
    return rows, ids


def test_contexts_discover_unseen_identifiers(spark):
    rows, ids = planted()
    table = [(i, t, None) for i, t in enumerate(rows)] + [(None, None, None), (7, "", "x"), (8, rows[0], None)] + [(9, "a " * 50_000, None)]
    docs = frame(spark, table)

    def found(**options):
        out, name = pii.find_pii(docs, pii.fit(docs, **options))
        assert name == "spans_" and out.columns[:5] == docs.columns
        return [
            (r["text"][s.start : s.stop], s.kind) for r in out.collect() for s in r[name] if r["text"]
        ]

    got = found()
    assert sum(k == 0 for _, k in got) == 41
    assert Counter(x for x, k in got if k == 4) == Counter({x: 2 for x in ids})
    # The numbers found once lead to a second context, and that one to a number seen nowhere else.
    more = Counter(x for x, k in found(confidence=0.4) if k == 4)
    assert more == Counter({x: 3 for x in ids} | {"ZZ-777123": 1})
    assert all(k < 4 for _, k in found(rounds=1, confidence=0.99))


def test_scores_against_a_plain_graph(spark):
    rows, _ = planted()
    docs = frame(spark, [(i, t, None) for i, t in enumerate(rows)])
    token = re.compile(r"[^\W\d_]+|[:#=]")
    slots, totals = [], Counter()
    for text in rows:
        tokens = [m[0].lower() for m in token.finditer(text)]
        totals.update(tuple(tokens[i : i + c]) for c in (1, 2, 3) for i in range(len(tokens) - c + 1))
        for a, b, seed in pii.slots(text)[1]:
            before = [m for m in token.finditer(text) if m.end() <= a][-3:]
            if before and re.fullmatch(r"[^\w:#=]*", text[before[-1].end() : a]):
                names = [m[0].lower() for m in before]
                slots.append((text[a:b].lower(), seed, [tuple(names[-c:]) for c in range(1, len(names) + 1)]))
    trust = {x: 1.0 for x, seed, _ in slots if seed}
    for _ in range(2):
        mass, support = Counter(), defaultdict(set)
        for x, _, patterns in slots:
            for p in patterns if x in trust else ():
                mass[p] += trust[x]
                support[p].add(x)
        kept = {p: min(1, mass[p] / totals[p]) for p in mass if len(support[p]) >= 5 and mass[p] / totals[p] >= 0.4 and set(p) - set(":#=")}
        means = defaultdict(float)
        for x in {x for x, seed, _ in slots if not seed}:
            own = [ps for y, seed, ps in slots if y == x and not seed]
            means[x] = max(sum(kept.get(p, 0) for ps in own for p in ps if len(p) == c) / len(own) for c in (1, 2, 3))
        trust = {x: 1.0 for x, seed, _ in slots if seed} | {x: r for x, r in means.items() if r >= 0.5}
    got = {r["pattern"]: r["confidence"] for r in pii.fit(docs, rounds=2, confidence=0.4)}
    assert got == pytest.approx({" ".join(p): c for p, c in kept.items()})


def test_no_seed_no_pattern(spark):
    docs = frame(spark, [(i, "the number: AB-12345", None) for i in range(20)])
    assert pii.fit(docs) == [] and pii.fit(docs.limit(0)) == []
    out, x = pii.find_pii(docs.limit(0), [])
    assert out.count() == 0 and x == "spans_"
