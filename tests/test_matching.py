import random

import pytest
from pyspark.sql import functions as F

from colweave import PROFILES, audit_cells, get_profile, match_columns
from colweave.functions import text as X
from colweave.operators import align as A, candidates as N, rank as R, scoring as S, tfidf
from colweave.plans.matching import audit_columns
from colweave.plans.profiles import Profile
from colweave.plans.workspace import Workspace


def frames(spark, source, dash):
    names = lambda p, rows: ["id", *[f"{p}{i}" for i in range(1, len(rows[0]))]]
    return (
        spark.createDataFrame(source, ", ".join(f"{n} string" for n in names("s", source))),
        spark.createDataFrame(dash, ", ".join(f"{n} string" for n in names("d", dash))),
    )


def cell_score(spark, profile, dash, source, **changes):
    """Score and tag of a single cell pair; the filler row only feeds the corpus."""
    s, d = frames(spark, [("1", source)], [("1", dash)])
    row = audit_cells(s, d, "id", pairs=[("d1", "s1")], profile=profile, **changes).first()
    return row["score"], row["tag"] if "tag" in row else None


@pytest.mark.parametrize(
    "dash, source, score, tag",
    [
        ("[]", "x", 0.0, "none"),
        ("a, b", "a, b, c", 0.90, "listlike"),
        ("A, B", "A, B", 0.90, "listlike"),
        ("[A,B]", "[A,B]", 0.999 * 0.94, "similarity"),
        ("apple", "Apple | Apple", 0.90, "listlike"),
        ("x", "[x, y]", 0.94, "list"),
        ("Foo ", "(foo)", 0.94, "list"),
        ("ab", " 'AB' ", 0.99, "direct"),
    ],
)
def test_tagged_cells(spark, dash, source, score, tag):
    assert cell_score(spark, "tagged", dash, source) == (pytest.approx(score), tag)


def test_empty_normal_forms(spark):
    """Equal blanks score only where the dashboard value as written counts, or in the bare ratios."""
    assert cell_score(spark, "containment", "[]", "()")[0] == pytest.approx(0.35)
    assert cell_score(spark, "rowwise", "[]", "()")[0] == pytest.approx(0.15)
    assert cell_score(spark, "hybrid", "[]", "()")[0] == 0.0


def scores(spark, profile, a, b, ratio, partial, lev, cosine):
    cols = [F.lit(float(x)) for x in (ratio, partial, lev, cosine)]
    out = S.element_scores(profile, F.lit(a), F.lit(b), *cols)["score"]
    return spark.range(1).select(out.alias("x")).first()["x"]


LONG_TEXT = "word " * 19 + "apple"


@pytest.mark.parametrize(
    "a, b, partial, cosine, boost",
    [
        ("apple", "red apple", 0.2, 0.0, 0.25),
        ("apple", LONG_TEXT, 0.95, 0.0, 0.15),
        ("apple", LONG_TEXT, 0.2, 0.46, 0.15),
        ("apple", LONG_TEXT, 0.2, 0.0, -0.15),
        (LONG_TEXT[:60] + "word", LONG_TEXT, 0.2, 0.0, 0.10),
        ("one two three four five and some more text to be long", "x " * 120 + "one two three four five and some more text to be long", 0.2, 0.0, -0.10),
        ("one two three four five and some more text to be long", "x " * 120 + "one two three four five and some more text to be long", 0.81, 0.0, 0.10),
        ("apple", "pineapple", 0.2, 0.0, 0.0),
        (LONG_TEXT, LONG_TEXT, 0.2, 0.0, 0.20),
        ("apple", "apple", 0.2, 0.0, 0.40),
    ],
)
def test_guard_branches(spark, a, b, partial, cosine, boost):
    p = get_profile("tagged")
    got = scores(spark, p, a, b, 0.5, partial, 0.5, cosine)
    base = 0.25 * partial + 0.25 * 0.5 + 0.20 * 0.5 + 0.30 * cosine
    assert got == pytest.approx(min(0.999, max(0.0, base + boost)))


def test_equal_long_value_penalties(spark):
    """Reachable only with a gate no equal value passes."""
    strict = get_profile("tagged").replace(min_precision=3.0, min_partial=0.9)
    assert strict.best_equal is None
    assert scores(spark, strict, LONG_TEXT, LONG_TEXT, 0.5, 0.2, 0.5, 0.0) == pytest.approx(0.275 - 0.10)
    short = "a b c"
    tight = strict.replace(long_words=2)
    assert scores(spark, tight, short, short, 0.5, 0.2, 0.5, 0.0) == pytest.approx(0.275 - 0.20)


def test_difflib_backend(spark):
    import difflib

    a, b = "apple", "zz yy " * 20 + "apple"
    ratio = difflib.SequenceMatcher(a=a, b=b).ratio()
    s, d = frames(spark, [("1", b)], [("1", a)])
    row = audit_cells(s, d, "id", pairs=[("d1", "s1")], profile="weighted", fuzzy_backend="difflib").first()
    assert row["score"] < 0.3  # the substring penalty, as the ratio stands in for partial_ratio
    indel = audit_cells(s, d, "id", pairs=[("d1", "s1")], profile="weighted").first()
    assert indel["score"] > row["score"] + 0.3 and ratio < 0.2


def test_one_to_one_drops_the_weaker(spark):
    rows = [(str(i), f"value {i}") for i in range(12)]
    s = spark.createDataFrame(rows, "id string, s1 string")
    d = spark.createDataFrame([(i, v, f"{v} x") for i, v in rows], "id string, d1 string, d2 string")
    for profile in ("containment", "unified"):
        assert [r["dashboard_col"] for r in match_columns(s, d, "id", profile=profile).mapping.collect()] == ["d1"]
        both = match_columns(s, d, "id", profile=profile, one_to_one=False).mapping.collect()
        assert [r["dashboard_col"] for r in both] == ["d1", "d2"]
        assert match_columns(s, d, "id", profile=profile, min_support=13).mapping.count() == 0


def test_ties_keep_column_order(spark):
    rows = [(str(i), "same", "same") for i in range(12)]
    s = spark.createDataFrame(rows, "id string, s1 string, s2 string")
    d = spark.createDataFrame([r[:2] for r in rows], "id string, d1 string")
    for profile in ("containment", "hybrid", "weighted"):
        assert match_columns(s, d, "id", profile=profile).mapping.first()["source_col"] == "s1"


def test_denominators(spark):
    """Merged profiles count blank cells, the others skip nulls."""
    s, d = frames(spark, [("1", "x"), ("2", None), ("3", "x")], [("1", "x"), ("2", "x"), ("3", "x")])
    assert match_columns(s, d, "id", profile="tagged").candidates.first()["total_pairs"] == 3
    assert match_columns(s, d, "id", profile="rowwise").mapping.first()["support"] == 2
    row = match_columns(s, d, "id", profile="containment", min_support=1).mapping.first()
    assert (row["support"], row["coverage"]) == (2, pytest.approx(2 / 3))


def test_sampling_is_by_id(spark):
    rows = [(i, "yes" if i < 20 else "no") for i in range(100)]
    s = spark.createDataFrame(rows, "id long, s1 string").repartition(5)
    d = spark.createDataFrame([(i, "yes") for i in range(100)], "id long, d1 string").repartition(3)
    got = match_columns(s, d, "id", profile="unified", sample_rows=20).mapping.first()
    assert (got["support"], got["exact"], got["coverage"]) == (20, 1.0, 0.2)
    got = match_columns(s, d, "id", profile="containment", sample_rows=20).mapping.first()
    assert (got["support"], got["coverage"]) == (20, 1.0)
    assert match_columns(s, d, "id", profile="unified", sample_rows=0).mapping.count() == 0
    assert match_columns(s, d, "id", profile="rowwise", sample_rows=0).mapping.first()["support"] == 100


def test_thresholds_are_arguments(spark):
    s, d = frames(spark, [("1", "[a, b]"), ("2", "z")], [("1", "a"), ("2", "z")])
    assert match_columns(s, d, "id", profile="fastpath", min_ratio=0.95).candidates.first()["hits"] == 1
    custom = match_columns(s, d, "id", profile="tagged", tag_thresholds={"list": 0.95}).candidates.first()
    assert (custom["hits"], custom["direct_hits"], custom["list_hits"]) == (1, 1, 0)
    none = match_columns(s, d, "id", profile="tagged", tag_thresholds={"list": 2.0, "direct": 2.0})
    assert none.mapping.count() == 0 and none.candidates.columns == R.candidate_output(get_profile("tagged"))


def test_audit_caps_and_columns(spark):
    rows = [(i, "x", "y") for i in range(30)]
    s = spark.createDataFrame(rows, "id long, s1 string, s2 string")
    d = spark.createDataFrame([(i, "x") for i in range(30)], "id long, d1 string")
    pairs = [("d1", "s2"), ("d1", "s1")]
    for name in ("containment", "unified", "hybrid", "fastpath"):
        profile = PROFILES[name]
        got = audit_cells(s, d, "id", pairs=pairs, profile=name, max_rows=20)
        assert got.columns == audit_columns(profile)
        rid = "id_c" if "id_c" in got.columns else "id"
        cells = [(r["source_col"], r[rid]) for r in got.collect()]
        if profile.audit_hits_only:
            assert cells == [("s1", str(i)) for i in range(20)]
        else:
            assert cells == [("s2", str(i)) for i in range(20)] + [("s1", str(i)) for i in range(20)]
            assert audit_cells(s, d, "id", pairs=pairs, profile=name).count() == 60


def test_labels(spark):
    def label(profile, **values):
        df = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()])
        return df.select(R.suggestion(get_profile(profile)).alias("x")).first()["x"]

    assert label("containment", avg_score=0.95) == "exact/substring match"
    assert label("unified", final=0.76) == "likely match (review)"
    assert label("unified", final=0.74) == "uncertain"
    assert [label("rowwise", avg_score=x) for x in (0.95, 0.85, 0.70, 0.69)] == [
        "exact/substring", "very likely", "likely (review)", "uncertain"
    ]
    assert label("hybrid", max_score=0.95, avg_score=0.7) == "exact match"
    assert label("longguard", max_score=0.9, avg_score=0.86) == "very likely match"
    assert label("tagged", hit_rate=0.9, avg_score=0.85) == "exact/very likely (strong coverage)"
    assert label("weighted", hit_rate=0.8, avg_score=0.72) == "likely (good coverage)"
    assert label("fastpath", hit_rate=0.5, avg_score=0.7) == "possible (review)"
    assert label("tagged", hit_rate=0.95, avg_score=0.5) == "uncertain"


@pytest.mark.parametrize("profile", ["unified", "weighted"])
def test_partitioning_changes_nothing(spark, profile):
    """Other partition counts, a shuffled input and a hot value give the same mapping."""
    base = spark.range(300).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "unknown").otherwise(F.concat(F.lit("item "), F.col("id"))).alias("v"),
    )
    s = base.select("id", F.concat(F.lit("the "), "v").alias("s1"), F.col("v").alias("s2"))
    d = base.select("id", F.upper("v").alias("d1"))
    first = match_columns(s, d, "id", profile=profile).mapping.collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = match_columns(s.orderBy(F.rand(1)), d.repartition(5), "id", profile=profile).mapping.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [tuple(r) for r in first] == [
        tuple(pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in r) for r in again
    ]


def test_pruning_keeps_every_hit(spark):
    """The same candidates with the ceiling test on and off."""
    words = ["delta", "delat", "dealt", "d", "unrelated remark", "DELTA x", "del", "x delta y z"]
    rows = [(str(i), words[i % 8], words[(i * 5 + 3) % 8]) for i in range(64)]
    s = spark.createDataFrame(rows, "id string, s1 string, s2 string")
    d = spark.createDataFrame([(r[0], words[(int(r[0]) * 3) % 8]) for r in rows], "id string, d1 string")
    for name in ("hybrid", "weighted", "tagged"):
        p = get_profile(name)
        hits = match_columns(s, d, "id", profile=p)
        full = audit_cells(s, d, "id", pairs=[("d1", "s1"), ("d1", "s2")], profile=p.replace(audit_hits_only=False), max_rows=None)
        floor = p.threshold("similarity")
        want = {r["source_col"]: (r["n"], round(r["top"], 9)) for r in full.where(F.col("score") >= floor).groupBy("source_col").agg(
            F.count("*").alias("n"), F.max("score").alias("top")).collect()}
        if hits.candidates is None:
            best = hits.mapping.first()
            assert want[best["source_col"]] == (best["support"], round(best["max_score"], 9))
        else:
            got = {r["source_col"]: (r["hits"], round(r["max_score"], 9)) for r in hits.candidates.collect()}
            assert got == want


def test_profile_lookup():
    assert len(PROFILES) == 8
    assert isinstance(get_profile("tagged", min_ratio=0.8), Profile)
    with pytest.raises(ValueError):
        get_profile("nope")


def test_ties_do_not_depend_on_how_equal_scores_were_counted(spark):
    """A thousand hits of one score weigh the same as one row of a thousand and as a thousand rows: the first column wins."""
    p = get_profile("weighted")
    rows = [(0, 0, 0.999, 1)] * 1000 + [(0, 1, 0.999, 1000)]
    scored = spark.createDataFrame(rows, "d_ord int, s_ord int, score double, n long").coalesce(1).withColumn("tag", F.lit("similarity"))
    best = R.best_sources(p, N.hit_candidates(p, N.hit_statistics(p, scored))).first()
    assert (best["s_ord"], best["weighted_score"], best["avg_score"]) == (0, 999.0, 0.999)
    means = {r["s_ord"]: r["score"] for r in N.mean_statistics(scored).collect()}
    assert means == {0: 0.999, 1: 0.999}


@pytest.mark.parametrize("backend", ["indel", "difflib"])
def test_edit_ceiling_is_above_every_score(spark, backend):
    """Random short values of few letters; the bound with edits is no looser than the one from lengths."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc1") for _ in range(rng.randint(1, 9)))
    rows = [(a, b) for a, b in ((word(), word()) for _ in range(400)) if a != b]
    p = get_profile("tagged", fuzzy_backend=backend)
    pairs = spark.createDataFrame(rows, "a string, b string").distinct().withColumn("ek", S.pair_key(F.col("a"), F.col("b")))
    a, b = F.col("a"), F.col("b")
    alike = F.arrays_overlap(X.grams(a, 3), X.grams(b, 3)).cast("double")
    score = S.element_scores(p, a, b, F.col("ratio"), F.col("partial"), F.col("lev"), alike)["score"]
    bounds = S.measure(p, pairs).select(score.alias("score"), S._ceiling(p, a, b, edits=True).alias("edits"), S._ceiling(p, a, b).alias("lengths"))
    got = bounds.where("score is not null").collect()
    assert len(got) > 300
    assert all(r.score <= r.edits + 1e-9 and r.edits <= r.lengths + 1e-9 for r in got)


def test_unlike_short_values_are_settled_on_the_row(spark):
    """Lengths alone would leave these pairs open, and send their text through a shuffle."""
    p = get_profile("weighted")
    cell = lambda text: [(0, text)]
    kind = "d_cells array<struct<ord:int,raw:string>>, s_cells array<struct<ord:int,raw:string>>"
    rows = spark.createDataFrame([(cell("customer#000000123"), cell("furniture shop 4711")), (cell("abcdefgh"), cell("abcdefgi"))], kind)
    states = S.resolve(p, A.expand_pairs(S.with_features(p, rows)), prune=True).select("state").collect()
    assert [r.state for r in states] == ["known", "open"]


def test_rows_without_alike_elements_are_misses_of_one_pass(spark):
    """Cells of several elements none of which are alike stay rows of score 0, and element pairs are read once."""
    p = get_profile("weighted")
    els = "ck long, d_ord int, s_ord int, n long, tag string, penalty double, d_els array<string>, s_els array<string>"
    rows = [
        (1, 0, 0, 2, "similarity", 1.0, ["abcdefgh", "zzzz"], ["abcdefgi", "yyyy"]),
        (2, 0, 0, 3, "similarity", 1.0, ["qqqqqqqq", "wwww"], ["eeeeeeee", "rrrr"]),
    ]
    work = Workspace(spark)
    open_rows = work.table(spark.createDataFrame(rows, els), "open")
    vocabulary = work.table(tfidf.document_frequency(spark.createDataFrame([("abcdefgh", 1)], "doc string, times long")), "vocabulary")
    scored = S.score_open(p, open_rows, vocabulary, work, prune=True)
    got = {r.ck: (r.n, r.score) for r in scored.collect()}
    assert got[2] == (3, 0.0) and got[1][0] == 2 and got[1][1] > 0.5
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 0
