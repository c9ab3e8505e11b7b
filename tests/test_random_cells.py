"""Every profile on awkward random cells, against the plain SQL version of the scorers."""

import random

import duckdb
import pytest

from checks import oracles as O
from checks.compare import rows_of
from checks.catalog import rounded
from colweave import PROFILES, audit_cells, match_columns

DASH, SRC = ["red", "green", "blue"], ["one", "two", "three", "four"]
WORDS = ["alpha", "beta", "gamma ray", "nan", "a", "ab", "x-1", "c++", "(q)", "Delta", "del ta", "alpha beta"]
# Sixteen words count as long text; the SQL version holds a value in the bits of one integer.
LONG = "a bit of it is on us as to at by we do go in no"


def awkward_cell(rng):
    word = lambda: rng.choice(WORDS)
    return rng.choice([
        lambda: None,
        lambda: "",
        lambda: "  ",
        lambda: "[]",
        lambda: ",;",
        lambda: "( \tx )",
        word,
        word,
        word,
        lambda: f" {word().upper()}  ",
        lambda: f"{word()}, {word()}",
        lambda: f"{word()} | {word()};{word()}",
        lambda: f"[{word()}, {word()}]",
        lambda: "{" + f"{word()},'',{word()}" + "}",
        lambda: f"({word()})",
        lambda: f"{LONG} {word()}",
        lambda: LONG,
        lambda: f"{word()}  {word()}",
    ])()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    source = [(i, *[awkward_cell(rng) for _ in SRC]) for i in range(60)]
    dash = []
    for i in range(10, 75):
        cells = [awkward_cell(rng) for _ in DASH]
        if i < 60 and rng.random() < 0.4:
            cells[0] = source[i][1]  # some true matches
        dash.append((i, *cells))
    root = tmp_path_factory.mktemp("cells")
    con = duckdb.connect()
    frames = {}
    for name, cols, rows in (("src", SRC, source), ("dash", DASH, dash)):
        frames[name] = spark.createDataFrame(rows, "rid long, " + ", ".join(f"{c} string" for c in cols))
        frames[name].write.parquet(f"{root}/{name}")
        frames[name] = spark.read.parquet(f"{root}/{name}")
        con.execute(f"create view {name}_file as select * from read_parquet('{root}/{name}/*.parquet')")
    pieces = [
        "dash as (select rid::varchar as id, rid as key, red, green, blue from dash_file)",
        "src as (select rid::varchar as id, one, two, three, four from src_file)",
        O.long_cells("dash", DASH, "dcells", ", key"),
        O.long_cells("src", SRC, "scells"),
    ]
    return frames, con, pieces


def check(df, con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rounded(df).collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("profile", PROFILES)
def test_cells(tables, profile):
    frames, con, pieces = tables
    pairs = [(d, s) for d in DASH for s in SRC]
    got = audit_cells(frames["src"], frames["dash"], "rid", pairs=pairs, profile=profile, max_rows=None)
    where = f" where {O.hit(profile)}" if profile == "fastpath" else ""
    check(got, con, O.with_(
        O.scored(profile, pieces),
        f"select id as {O.id_name(profile)}, dashboard_col, source_col, dv as dashboard_val, sv as source_val, "
        f"{', '.join(O.score_columns(profile))} from scored{where}",
    ))


@pytest.mark.parametrize("profile", PROFILES)
def test_mapping(tables, profile):
    frames, con, pieces = tables
    found = match_columns(frames["src"], frames["dash"], "rid", profile=profile)
    check(found.mapping, con, O.mapping(profile, pieces))
    if found.candidates is not None:
        check(found.candidates, con, O.candidates(profile, pieces))
