import re

import pytest
from pyspark.sql import functions as F

from colweave import audit_cells, match_columns
from colweave.operators import align as A


def merged_rows(table):
    return {r["id"]: [c["raw"] for c in r["cells"]] for r in table.collect()}


ROWS = [
    (1, 3, "Apple", " "),
    (1, 1, " Pear ", None),
    (1, 2, None, "x"),
    (2, 1, None, None),
    (None, 2, "b", "y"),
    (None, 1, "a", ""),
]


@pytest.mark.parametrize("hot_rows", [100, 1])
def test_merge(spark, hot_rows):
    """Ordered, blanks dropped, values untrimmed, nulls to empty text; hot ids give the same."""
    df = spark.createDataFrame(ROWS, "id long, o int, a string, b string")
    got = merged_rows(A.merge_duplicates(df, "id", ["a", "b"], ["o"], hot_rows=hot_rows))
    assert got == {"1": [" Pear  | Apple", "x"], "2": ["", ""], None: ["a | b", "y"]}
    dropped = A.merge_duplicates(df, "id", ["a"], ["o"], null_ids="drop", hot_rows=hot_rows)
    assert set(merged_rows(dropped)) == {"1", "2"}


def test_hot_id_is_merged_in_pieces(spark):
    """A third of the rows on one id: joined per range of the order, to the same cell."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        "id",
        F.concat(F.lit("v"), F.col("id")).alias("v"),
    )
    got = merged_rows(A.merge_duplicates(df.repartition(7), "k", ["v"], ["id"], hot_rows=50))
    assert got["hot"] == [" | ".join(f"v{i}" for i in range(0, 3000, 3))]
    assert len(got) == 2001 and got["1"] == ["v1"]


def test_null_ids_meet(spark):
    s = spark.createDataFrame([(None, "x"), ("1", "y")], "k string, a string")
    d = spark.createDataFrame([(None, "x"), ("2", "y")], "k string, b string")
    got = audit_cells(s, d, "k", pairs=[("b", "a")], profile="tagged").collect()
    assert [(r["id"], r["tag"]) for r in got] == [(None, "direct")]
    assert audit_cells(s, d, "k", pairs=[("b", "a")], profile="tagged", null_ids="drop").count() == 0


def test_ids_compare_as_text(spark):
    s = spark.createDataFrame([(1, "x")], "k long, a string")
    d = spark.createDataFrame([("1", "x")], "rid string, b string")
    row = match_columns(s, d, "k", "rid", profile="tagged").mapping.first()
    assert (row["dashboard_col"], row["source_col"], row["hits"]) == ("b", "a", 1)


def test_no_common_id(spark):
    s = spark.createDataFrame([("1", "x")], "k string, a string")
    d = spark.createDataFrame([("2", "x")], "k string, b string")
    for profile in ("containment", "rowwise", "tagged"):
        with pytest.raises(ValueError, match="no common ids"):
            match_columns(s, d, "k", profile=profile)
    for profile in ("containment", "unified"):
        with pytest.raises(ValueError, match="no common ids"):
            audit_cells(s, d, "k", pairs=[("b", "a")], profile=profile)
    for profile in ("rowwise", "fastpath"):
        empty = audit_cells(s, d, "k", pairs=[("b", "a")], profile=profile)
        assert empty.count() == 0 and "score" in empty.columns


def test_missing_columns_and_repeated_ids(spark):
    s = spark.createDataFrame([("1", "x"), ("1", "y")], "k string, a string")
    d = spark.createDataFrame([("1", "x")], "k string, b string")
    with pytest.raises(ValueError, match="no column 'nope'"):
        match_columns(s, d, "nope")
    with pytest.raises(ValueError, match="unique ids"):
        match_columns(s, d, "k", profile="rowwise")
    merged = match_columns(s, d, "k", profile="rowwise", merge_duplicates=True).mapping.first()
    assert merged["support"] == 1
    with pytest.raises(ValueError, match="unknown column pair"):
        audit_cells(s, d, "k", pairs=[("b", "zz")], profile="tagged")
    unique = s.where("a = 'x'")
    # Elsewhere an unknown column counts as all null.
    assert audit_cells(unique, d, "k", pairs=[("b", "zz")], profile="unified").count() == 0
    assert audit_cells(unique, d, "k", pairs=[("b", "zz"), ("b", "a")], profile="containment").count() == 1


def test_one_exchange_per_side(spark, tmp_path):
    """Merging, joining and expanding shuffle each table once."""
    for name in ("s", "d"):
        spark.range(1000).select("id", F.col("id").cast("string").alias(f"{name}1")).write.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sides = [A.merge_duplicates(spark.read.parquet(f"{tmp_path}/{n}"), "id", [f"{n}1"]) for n in ("s", "d")]
        plan = A.expand_pairs(A.align(*sides))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Generate explode") == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranges_of_a_hot_id_are_not_gathered_by_their_bytes(spark):
    """Ranges are dealt to a given number of tasks; tasks merged by their bytes would get them all."""
    owner = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    df = spark.range(600).select(owner.alias("k"), "id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    merged = A.merge_duplicates(df, "k", ["v"], ["id"], hot_rows=50, tasks=12)
    assert merged_rows(merged)["hot"] == [" | ".join(f"v{i}" for i in range(0, 600, 3))]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[rid#\d+, range#\d+\], 12", plan)
