"""The first ids by offsets, against a sorted list."""

import pytest
from pyspark.sql import functions as F

from colweave.operators import align as A

KEYS = {
    "bigint": [5, None, 3, 11, 2, 40, -1],
    "string": ["b", None, "a", "", " ", "é", "10"],
    "double": [0.5, None, -2.0, 1e9, 3.0, 7.0, 8.0],
    "date": ["2024-01-02", None, "1999-12-31", "2024-01-01", "2030-05-05", "2000-02-29", "2010-10-10"],
}


@pytest.mark.parametrize("kind", KEYS)
def test_first_ids_in_typed_order(spark, kind):
    """Rows without an id come last; every length of the prefix, none and more than there are."""
    rows = spark.createDataFrame([(k if k is None else str(k),) for k in KEYS[kind]], "raw string")
    table = rows.select(F.col("raw").cast(kind).alias("k"), F.lit("x").alias("a"))
    aligned = A.align(A.side_table(table, "k", ["a"]), A.side_table(table, "k", ["a"]))
    want = [r[0] for r in aligned.orderBy(F.asc_nulls_last("key")).select("id").collect()]
    assert len(want) == 7 and want[-1] is None
    for n in (0, 3, 6, 9):
        got = [r[0] for r in A.sample_ids(aligned, n).orderBy(F.asc_nulls_last("key")).select("id").collect()]
        assert got == want[:n]
