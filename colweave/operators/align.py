"""Bring two tables together by row id and expand them to column-pair cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank
from ..plans.workspace import Workspace, task_count

MERGE_GLUE = " | "  # fixed value
#: Rows per id from which its merge is split over tasks.
HOT_ROWS = 200_000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def candidate_columns(df: DataFrame, id_col: str, order_by: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != id_col and c not in order_by]


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(map(repr, missing))}")


def _cells(columns: Sequence[str]) -> Column:
    if not columns:
        return F.array().cast("array<struct<ord:int,raw:string>>")
    return F.array(
        *[
            F.struct(F.lit(i).alias("ord"), quoted(c).cast("string").alias("raw"))
            for i, c in enumerate(columns)
        ]
    )


def _identified(df: DataFrame, id_col: str, null_ids: str, *rest: Column) -> DataFrame:
    """Rows with ``id`` as text, ``key`` as typed (for ordering) and ``rid``, never null.

    Joining and grouping on ``rid`` lets a null id meet a null id by plain equality.
    """
    if null_ids not in ("match", "drop"):
        raise ValueError("null_ids must be 'match' or 'drop'")
    if null_ids == "drop":
        df = df.where(quoted(id_col).isNotNull())
    text = quoted(id_col).cast("string")
    rid = F.coalesce(F.concat(F.lit("="), text), F.lit(""))
    return df.select(rid.alias("rid"), text.alias("id"), quoted(id_col).alias("key"), *rest)


def _by_id(df: DataFrame, tasks: int) -> DataFrame:
    """The one exchange of a side: merging and joining by id both reuse it.

    The partition number is explicit, as the work after the join (every column
    pair of every row) is CPU that AQE would not see in the bytes of this shuffle.
    """
    return df.repartition(tasks, "rid")


def side_table(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    null_ids: str = "match",
    tasks: int | None = None,
) -> DataFrame:
    """``rid``, ``id``, ``key`` and the candidate cells as text, in ``tasks`` partitions by id.

    Tables to be joined want the same ``tasks`` (default: by their own size).
    """
    cells = _identified(df, id_col, null_ids, _cells(columns).alias("cells"))
    return _by_id(cells, tasks or task_count(df))


def require_unique_ids(df: DataFrame, id_col: str, what: str, null_ids: str = "match") -> None:
    ids = _identified(df, id_col, null_ids).groupBy("rid").count()
    if not ids.where("count > 1").isEmpty():
        raise ValueError(
            f"{what} repeats an id; this profile needs unique ids (or pass merge_duplicates=True)"
        )


def _join_rows(rows: Column, column: str) -> Column:
    """Non-blank values of one column over the sorted rows of an id, untrimmed."""
    values = F.transform(rows, lambda r: r[column])
    kept = F.filter(values, lambda v: ~is_blank(v))
    return F.array_join(kept, MERGE_GLUE)


def merge_duplicates(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    order_by: Sequence[str] = (),
    null_ids: str = "match",
    hot_rows: int = HOT_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """One row per id; each cell joins the id's non-blank values in ``order_by`` order.

    Spark has no file order, so without ``order_by`` the values themselves give it.
    Ids with more than ``hot_rows`` rows are first joined per range of the order,
    so no task ever holds all the rows of such an id, only its finished cell.
    """
    names = [f"c{i}" for i in range(len(columns))]
    order = [quoted(c).alias(f"o{i}") for i, c in enumerate(order_by)]
    texts = [quoted(c).cast("string").alias(n) for c, n in zip(columns, names)]
    fields = order + texts or [F.lit(0).alias("o")]
    rows = _identified(df, id_col, null_ids, F.struct(*fields).alias("row"))
    hot = rows.groupBy("rid").count().where(F.col("count") > hot_rows).select("rid")
    tasks = tasks or task_count(df)
    if hot.isEmpty():
        return _merge_small(rows, names, tasks)
    cold = _merge_small(rows.join(hot, "rid", "left_anti"), names, tasks)
    return cold.unionByName(_merge_hot(rows.join(hot, "rid", "left_semi"), names, tasks))


def _cell_array(names: Sequence[str], cell) -> Column:
    if not names:
        return _cells([])
    return F.array(
        *[F.struct(F.lit(i).alias("ord"), cell(n).alias("raw")) for i, n in enumerate(names)]
    )


def _gather(row: str) -> list[Column]:
    return [
        F.first("id").alias("id"),
        F.min("key").alias("key"),
        F.sort_array(F.collect_list(row)).alias("rows"),
    ]


def _joined_cells(names: Sequence[str]) -> Column:
    return _cell_array(names, lambda n: _join_rows(F.col("rows"), n)).alias("cells")


def _merge_small(rows: DataFrame, names: Sequence[str], tasks: int) -> DataFrame:
    merged = _by_id(rows, tasks).groupBy("rid").agg(*_gather("row"))
    return merged.select("rid", "id", "key", _joined_cells(names))


def _merge_hot(rows: DataFrame, names: Sequence[str], tasks: int) -> DataFrame:
    ranged = rows.repartitionByRange(tasks, "rid", "row").withColumn("range", F.spark_partition_id())
    pieces = (
        # By an explicit number: tasks merged by their bytes would gather many ranges, and all their rows as objects.
        ranged.repartition(tasks, "rid", "range")
        .groupBy("rid", "range")
        .agg(*_gather("row"))
        .select("rid", "range", "id", "key", *[_join_rows(F.col("rows"), n).alias(n) for n in names])
    )
    piece = F.struct("range", *names).alias("piece")
    whole = pieces.select("rid", "id", "key", piece).groupBy("rid").agg(*_gather("piece"))
    return whole.select("rid", "id", "key", _joined_cells(names))


def align(source: DataFrame, dash: DataFrame) -> DataFrame:
    """Inner join of two side tables on the id as text; a null id meets a null id."""
    s = source.select("rid", F.col("cells").alias("s_cells"))
    d = dash.select("rid", "id", "key", F.col("cells").alias("d_cells"))
    return d.join(s, "rid").drop("rid")


def has_common_ids(source: DataFrame, dash: DataFrame) -> bool:
    return not dash.select("rid").join(source.select("rid"), "rid", "left_semi").isEmpty()


def sample_ids(aligned: DataFrame, n: int) -> DataFrame:
    """The first ``n`` aligned rows in id order: those up to the ``n``-th id.

    That id is found by offsets: the ids alone are dealt out by ranges, the driver adds
    up one count per range, and one range is looked into.  No task holds more than its range.
    """
    if n <= 0:
        return aligned.limit(0)
    names = ["last", "key", "id"]  # rows without an id come last
    place = [F.col("key").isNull().alias("last"), F.col("key"), F.col("id")]
    work = Workspace(aligned.sparkSession)
    ranged = aligned.select(*place).repartitionByRange(task_count(aligned), *names)
    ids = work.table(ranged.withColumn("part", F.spark_partition_id()), "ids")
    before, cut = 0, None
    for part, rows in sorted(ids.groupBy("part").count().collect()):
        if before + rows >= n:
            first = ids.where(F.col("part") == part).orderBy(*names).limit(n - before)
            cut = first.agg(F.max(F.struct(*names))).first()[0]
            break
        before += rows
    work.drop()
    if cut is None:
        return aligned
    nth = [F.lit(v).cast(ids.schema[c].dataType).alias(c) for c, v in zip(names, cut)]
    return aligned.where(F.struct(*place) <= F.struct(*nth))


def expand_pairs(aligned: DataFrame, *keep: str) -> DataFrame:
    """Every dashboard cell beside every source cell of its row.

    Two generators on the joined row: no second shuffle, and a plan that grows
    with the number of columns rather than with their product.
    """
    one = aligned.select(*keep, F.explode("d_cells").alias("d"), "s_cells")
    return one.select(*keep, "d", F.explode("s_cells").alias("s"))
