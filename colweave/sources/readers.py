"""Table readers: CSV, workbooks and earlier results.  Every cell is read as text."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.align import quoted

# Executors need no copy of this package: the workbook parser travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts that stand for a missing cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WORKBOOK_SUFFIXES = (".xlsx", ".xls")
ROW_ORDER = "__row"

ROW_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("cells", T.MapType(T.IntegerType(), T.StringType())),
    ]
)


def null_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Missing-value texts become null in every string column."""

    def clean(name: str, kind: str) -> Column:
        c = quoted(name)
        return F.when(c.isin(*tokens), None).otherwise(c).alias(name) if kind == "string" else c

    return df.select(*[clean(n, k) for n, k in df.dtypes])


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    na_tokens: Sequence[str] = NA_TOKENS,
    trim: bool = True,
    row_order: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """CSV as text columns.

    ``row_order`` adds the column ``__row``, the position in the files, to order
    the rows of a repeated id.  ``multiline=False`` lets Spark split large files
    whose cells hold no line breaks.
    """
    df = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multiline, escape='"', quote='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="",
    )
    if trim:
        df = trim_headers(df)
    df = null_tokens(df, na_tokens)
    if row_order:
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        df = df.withColumn(ROW_ORDER, place)
    return df


# ---- workbooks ------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    """Text of a string item, phonetic hints left out."""
    parts = []
    for child in node:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts.append(_texts(child))
    return "".join(parts)


def _sheet_file(book: zipfile.ZipFile, sheet: str | None) -> str:
    """Path of the named sheet inside the archive, or of the first one."""
    sheets = [
        (node.get("name"), next(v for k, v in node.attrib.items() if _local(k) == "id"))
        for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter()
        if _local(node.tag) == "sheet"
    ]
    wanted = [ref for name, ref in sheets if sheet is None or name == sheet]
    if not wanted:
        raise ValueError(f"workbook has no sheet {sheet!r}; it has {[n for n, _ in sheets]}")
    for node in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if node.get("Id") == wanted[0]:
            target = node.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"sheet {sheet!r} has no file")


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_texts(n) for n in cell if _local(n.tag) == "is"), None)
    value = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    return None if kind == "e" else value


def workbook_rows(content: bytes, sheet: str | None) -> Iterator[tuple[int, dict[int, str]]]:
    """Rows of one sheet as (row number, cells by column), streamed from the XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_texts(item) for item in root]
        with book.open(_sheet_file(book, sheet)) as stream:
            number = 0
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", number + 1))
                cells = {}
                for place, cell in enumerate(n for n in node if _local(n.tag) == "c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else place
                    text = _cell_text(cell, shared)
                    if text is not None:
                        cells[at] = text
                yield number, cells
                node.clear()


def read_workbook(
    spark: SparkSession,
    path: str | list[str],
    sheet: str | None = None,
    *,
    na_tokens: Sequence[str] = NA_TOKENS,
    trim: bool = True,
    row_order: bool = False,
) -> DataFrame:
    """One sheet (default: the first) of each workbook, read in parallel over the files.

    All workbooks must carry the header of the first one in path order.  Rows
    without any cell are skipped.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                chunk = []
                for number, cells in workbook_rows(content, sheet):
                    if cells:
                        chunk.append((name, number, cells))
                    if len(chunk) == 10_000:
                        yield pd.DataFrame(chunk, columns=["path", "row", "cells"])
                        chunk = []
                yield pd.DataFrame(chunk, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, ROW_SCHEMA)
    first_file = files.orderBy("path").limit(1)
    header = first_file.mapInPandas(parse, ROW_SCHEMA).orderBy("row").select("cells").first()
    if header is None:
        raise ValueError(f"no rows in {path!r}")
    names = {i: n.strip() if trim else n for i, n in sorted(header["cells"].items())}
    top = rows.groupBy("path").agg(F.min("row").alias("top"))
    data = rows.join(top, "path").where("row > top")
    columns = [F.col("cells")[F.lit(i)].alias(n) for i, n in names.items()]
    place = [F.struct("path", "row").alias(ROW_ORDER)] if row_order else []
    return null_tokens(data.select(*columns, *place), na_tokens)


def read_table(
    spark: SparkSession,
    path: str,
    sheet: str | None = None,
    *,
    row_order: bool = False,
    trim: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """A workbook by its suffix, parquet by its suffix, anything else as CSV."""
    lower = path.lower()
    if lower.endswith(".xls"):
        raise ValueError(f"{path}: save the legacy binary workbook as .xlsx or CSV first")
    if lower.endswith(WORKBOOK_SUFFIXES):
        return read_workbook(spark, path, sheet, row_order=row_order, trim=trim)
    if lower.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return trim_headers(df) if trim else df
    return read_csv(spark, path, row_order=row_order, trim=trim, multiline=multiline)

