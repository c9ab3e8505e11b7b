"""Writing results, and reading earlier ones back with their fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

# Output names.
MAPPING = "column_mapping"
CANDIDATES = "all_candidates"
AUDIT = "per_cell_audit"
PREVIEW = "metrics_preview"
TAG_SUMMARY = "threshold_summary_all_candidates"
SWEEP = "threshold_sweep_from_audit"

FORMATS = ("csv", "parquet")
COUNTS = ("support", "hits", "total_pairs", "direct_hits", "list_hits", "listlike_hits", "similarity_hits")
TEXTS = (
    "dashboard_col", "source_col", "id", "id_c", "dashboard_val", "source_val", "tag", "suggestion",
)


def result_path(out_dir: str, name: str, fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return f"{out_dir.rstrip('/')}/{name}.{fmt}"


def write_result(df: DataFrame, out_dir: str, name: str, fmt: str = "csv") -> str:
    """Write one result folder, replacing an earlier one."""
    path = result_path(out_dir, name, fmt)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        # Doubled quotes inside quoted cells, and blanks kept, so that cells survive the round trip.
        writer.csv(
            path, header=True, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    else:
        writer.parquet(path)
    return path


def read_result(spark: SparkSession, out_dir: str, name: str, fmt: str = "csv") -> DataFrame | None:
    """An earlier result, typed by column name; ``None`` when it was not written."""
    path = result_path(out_dir, name, fmt)
    try:
        if fmt == "parquet":
            return spark.read.parquet(path)
        raw = spark.read.csv(
            path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise

    def kind(c: str) -> str:
        return "string" if c in TEXTS else "bigint" if c in COUNTS else "int" if c.startswith("rank") else "double"

    return raw.select(*[raw[f"`{c}`"].cast(kind(c)).alias(c) for c in raw.columns])
