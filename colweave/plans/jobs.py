"""Batch jobs: tables in, result folders out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from ..operators import diagnostics as D
from ..sources import readers, results
from .matching import audit_cells, mapped_pairs, match_columns
from .profiles import TAG_THRESHOLDS, Profile, get_profile

PREVIEW_ROWS = 200  # fixed value


def run_matching_job(
    spark: SparkSession,
    source_path: str,
    dashboard_path: str,
    id_source: str,
    id_dash: str | None = None,
    out_dir: str = "./out",
    profile: str | Profile = "tagged",
    *,
    source_sheet: str | None = None,
    dash_sheet: str | None = None,
    audit: bool = False,
    audit_rows: int | None = None,
    preview_metrics: bool = False,
    sample_rows: int | None = None,
    fmt: str = "csv",
    multiline: bool = True,
    source_order: Sequence[str] = (),
    dash_order: Sequence[str] = (),
    **changes,
) -> dict[str, str]:
    """Read two tables, match their columns and write the results; returns their paths by name.

    Rows of a repeated id are merged by the given order columns, in CSV by default
    in file order.  The audit covers all chosen pairs; ``audit_rows`` bounds each
    pair's rows.  The preview is the start of the audit of the best pair.  With
    ``multiline=False`` Spark splits large CSV files, whose cells then hold no line
    breaks.
    """
    p = get_profile(profile)
    trim = p.scorer != "containment"  # that profile takes headers as written

    def load(path, sheet, order):
        by_file = p.merge_duplicates and not order
        df = readers.read_table(spark, path, sheet, row_order=by_file, trim=trim, multiline=multiline)
        return df, [readers.ROW_ORDER] if readers.ROW_ORDER in df.columns else order

    source, source_order = load(source_path, source_sheet, source_order)
    dash, dash_order = load(dashboard_path, dash_sheet, dash_order)
    sides = dict(source_order=source_order, dash_order=dash_order, **changes)
    found = match_columns(
        source, dash, id_source, id_dash, p, sample_rows=sample_rows, **sides
    )
    written = {results.MAPPING: results.write_result(found.mapping, out_dir, results.MAPPING, fmt)}
    if found.candidates is not None:
        written[results.CANDIDATES] = results.write_result(found.candidates, out_dir, results.CANDIDATES, fmt)
    if not (audit or preview_metrics):
        return written
    pairs = mapped_pairs(found.mapping)
    sides.pop("one_to_one", None)

    def write_audit(name: str, chosen: Sequence[tuple[str, str]], rows: int | None) -> None:
        cells = audit_cells(source, dash, id_source, id_dash, chosen, p, max_rows=rows, **sides)
        written[name] = results.write_result(cells, out_dir, name, fmt)

    if audit and pairs:
        write_audit(results.AUDIT, pairs, audit_rows)
    if preview_metrics and pairs:
        write_audit(results.PREVIEW, pairs[:1], PREVIEW_ROWS)
    return written


def run_threshold_report(
    spark: SparkSession,
    out_dir: str,
    tag_thresholds: Mapping[str, float] = TAG_THRESHOLDS,
    grid: Mapping[str, Sequence[float]] | None = None,
    fmt: str = "csv",
) -> dict[str, str]:
    """Tag summary of saved candidates and, when an audit was saved, its threshold sweep."""
    candidates = results.read_result(spark, out_dir, results.CANDIDATES, fmt)
    if candidates is None:
        raise ValueError(f"no {results.CANDIDATES} in {out_dir}; run the matching job first")
    summary = D.tag_summary(candidates, tag_thresholds)
    written = {results.TAG_SUMMARY: results.write_result(summary, out_dir, results.TAG_SUMMARY, fmt)}
    audit = results.read_result(spark, out_dir, results.AUDIT, fmt)
    if audit is not None and {"score", "tag"} <= set(audit.columns):
        sweep = D.threshold_sweep(audit, tag_thresholds, grid)
        written[results.SWEEP] = results.write_result(sweep, out_dir, results.SWEEP, fmt)
    return written
