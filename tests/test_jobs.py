import zipfile

import pytest

from colweave.plans.jobs import run_matching_job, run_threshold_report
from colweave.sources import readers, results

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> Name </t></is></c><c r="D1" t="str"><v>Flag</v></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="b"><v>1</v></c></row>
<row r="3"/>
<row r="4"><c r="A4"><v>2.5</v></c><c r="B4" t="inlineStr"><is><t>NA</t></is></c><c r="D4" t="e"><v>#REF!</v></c></row>
</sheetData></worksheet>"""


def workbook(path, sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="t" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets, 1))
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.writestr(
            "xl/sharedStrings.xml",
            f'<sst xmlns="{main}"><si><t>Id</t></si><si><r><t>Ada </t></r><r><t>L</t></r></si></sst>',
        )
        for i, content in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", content)


def test_workbook(spark, tmp_path):
    other = SHEET.replace("2.5", "7")
    workbook(tmp_path / "a.xlsx", {"First": SHEET, "Second": other})
    got = readers.read_table(spark, f"{tmp_path}/a.xlsx")
    assert got.columns == ["Id", "Name", "Flag"]
    assert sorted(map(tuple, got.collect())) == [("1", "Ada L", "True"), ("2.5", None, None)]
    second = readers.read_workbook(spark, f"{tmp_path}/a.xlsx", "Second")
    assert {r["Id"] for r in second.collect()} == {"1", "7"}
    workbook(tmp_path / "b.xlsx", {"First": other})
    both = readers.read_workbook(spark, f"{tmp_path}/*.xlsx", row_order=True)
    assert both.count() == 4 and readers.ROW_ORDER in both.columns
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/old.xls")


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        ' id ,"a ""x""",b\n1,"two\nlines",NA\n2,"say ""hi"", ok", NA \nn/a,,0\n', encoding="utf-8"
    )
    got = readers.read_csv(spark, f"{tmp_path}/t.csv", row_order=True)
    assert got.columns == ["id", 'a "x"', "b", readers.ROW_ORDER]
    rows = [tuple(r)[:3] for r in got.orderBy(readers.ROW_ORDER).collect()]
    assert rows == [("1", "two\nlines", None), ("2", 'say "hi", ok', " NA "), (None, None, "0")]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_job_and_report(spark, sample, tmp_path, fmt):
    source, dash = sample
    for name, df in (("s", source), ("d", dash)):
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    out = f"{tmp_path}/out"
    written = run_matching_job(
        spark, f"{tmp_path}/s.csv", f"{tmp_path}/d.csv", "Lifecycle", out_dir=out, audit=True, fmt=fmt
    )
    assert set(written) == {results.CANDIDATES, results.MAPPING, results.AUDIT}
    candidates = results.read_result(spark, out, results.CANDIDATES, fmt)
    assert dict(candidates.dtypes)["hits"] == "bigint" and candidates.count() == 5
    audit = results.read_result(spark, out, results.AUDIT, fmt)
    assert audit.where("dashboard_val = 'Apple '").count() == 4
    report = run_threshold_report(spark, out, fmt=fmt)
    assert set(report) == {results.SWEEP, results.TAG_SUMMARY}
    sweep = results.read_result(spark, out, results.SWEEP, fmt)
    assert sweep.count() == 28
    with pytest.raises(ValueError, match="run the matching job first"):
        run_threshold_report(spark, f"{tmp_path}/nowhere", fmt=fmt)


def test_preview_and_file_order(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,a,b\n" + "".join(f"{i},v{i},w\n" for i in range(15)))
    (tmp_path / "d.csv").write_text("id,x\n" + "".join(f"{i},v{i}\n" for i in range(15)))
    written = run_matching_job(
        spark, f"{tmp_path}/s.csv", f"{tmp_path}/d.csv", "id", out_dir=f"{tmp_path}/o", profile="unified",
        preview_metrics=True, fmt="parquet",
    )
    preview = results.read_result(spark, f"{tmp_path}/o", results.PREVIEW, "parquet")
    assert sorted(written) == [results.MAPPING, results.PREVIEW] and preview.count() == 15
    # Rows of a repeated id are merged in file order.
    (tmp_path / "m.csv").write_text("id,a\n1,z\n1,b\n1,m\n")
    (tmp_path / "n.csv").write_text("id,x\n1,z | b | m\n")
    run_matching_job(
        spark, f"{tmp_path}/m.csv", f"{tmp_path}/n.csv", "id", out_dir=f"{tmp_path}/p", profile="tagged",
        audit=True, fmt="parquet",
    )
    row = results.read_result(spark, f"{tmp_path}/p", results.AUDIT, "parquet").first()
    assert (row["source_val"], row["tag"]) == ("z | b | m", "listlike")


def test_workspace_is_cleaned(spark, sample):
    """Only the small statistics table outlives a run."""
    from pathlib import Path

    from colweave import match_columns
    from colweave.plans.workspace import checkpoint_root

    root = Path(checkpoint_root(spark).removeprefix("file:")) / "colweave"
    before = set(root.glob("*"))
    match_columns(*sample, "Lifecycle", profile="tagged").mapping.collect()
    (run,) = set(root.glob("*")) - before
    assert {p.name for p in run.iterdir()} == {"statistics"}
