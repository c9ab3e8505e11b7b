import pytest

from colweave import audit_cells, mapped_pairs, match_columns
from colweave.operators import diagnostics as D

CANDIDATES = [
    # source, hits, rate, average, weighted, percent, direct, list, listlike, similarity
    ("DBR_Att3", 15, 1.0, 0.99, 14.85, 99.0, 15, 0, 0, 0),
    ("DBR_Att4", 15, 1.0, 0.94, 14.10, 94.0, 0, 15, 0, 0),
    ("DBR_Att5", 15, 1.0, 0.90, 13.50, 90.0, 0, 0, 15, 0),
    ("DBR_Att2", 2, 2 / 15, 0.99, 1.98, 13.2, 2, 0, 0, 0),
    ("DBR_Att1", 1, 1 / 15, 0.99, 0.99, 6.6, 1, 0, 0, 0),
]


def test_sample_run(sample):
    source, dash = sample
    found = match_columns(source, dash, "Lifecycle", profile="tagged")
    rows = found.candidates.collect()
    assert [r["source_col"] for r in rows] == [c[0] for c in CANDIDATES]
    for row, want in zip(rows, CANDIDATES):
        assert row["total_pairs"] == 15
        got = [row[c] for c in (
            "hits", "hit_rate", "avg_score", "weighted_score", "score_pct",
            "direct_hits", "list_hits", "listlike_hits", "similarity_hits",
        )]
        assert got == pytest.approx(list(want[1:]), abs=1e-9)
    (best,) = found.mapping.collect()
    assert (best["dashboard_col"], best["source_col"]) == ("Att1", "DBR_Att3")
    assert best["suggestion"] == "exact/very likely (strong coverage)"

    audit = audit_cells(source, dash, "Lifecycle", pairs=mapped_pairs(found.mapping), profile="tagged")
    cells = audit.collect()
    assert [c["id"] for c in cells] == sorted(f"L{i}" for i in range(1, 16))
    assert {(c["score"], c["tag"]) for c in cells} == {(0.99, "direct")}
    assert cells[0]["dashboard_val"] == "Apple "  # values as written

    summary = {r["Tag"]: tuple(r)[1:] for r in D.tag_summary(found.candidates).collect()}
    assert summary["direct_hits"] == (18, 0.70, 37.5)
    assert summary["similarity_hits"] == (0, 0.45, 0.0)
    sweep = D.threshold_sweep(audit).collect()
    assert len(sweep) == 28
    assert {(r["hits"], r["rows_considered"]) for r in sweep if r["tag"] == "direct"} == {(15, 15)}
    assert {(r["hits"], r["rows_considered"]) for r in sweep if r["tag"] == "list"} == {(0, 0)}


def test_sweep_grid():
    grid = D.sweep_grid()
    assert [len(grid[t]) for t in ("direct", "list", "listlike", "similarity")] == [5, 5, 5, 13]
    assert grid["similarity"][0] == 0.3 and grid["similarity"][-1] == 0.6
    wide = D.sweep_grid({})
    assert wide["similarity"][0] == 0.45 and wide["similarity"][-1] == 0.75


def test_diagnostics_checks(spark):
    with pytest.raises(ValueError):
        D.tag_summary(spark.createDataFrame([(1,)], ["hits"]))
    with pytest.raises(ValueError):
        D.threshold_sweep(spark.createDataFrame([(1.0,)], ["score"]))
