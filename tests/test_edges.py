"""Core queries on empty tables and on tables with further columns whose names the operators use themselves."""

import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom.plans import intervals, kernels, problems

T0 = datetime.datetime(2024, 1, 1)
LATE = T0 + datetime.timedelta(days=40)
SCHEMAS = {
    "centromere": "row_id long, assembly string, c1 string, c2 long, c3 long, c4 string, c5 string, loaded_at timestamp",
    "pdata": "row_id long, name string, uid string, slx string, is_paired boolean, bin_size int, read_size double, used_reads long, coverage double, observed_variance double, rpc double, ploidy double, gini double, mapd double, loaded_at timestamp, removed_at timestamp",
    "cellcycle_info": "info_id long, uid string, slx string, filename string, cellcycle string, quality double, s_phase_prob double, recorded_at timestamp",
    "flagstat": "flag_id long, name string, recorded_at timestamp",
}


def cell(i, name, at=T0, removed=None):
    return (i, name, "U", "SLX-1", True, 100, 50.0, 9, 1.0, 1.0, 1.0, 2.0, 0.1, 0.1, at, removed)


ROWS = {
    "centromere": [(1, "a", "chr1", 0, 10, "p", "g", T0), (2, "a", "1", 5, 20, "p", "g", T0), (3, "a", " CHR1", 30, 40, "q", "g", T0), (4, "a", "1", None, 40, "q", "g", T0), (5, None, "2", 1, 2, "q", "g", T0)],
    "pdata": [cell(1, "here"), cell(2, "Gone ", T0, T0), cell(3, "late", LATE), cell(4, None)],
    "cellcycle_info": [(i, "U", "S", f, "S", 1.0, 0.5, T0) for i, f in enumerate(["x/HERE.bam", "x\\gone.b.c", "late", "none", " ", None])],
    "flagstat": [(7, "none", None)],
}
QUERIES = problems.QUERIES | intervals.QUERIES | kernels.QUERIES


def written(spark, folder, change=lambda df: df, rows=ROWS):
    for t, schema in SCHEMAS.items():
        change(spark.createDataFrame(rows.get(t, []), schema)).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def result(spark, name, folder):
    df = QUERIES[name](spark, folder)
    return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_report", "coverage_steps", "coverage_peaks", "interval_reduce", "phase_forest"])
def test_empty_tables(spark, tmp_path, name):
    assert result(spark, name, written(spark, tmp_path, rows={})) == []


def test_further_columns_change_nothing(spark, tmp_path):
    own = ["start", "end", "kind", "tile", "key", "ref_key", "src_table", "at", "raw", "period", "reason", "salt", "first", "chrom", "parent", "_part"]
    plain = written(spark, tmp_path / "plain")
    wide = written(spark, tmp_path / "wide", lambda df: df.select("*", *[F.lit("x").alias(c) for c in own]))
    for name in ("p1_found", "p3_found", "p3_report"):
        assert result(spark, name, wide) == result(spark, name, plain), name
    assert [(r.kind, r.start_bp, r.end_bp) for r in problems.p1_found(spark, wide).orderBy("start_bp").collect()] == [("period", 0, 20), ("gap", 20, 30), ("period", 30, 40)]
    assert {(r.src_table, r.row_id, r.reason) for r in problems.p3_found(spark, wide).collect()} == {("cellcycle_info", 1, "deleted"), ("cellcycle_info", 2, "late"), ("cellcycle_info", 3, "missing"), ("flagstat", 7, "missing")}


def test_a_forest_without_cells_of_the_other_half(spark, tmp_path):
    folder = written(spark, tmp_path, rows={"pdata": [cell(1, "one")], "cellcycle_info": [(1, "U", "S", "one", "S", 1.0, 0.5, T0)]})
    [row] = kernels.phase_forest(spark, folder).collect()
    assert (row.cell, row.p_s) == ("one", None)
