"""Queries on empty tables, on tables with further columns whose names the operators use themselves, with nulls in any column and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import queries, residue

SCHEMAS = {
    "assaydata": "name string, uid string, chrom string, bin_idx int, copynumber int, segmented double, calls int, loaded_at timestamp",
    "pdata": "row_id long, name string, uid string, slx string, rpc double, ploidy double, loaded_at timestamp",
    "bins": "chrom string, chrom_rank int, bin_idx int",
    "documents": "doc_id long, text string, lang string, source string, sitting string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "split_targets": "split_name string, share double",
    "pack_sizes": "pack_name string, capacity_tokens int",
}
ROWS = {
    "pdata": [(i, f"U{i % 7}_SLX-{1 + i % 5}_c{i}_x", f"U{i % 7}", f"SLX-{1 + i % 5}" if i % 3 else f"SLX-{10 + i}", float(i), 2.0, None) for i in range(60)],
    "documents": [(i, f"The house met on day {i} and " + "heard the report of the committee. " * (i % 9 + 1), "en", "ab"[i % 2], f"s{i}") for i in range(60)],
    "mix_targets": [("a", 0.7, 3), ("b", 0.3, 1)],
    "split_targets": [("train", 0.8), ("test", 0.2)],
    "pack_sizes": [("small", 16), ("large", 64)],
}
OWN = ["n", "tokens", "item", "full", "rest", "pos", "size", "root", "node", "split", "shard", "block", "there", "largest", "used", "most", "k", "all", "piece_no", "capacity", "metric", "x", "t", "i", "p"]


def written(spark, folder, change=lambda t, df: df, rows=ROWS):
    for t, schema in SCHEMAS.items():
        change(t, spark.createDataFrame(rows.get(t, []), schema)).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def result(spark, name, folder):
    df = queries.QUERIES[name](spark, folder)
    return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", ["p2_found", "p2_clusters", "p4_percentiles", "p5_splits", "p6_packs", "p7_mix", "p8_found"])
def test_empty_tables(spark, tmp_path, name):
    assert result(spark, name, written(spark, tmp_path, rows={})) == []


def test_further_columns_change_nothing(spark, tmp_path):
    plain = written(spark, tmp_path / "plain")
    wide = written(spark, tmp_path / "wide", lambda t, df: df.select("*", *[F.lit("x").alias(c) for c in OWN if c not in df.columns]))
    for name in ("p4_percentiles", "p5_found", "p5_splits", "p6_packs", "p7_mix", "p7_check", "p7_shares", "p8_found"):
        assert result(spark, name, wide) == result(spark, name, plain), name


def test_nulls_in_each_column_and_repeated_rows(spark, tmp_path):
    def holes(t, df):
        if t not in ("pdata", "documents"):
            return df
        for c, kind in df.dtypes:
            df = df.unionByName(df.limit(9).withColumn(c, F.lit(None).cast(kind)))
        return df

    folder = written(spark, tmp_path, holes)
    assert spark.read.parquet(f"{folder}/documents.parquet").count() == 60 + 5 * 9
    assert len(result(spark, "p4_percentiles", folder)) == 7 * 2 * 6
    [whole] = {r.k for r in queries.p6_packs(spark, folder).groupBy("pack_name").agg(F.count_if(F.col("piece_no") == 0).alias("k")).collect()}
    assert whole == 60 + 5 * 9  # every row has its place, those without text too
    for name in ("p5_splits", "p7_mix", "p8_found"):
        result(spark, name, folder)


def test_parts_in_which_no_window_reaches_the_threshold(spark):
    docs = spark.createDataFrame([(i, f"k{i}", "The house heard the report." if i else None) for i in range(8)], "i long, kind string, t string").repartition(4)
    w = np.zeros(1 << residue.BITS, np.float32)
    assert residue.best_windows(docs, w, -3.0, 0.5, "i long, kind string").count() == 0
    assert residue.best_windows(docs, w, 3.0, 0.5, "i long, kind string").count() == 7
