"""Orphan references: every reason, odd forms and null values."""

from datetime import datetime

from pyspark.sql import functions as F

from seriesloom.operators.references import orphan_references, parent_validity, path_key, plain_key
from seriesloom.operators.skew import hot_keys, salted_join

T = [datetime(2024, m, 1) for m in range(1, 13)]


def parents(spark, rows):
    return parent_validity(spark.createDataFrame(rows, "name string, loaded timestamp, removed timestamp, reason string"), plain_key(F.col("name")), "loaded", "removed")


def refs(spark, rows):
    return spark.createDataFrame(rows, "row_id long, raw string, at timestamp").select(F.lit("t").alias("src_table"), "row_id", path_key(F.col("raw")).alias("ref_key"), "at")


def test_reasons(spark):
    p = parents(spark, [("A_1 ", T[2], None, "x"), ("b", T[1], T[3], "x"), ("b", T[4], T[5], "x"), ("c", T[1], T[2], "x"), ("c", T[6], None, "x"), (None, T[0], None, "x"), (" ", T[0], None, "x"), ("d", None, None, "x")])
    r = refs(spark, [(1, "/x/y/a_1.bam", T[3]), (2, "D:\\q\\A_1.sorted.bam", T[1]), (3, "b", T[2]), (4, " C.cram ", T[1]), (5, "nope.bam", T[1]), (6, None, T[1]), (7, "d", None), (8, "c", T[0]), (9, "zz", None), (10, "c", T[1])])
    got = {(x.row_id, x.period, x.reason) for x in orphan_references(r, p).collect()}
    assert got == {(2, "2024-02", "late"), (3, "2024-03", "deleted"), (5, "2024-02", "missing"), (8, "2024-01", "late"), (9, None, "missing")}


def test_no_parents_and_no_references(spark):
    assert [x.reason for x in orphan_references(refs(spark, [(1, "a", T[0]), (1, "a", T[0])]), parents(spark, [])).collect()] == ["missing", "missing"]
    assert orphan_references(refs(spark, []), parents(spark, [("a", T[0], None, "")])).count() == 0


def test_a_key_with_a_third_of_all_references_is_split(spark):
    from pyspark.sql.functions import lit

    hot = spark.range(300_000).select(F.lit("t").alias("src_table"), F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(lit("k"), F.col("id"))).alias("ref_key"), F.lit(T[1]).alias("at"))
    p = parents(spark, [("hot", T[0], T[1], "")]).unionByName(spark.range(50_000).select(F.concat(lit("k"), F.col("id")).alias("ref_key"), F.lit(T[0]).alias("since"), F.lit(True).alias("alive")))
    assert [r.ref_key for r in hot_keys(hot, "ref_key").collect()] == ["hot"]
    assert orphan_references(hot, p).count() == 100_000 + sum(1 for i in range(50_000, 300_000) if i % 3)
    dealt = salted_join(hot, p, "ref_key", "row_id")
    assert dealt.count() == 300_000 and dealt.where("alive is null").count() == sum(1 for i in range(50_000, 300_000) if i % 3)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [ref_key" in plan and "_salt" in plan
