"""Cleaned tables that many queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.util import finite, spread_by, table

BIN_COLUMNS = ["chrom_rank", "start_pos", "end_pos", "gc", "mappability", "usable", "replication_timing"]


def signal(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """Latest delivery of each (name, chrom, bin_idx) of assaydata with the annotations of its bin. ``by`` is the key on which the table is dealt out first, for plans whose later groups all hold it: they need no further shuffle."""
    a = table(spark, d, "assaydata")
    a = (spread_by(a, [by]) if by else a).groupBy("name", "chrom", "bin_idx")
    latest = a.agg(F.max(F.struct("loaded_at", "copynumber", "segmented", "calls", "uid")).alias("x")).select("name", "chrom", "bin_idx", "x.copynumber", "x.segmented", "x.calls", "x.uid")
    bins = table(spark, d, "bins").select("chrom", "bin_idx", *BIN_COLUMNS)  # fixed catalogue
    return latest.join(F.broadcast(bins), ["chrom", "bin_idx"])


SIGNAL = """
with sig as (
 select a.name, a.chrom, a.bin_idx, a.copynumber, a.segmented, a.calls, a.uid, b.chrom_rank, b.start_pos, b.end_pos, b.gc, b.mappability, b.usable, b.replication_timing
 from (select *, row_number() over (partition by name, chrom, bin_idx order by loaded_at desc nulls last, copynumber desc nulls last, segmented desc nulls last, calls desc nulls last, uid desc nulls last) rn from assaydata) a
 join bins b on a.chrom = b.chrom and a.bin_idx = b.bin_idx where rn = 1)
"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Latest standing row of each cell of pdata: name (lower case), uid (upper case) and its measures, non-finite ones null."""
    p = table(spark, d, "pdata").where("removed_at is null and name is not null")
    p = p.withColumn("cell", F.lower(F.trim("name")))
    rest = ["row_id", "uid", "slx", "is_paired", "bin_size", "read_size", "used_reads", "coverage", "observed_variance", "rpc", "ploidy", "gini", "mapd"]
    m = p.groupBy("cell").agg(F.max(F.struct("loaded_at", *rest)).alias("x")).select("cell", "x.*")
    m = m.withColumn("uid", F.upper(F.trim("uid")))
    for c in ("read_size", "coverage", "observed_variance", "rpc", "ploidy", "gini", "mapd"):
        m = m.withColumn(c, finite(F.col(c)))
    return m


CELLS = """
with cells as (
 select cell, loaded_at, row_id, upper(trim(uid)) uid, slx, is_paired, bin_size, used_reads,
  {} from
 (select *, lower(trim(name)) cell, row_number() over (partition by lower(trim(name)) order by loaded_at desc nulls last, row_id desc nulls last) rn from pdata where removed_at is null and name is not null)
 where rn = 1)
""".format(", ".join(f"case when isfinite({c}) then {c} end {c}" for c in ("read_size", "coverage", "observed_variance", "rpc", "ploidy", "gini", "mapd")))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows of centromere as closed 1-based ranges (chrom cleaned, start = c2 + 1)."""
    from seriesloom.plans.problems import chrom_name

    c = table(spark, d, "centromere").where("c2 is not null and c3 is not null and c3 > c2 and assembly is not null")
    x = c.select("row_id", "assembly", chrom_name(F.col("c1")).alias("chrom"), (F.col("c2") + 1).alias("start"), F.col("c3").alias("end"), F.col("c5").alias("stain"), "loaded_at")
    return x.where("chrom is not null")


PIECES = r"""
with pieces as (select * from (
 select row_id, assembly, regexp_extract(upper(regexp_replace(c1, '[\s\x{a0}]', '', 'g')), '^(?:CHROMOSOME|CHROM|CHR)?[._-]?0*(1[0-9]|2[0-2]|[1-9]|X|Y)$', 1) chrom, c2 + 1 as "start", c3 as "end", c5 stain, loaded_at
 from centromere where c2 is not null and c3 is not null and c3 > c2 and assembly is not null) where chrom <> '')
"""
