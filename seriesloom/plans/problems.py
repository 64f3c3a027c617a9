"""Queries on intervals (p1) and references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.interval_sets import merge_intervals
from seriesloom.operators.references import orphan_references, parent_validity, path_key, plain_key
from seriesloom.util import table


def chrom_name(x):
    """Chromosome 1 to 22, X or Y from any spelling (prefix, case, blanks, leading zeros); anything else is null."""
    bare = F.regexp_extract(F.upper(F.regexp_replace(x, r"[\s ]", "")), r"^(?:CHROMOSOME|CHROM|CHR)?[._-]?0*([1-9][0-9]?|X|Y)$", 1)
    return F.when(bare.isin(*[str(i) for i in range(1, 23)], "X", "Y"), bare)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps of every assembly and chromosome of centromere."""
    rows = table(spark, d, "centromere").select("assembly", chrom_name(F.col("c1")).alias("chrom"), "c2", "c3")
    m = merge_intervals(rows, ["assembly", "chrom"], "c2", "c3")
    return m.select("assembly", "chrom", "kind", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """All references to pdata.name, keyed alike."""
    c = table(spark, d, "cellcycle_info").select(F.lit("cellcycle_info").alias("src_table"), F.col("info_id").alias("row_id"), F.col("filename").alias("raw"), F.col("recorded_at").alias("at"))
    f = table(spark, d, "flagstat").select(F.lit("flagstat").alias("src_table"), F.col("flag_id").alias("row_id"), F.col("name").alias("raw"), F.col("recorded_at").alias("at"))
    named = c.unionByName(f).where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"^[\s ]*$"))
    return named.select("src_table", "row_id", path_key(F.col("raw")).alias("ref_key"), "at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References of cellcycle_info and flagstat whose cell is missing, deleted or late."""
    parents = parent_validity(table(spark, d, "pdata"), plain_key(F.col("name")), "loaded_at", "removed_at")
    found = orphan_references(references(spark, d), parents)
    return found.select("src_table", "row_id", "period", "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return p3_found(spark, d).groupBy("src_table", "period", "reason").agg(F.count("*").alias("n_refs"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_report": p3_report}

_CHROM = r"""nullif(regexp_extract(upper(regexp_replace(c1, '[\s\x{a0}]', '', 'g')), '^(?:CHROMOSOME|CHROM|CHR)?[._-]?0*([1-9][0-9]?|X|Y)$', 1), '')"""
_P1 = f"""
with r as (select assembly, {_CHROM} chrom, c2 s, c3 e from centromere where c2 is not null and c3 is not null and c3 > c2 and assembly is not null),
v as (select * from r where chrom is not null and (chrom in ('X','Y') or cast(case when chrom in ('X','Y') then '0' else chrom end as int) between 1 and 22)),
o as (select *, max(e) over (partition by assembly, chrom order by s, e rows between unbounded preceding and 1 preceding) pe from v),
i as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by assembly, chrom order by s, e rows unbounded preceding) g from o),
p as (select assembly, chrom, g, min(s) s, max(e) e from i group by 1, 2, 3),
n as (select *, lead(s) over (partition by assembly, chrom order by s) ns from p)
select assembly, chrom, 'period' as kind, s as start_bp, e as end_bp from n
union all select assembly, chrom, 'gap', e, ns from n where ns is not null"""

_STRIP = r"regexp_replace({}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
_P3 = rf"""
with refs as (
 select 'cellcycle_info' src_table, info_id row_id, filename raw, recorded_at ra from cellcycle_info
 union all select 'flagstat', flag_id, name, recorded_at from flagstat),
k as (select src_table, row_id, ra, lower({_STRIP.format(r"split_part(regexp_extract(raw, '([^/\\]*)$', 1), '.', 1)")}) ref_key from refs
 where raw is not null and not regexp_full_match(raw, '[\s\x{{a0}}]*')),
p as (select lower({_STRIP.format('name')}) ref_key, min(loaded_at) since, bool_or(removed_at is null) alive from pdata group by 1),
j as (select k.src_table, k.row_id, strftime(ra, '%Y-%m') period, case when p.ref_key is null or p.ref_key = '' then 'missing' when not alive then 'deleted' when since > ra then 'late' end reason
 from k left join p on k.ref_key = p.ref_key)
"""

ORACLES = {
    "p1_found": _P1,
    "p3_found": _P3 + "select src_table, row_id, period, reason from j where reason is not null",
    "p3_report": _P3 + "select src_table, period, reason, count(*) as n_refs from j where reason is not null group by 1, 2, 3",
}
