"""Queries on ordered signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.operators import runs
from seriesloom.plans.base import SIGNAL, signal
from seriesloom.plans.registry import Registry
from seriesloom.util import r6, table

R = Registry()
PART, ORDER = ["name", "chrom"], ["bin_idx"]


@R.add(SIGNAL + "select name, chrom, bin_idx, calls - lag(calls) over w as diff, coalesce(cast(lead(bin_idx) over w - bin_idx as double), 'inf'::double) as gap_next from sig window w as (partition by name, chrom order by bin_idx)")
def lag_gap(spark: SparkSession, d: str) -> DataFrame:
    """Step of the reads per bin, and the distance to the next bin."""
    return runs.differences(signal(spark, d).select(*PART, *ORDER, "calls"), PART, ORDER, "calls").select(*PART, *ORDER, "diff", "gap_next")


RUNS = SIGNAL + """, c as (select name, chrom, bin_idx, copynumber v, case when row_number() over w = 1 or copynumber is distinct from lag(copynumber) over w then 1 else 0 end f from sig window w as (partition by name, chrom order by bin_idx)),
 g as (select *, sum(f) over (partition by name, chrom order by bin_idx rows unbounded preceding) run_id from c),
 runs as (select name, chrom, run_id, min(bin_idx) as "first", max(bin_idx) as "last", count(*) n, min(v) as value from g group by 1, 2, 3)
"""


@R.add(RUNS + "select * from runs")
def rle(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal copy number per cell and chromosome."""
    return runs.run_lengths(signal(spark, d).select(*PART, *ORDER, "copynumber"), PART, ORDER, "copynumber")


@R.add(SIGNAL + "select name, chrom, row_number() over (partition by name, chrom order by bin_idx) as pos, copynumber as value from sig")
def rle_decode(spark: SparkSession, d: str) -> DataFrame:
    """The runs unfolded again: equal to the signal."""
    return runs.decode_runs(rle(spark, d), PART)


FILLED = SIGNAL + """, f as (select *, last_value(copynumber ignore nulls) over (partition by name, chrom order by bin_idx rows between unbounded preceding and current row) b,
 first_value(copynumber ignore nulls) over (partition by name, chrom order by bin_idx rows between current row and unbounded following) a from sig),
 filled as (select *, coalesce(copynumber, case when b is null then a when a is null or a = b then b end) filled from f),
 seg0 as (select *, case when row_number() over w = 1 or filled is distinct from lag(filled) over w then 1 else 0 end fl from filled window w as (partition by name, chrom order by bin_idx)),
 seg as (select *, sum(fl) over (partition by name, chrom order by bin_idx rows unbounded preceding) seg_id from seg0)
"""


def _segments(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    return runs.run_ids(runs.absorb_gaps(signal(spark, d, by), PART, ORDER, "copynumber"), PART, ORDER, "filled", "seg_id")


@R.add(FILLED + 'select name, chrom, seg_id, min(bin_idx) as "first", max(bin_idx) as "last", count(*) n, min(filled) as level from seg group by 1, 2, 3')
def rle_na_fill(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the copy number after gaps were absorbed."""
    s = _segments(spark, d)
    return s.groupBy(*PART, "seg_id").agg(F.min("bin_idx").alias("first"), F.max("bin_idx").alias("last"), F.count("*").alias("n"), F.first("filled").alias("level"))


@R.add(FILLED + """, t as (select *, count(*) over (partition by name, chrom, seg_id) n0, row_number() over (partition by name, chrom, seg_id order by bin_idx) i from seg)
 select name, chrom, seg_id, round(median(calls), 6) as med, round(var_samp(calls), 6) as var_reads, count(calls) as support from t where n0 >= 4 and i > 1 and i <= n0 - 1 group by 1, 2, 3""")
def segment_trimmed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Median and variance of the reads of segments of four bins or more, without their end bins."""
    s = _segments(spark, d).select(*PART, "bin_idx", "seg_id", "calls")
    return runs.smooth(s, PART, ORDER, "seg_id", [r6(F.median("calls")).alias("med"), r6(F.var_samp("calls")).alias("var_reads"), F.count("calls").alias("support")], 4, 1)


@R.add(FILLED + """select name, chrom, seg_id, min(start_pos) as start_bp, max(end_pos) as end_bp, sum(end_pos - start_pos + 1) as width, count(*) as length, count(calls) as support, min(filled) as level,
 round(median(calls), 6) as reads, round(avg(calls), 6) as mean_reads, round(var_samp(calls), 6) as var_reads from seg group by 1, 2, 3""")
def segment_table(spark: SparkSession, d: str) -> DataFrame:
    """Segments in base pairs with their read statistics."""
    s = _segments(spark, d)
    return s.groupBy(*PART, "seg_id").agg(
        F.min("start_pos").alias("start_bp"), F.max("end_pos").alias("end_bp"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("width"), F.count("*").alias("length"), F.count("calls").alias("support"),
        F.first("filled").alias("level"), r6(F.median("calls")).alias("reads"), r6(F.avg("calls")).alias("mean_reads"), r6(F.var_samp("calls")).alias("var_reads"),
    )


@R.add(FILLED + "select name, chrom, bin_idx, round(median(calls) over (partition by name, chrom, seg_id), 6) as level from seg")
def segment_levels(spark: SparkSession, d: str) -> DataFrame:
    """Median of its segment for every bin."""
    s = _segments(spark, d).select(*PART, "bin_idx", "seg_id", "calls")
    return runs.segment_levels(s, PART, "seg_id", "calls").select(*PART, "bin_idx", r6("level").alias("level"))


@R.add(SIGNAL + "select name, chrom, bin_idx, sum(coalesce(calls, 0)) over w as cum_x, sum(coalesce(calls, 0)::bigint * coalesce(calls, 0)) over w as cum_x2 from sig window w as (partition by name, chrom order by bin_idx rows unbounded preceding)")
def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    """Running sums of reads and squared reads."""
    s = signal(spark, d).select(*PART, *ORDER, F.col("calls").cast("long").alias("calls"))
    return runs.prefix_sums(s, PART, ORDER, "calls").select(*PART, *ORDER, "cum_x", "cum_x2")


BOUNDS = """with n as (select chrom, chrom_rank, count(*) n from bins group by 1, 2), c as (select *, sum(n) over (order by chrom_rank rows unbounded preceding) e from n)
select chrom, chrom_rank, e as boundary, e - n + cast(ceil(n / 2.0) as bigint) as middle, e < (select max(e) from c) as inner_boundary from c"""


@R.add(BOUNDS)
def boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Index of the last bin of each chromosome in genome order, and of its middle bin."""
    n = table(spark, d, "bins").groupBy("chrom", "chrom_rank").agg(F.count("*").alias("n"))  # one row per chromosome
    w = Window.orderBy("chrom_rank")
    c = n.withColumn("boundary", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead("boundary").over(w).isNotNull()
    return c.select("chrom", "chrom_rank", "boundary", (F.col("boundary") - F.col("n") + F.ceil(F.col("n") / 2)).alias("middle"), last.alias("inner_boundary"))


@R.add(SIGNAL + """, x as (select name, copynumber - lag(copynumber) over (partition by name order by chrom_rank, bin_idx) diff from sig)
select name, sum(cast(diff <> 0 as int)) as n_changes, sum(abs(diff)) as total_change, round(stddev_pop(diff), 6) as sd_change from x where diff is not null group by 1""")
def oscillation(spark: SparkSession, d: str) -> DataFrame:
    """How much the copy number of a cell moves along the genome."""
    s = signal(spark, d).select("name", "chrom_rank", "bin_idx", "copynumber")
    return runs.oscillation(s, ["name"], ["chrom_rank", "bin_idx"], "copynumber", ["name"]).withColumn("sd_change", r6("sd_change"))


@R.add(SIGNAL + """, x as (select name, chrom, bin_idx, coalesce(copynumber <> cast(floor(segmented) as int), false) dis from sig),
 y as (select *, case when row_number() over w = 1 or dis is distinct from lag(dis) over w then 1 else 0 end f from x window w as (partition by name, chrom order by bin_idx)),
 z as (select *, sum(f) over (partition by name, chrom order by bin_idx rows unbounded preceding) run_id from y),
 q as (select *, count(*) over (partition by name, chrom, run_id) n0, row_number() over (partition by name, chrom, run_id order by bin_idx) i from z where dis)
select name, chrom, run_id, min(bin_idx) as "first", max(bin_idx) as "last", count(*) n, max(case when i = (n0 + 1) // 2 then bin_idx end) as middle from q group by 1, 2, 3""")
def discordant_marks(spark: SparkSession, d: str) -> DataFrame:
    """Stretches where copy number and the whole part of the segment level differ, with one mark each."""
    s = signal(spark, d).select(*PART, *ORDER, "copynumber", F.floor("segmented").cast("int").alias("near"))
    return runs.discordant_marks(s, PART, ORDER, "copynumber", "near")


@R.add(SIGNAL + """, x as (select copynumber to_state, lag(copynumber) over (partition by name, chrom order by bin_idx) from_state from sig)
select from_state, to_state, count(*) as n from x where from_state is not null and to_state is not null group by 1, 2""")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Steps from copy number to copy number along chromosomes."""
    return runs.transitions(signal(spark, d).select(*PART, *ORDER, "copynumber"), PART, ORDER, "copynumber")


@R.add(SIGNAL + "select name, chrom, bin_idx, case when coalesce(usable, true) and gc is not null then calls end as masked, coalesce(usable, true) and gc is not null as in_use from sig")
def mask_bins(spark: SparkSession, d: str) -> DataFrame:
    """Reads of bins that aren't to be used set to null, so that positions stay."""
    use = F.coalesce("usable", F.lit(True)) & F.col("gc").isNotNull()
    return signal(spark, d).select(*PART, *ORDER, F.when(use, F.col("calls")).alias("masked"), use.alias("in_use"))


QUERIES, ORACLES = R.queries, R.sql
