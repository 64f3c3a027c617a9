"""Queries on ranges: the pieces of centromere against each other and against the grid of bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import ranges
from seriesloom.plans.base import PIECES, pieces
from seriesloom.plans.registry import Registry
from seriesloom.util import r6, table

R = Registry()
GRID = 25_000_000
FINE = 1_000_000
GRID_SQL = ", grid as (select chrom, bin_idx, chrom_rank, start_pos as \"start\", end_pos as \"end\" from bins)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of bins as ranges."""
    return table(spark, d, "bins").select("chrom", "bin_idx", "chrom_rank", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


def assembly_grid(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue once for every assembly."""
    each = pieces(spark, d).select("assembly").distinct()
    return each.crossJoin(F.broadcast(grid(spark, d)))  # fixed catalogue


ASSEMBLY_GRID = GRID_SQL + ", ag as (select * from (select distinct assembly from pieces) cross join grid)"


@R.add(PIECES + GRID_SQL + """select p.row_id, p.chrom, g.bin_idx, least(p."end", g."end") - greatest(p."start", g."start") + 1 as ov_width from pieces p join grid g on p.chrom = g.chrom and p."start" <= g."end" and g."start" <= p."end\"""")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Bins that each piece meets, with the width of the intersection."""
    o = ranges.overlap_join(pieces(spark, d).select("chrom", "row_id", "start", "end"), grid(spark, d), ["chrom"], GRID)
    return o.select(F.col("a_row_id").alias("row_id"), "chrom", F.col("b_bin_idx").alias("bin_idx"), "ov_width")


@R.add(PIECES + """select a.row_id as row_a, b.row_id as row_b, least(a."end", b."end") - greatest(a."start", b."start") + 1 as ov_width from pieces a join pieces b on a.assembly = b.assembly and a.chrom = b.chrom and a."start" <= b."end" and b."start" <= a."end" and a.row_id < b.row_id""")
def overlap_self(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of overlapping pieces of one assembly and chromosome."""
    p = pieces(spark, d).select("assembly", "chrom", "row_id", "start", "end")
    o = ranges.overlap_join(p, p, ["assembly", "chrom"], FINE).where("a_row_id < b_row_id")
    return o.select(F.col("a_row_id").alias("row_a"), F.col("b_row_id").alias("row_b"), "ov_width")


@R.add(PIECES + GRID_SQL + """select p.row_id, g.bin_idx from pieces p join grid g on p.chrom = g.chrom and p."start" >= g."start" and p."end" <= g."end\"""")
def within_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that lie wholly inside a bin."""
    o = ranges.within_join(pieces(spark, d).select("chrom", "row_id", "start", "end"), grid(spark, d), ["chrom"], GRID)
    return o.select(F.col("a_row_id").alias("row_id"), F.col("b_bin_idx").alias("bin_idx"))


@R.add(PIECES + ASSEMBLY_GRID + """select assembly, chrom, bin_idx from ag g where not exists (select 1 from pieces p where p.assembly = g.assembly and p.chrom = g.chrom and p."start" <= g."end" and g."start" <= p."end"
 and (least(p."end", g."end") - greatest(p."start", g."start") + 1) / (g."end" - g."start" + 1) > 0.02)""")
def bin_filter_share(spark: SparkSession, d: str) -> DataFrame:
    """Bins of each assembly of which no single piece covers more than a fiftieth (the grid is coarse; the usual share is a quarter)."""
    return ranges.drop_covered(assembly_grid(spark, d), pieces(spark, d), ["assembly", "chrom"], ["bin_idx"], GRID, 0.02).select("assembly", "chrom", "bin_idx")


COVER = PIECES + """, m as (select assembly, chrom, "start" pos, 1 step from pieces union all select assembly, chrom, "end" + 1, -1 from pieces),
 s as (select assembly, chrom, pos, sum(step) step from m group by 1, 2, 3),
 c as (select assembly, chrom, pos as "start", lead(pos) over w - 1 as "end", cast(sum(step) over (partition by assembly, chrom order by pos rows unbounded preceding) as bigint) depth from s window w as (partition by assembly, chrom order by pos)),
 f as (select *, case when depth is distinct from lag(depth) over (partition by assembly, chrom order by "start") then 1 else 0 end fl from c where "end" is not null),
 g as (select *, sum(fl) over (partition by assembly, chrom order by "start" rows unbounded preceding) gr from f),
 cov as (select assembly, chrom, min("start") as "start", max("end") as "end", min(depth) depth from g group by assembly, chrom, gr)
"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return ranges.coverage(pieces(spark, d), ["assembly", "chrom"])


@R.add(COVER + "select * from cov")
def coverage_steps(spark: SparkSession, d: str) -> DataFrame:
    """Number of pieces over every stretch of each assembly and chromosome."""
    return _steps(spark, d)


@R.add(COVER + 'select assembly, chrom, "start", "end", case when depth = 1 then 0 else depth end as masked_depth, depth = 0 as is_gap from cov')
def depth_mask(spark: SparkSession, d: str) -> DataFrame:
    """Coverage with single depth masked and zero depth marked."""
    return _steps(spark, d).select("assembly", "chrom", "start", "end", ranges.mask_single(F.col("depth")).alias("masked_depth"), (F.col("depth") == 0).alias("is_gap"))


@R.add(COVER + """, h as (select *, case when depth >= 2 and not coalesce(lag(depth) over (partition by assembly, chrom order by "start") >= 2, false) then 1 else 0 end hf from cov),
 k as (select *, sum(hf) over (partition by assembly, chrom order by "start" rows unbounded preceding) hg from h)
select assembly, chrom, min("start") as "start", max("end") as "end", max(depth) as top, round(sum(depth * ("end" - "start" + 1)) / sum("end" - "start" + 1), 6) as mean_depth from k where depth >= 2 group by assembly, chrom, hg""")
def coverage_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Stretches covered at least twice."""
    return ranges.peaks(_steps(spark, d), ["assembly", "chrom"], 2).withColumn("mean_depth", r6("mean_depth"))


@R.add(PIECES + """, o as (select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) pe from pieces),
 i as (select *, sum(case when pe is null or "start" > pe + 1 then 1 else 0 end) over (partition by chrom order by "start", "end" rows unbounded preceding) g from o)
select chrom, min("start") as "start", max("end") as "end" from i group by chrom, g""")
def interval_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Union of the pieces of all assemblies per chromosome."""
    return ranges.reduce_ranges(pieces(spark, d).select("chrom", "start", "end"), ["chrom"])


AVERAGE = COVER + ASSEMBLY_GRID + """, ov as (select g.assembly, g.chrom, g.bin_idx, sum(c.depth * (least(c."end", g."end") - greatest(c."start", g."start") + 1)) s, sum(least(c."end", g."end") - greatest(c."start", g."start") + 1) w
 from ag g join cov c on g.assembly = c.assembly and g.chrom = c.chrom and c."start" <= g."end" and g."start" <= c."end" group by 1, 2, 3)
select g.assembly, g.chrom, g.bin_idx, round(coalesce(s, 0) / (g."end" - g."start" + 1), 6) as mean_all, round(s / w, 6) as mean_covered from ag g left join ov on g.assembly = ov.assembly and g.chrom = ov.chrom and g.bin_idx = ov.bin_idx"""


@R.add(AVERAGE)
def binned_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean depth of each bin of each assembly, with and without uncovered positions."""
    a = ranges.binned_average(assembly_grid(spark, d), _steps(spark, d), ["assembly", "chrom"], ["bin_idx"], "depth", GRID)
    return a.select("assembly", "chrom", "bin_idx", r6("mean_all").alias("mean_all"), r6("mean_covered").alias("mean_covered"))


@R.add(COVER + ASSEMBLY_GRID + """, ov as (select g.assembly, g.chrom, g.bin_idx, sum(least(c."end", g."end") - greatest(c."start", g."start") + 1) w
 from ag g join cov c on c.depth > 0 and g.assembly = c.assembly and g.chrom = c.chrom and c."start" <= g."end" and g."start" <= c."end" group by 1, 2, 3)
select g.assembly, g.chrom, g.bin_idx, round(coalesce(w, 0) / (g."end" - g."start" + 1), 6) as excluded, coalesce(w, 0) / (g."end" - g."start" + 1) > 0.04 as drop_bin from ag g left join ov on g.assembly = ov.assembly and g.chrom = ov.chrom and g.bin_idx = ov.bin_idx""")
def excluded_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of each bin that any piece covers (shares are added up after pieces were united)."""
    united = ranges.reduce_ranges(pieces(spark, d).select("assembly", "chrom", "start", "end"), ["assembly", "chrom"]).withColumn("one", F.lit(1))
    a = ranges.binned_average(assembly_grid(spark, d), united, ["assembly", "chrom"], ["bin_idx"], "one", GRID)
    return a.select("assembly", "chrom", "bin_idx", r6("mean_all").alias("excluded"), (F.col("mean_all") > 0.04).alias("drop_bin"))


@R.add(PIECES + GRID_SQL + """select src, chrom, chrom_rank, "start", "end" from (select 'bins' src, chrom, chrom_rank, "start", "end" from grid union all select 'pieces', p.chrom, r.chrom_rank, p."start", p."end" from pieces p join (select distinct chrom, chrom_rank from grid) r on p.chrom = r.chrom)""")
def range_concat(spark: SparkSession, d: str) -> DataFrame:
    """Bins and pieces as one set in genome order."""
    g = grid(spark, d)
    rank = g.select("chrom", "chrom_rank").distinct()  # one row per chromosome
    p = pieces(spark, d).join(F.broadcast(rank), "chrom").select(F.lit("pieces").alias("src"), "chrom", "chrom_rank", "start", "end")
    return g.select(F.lit("bins").alias("src"), "chrom", "chrom_rank", "start", "end").unionByName(p).orderBy("chrom_rank", "start", "end", "src")


@R.add(PIECES + ASSEMBLY_GRID + """, o as (select g.assembly, g.chrom, g.bin_idx, p.stain, row_number() over (partition by g.assembly, g.chrom, g.bin_idx order by p.loaded_at desc nulls last, p.row_id desc) rn
 from ag g join pieces p on g.assembly = p.assembly and g.chrom = p.chrom and p."start" <= g."end" and g."start" <= p."end")
select g.assembly, g.chrom, g.bin_idx, o.stain from ag g left join o on o.rn = 1 and g.assembly = o.assembly and g.chrom = o.chrom and g.bin_idx = o.bin_idx""")
def assign_latest(spark: SparkSession, d: str) -> DataFrame:
    """Stain of the piece delivered last for each bin."""
    a = ranges.assign_latest(assembly_grid(spark, d), pieces(spark, d), ["assembly", "chrom"], ["bin_idx"], "stain", ["loaded_at", "row_id"], GRID)
    return a.select("assembly", "chrom", "bin_idx", "stain")


@R.add(PIECES + ASSEMBLY_GRID + """, x as (select g.assembly, g.chrom, g.bin_idx, exists (select 1 from pieces p where p.assembly = g.assembly and p.chrom = g.chrom and p."start" <= g."end" and g."start" <= p."end") met from ag g)
select assembly, chrom, bin_idx, case when met then 'over' else 'outside' end as place from x""")
def outside_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Bins that meet a piece and bins that meet none."""
    g, p = assembly_grid(spark, d), pieces(spark, d)
    over = ranges.overlap_join(g, p, ["assembly", "chrom"], GRID, "left_semi").withColumn("place", F.lit("over"))
    out = ranges.overlap_join(g, p, ["assembly", "chrom"], GRID, "left_anti").withColumn("place", F.lit("outside"))
    return over.unionByName(out).select("assembly", "chrom", "bin_idx", "place")


DENSITY = COVER + """, inside as (select p.row_id, p.chrom, p.assembly, g.bin_idx, p."end" - p."start" + 1 as w from pieces p join bins g on p.chrom = g.chrom and p."start" >= g.start_pos and p."end" <= g.end_pos),
 reads as (select assembly, chrom, bin_idx, count(*) n_reads, sum(w) bases from inside group by 1, 2, 3),
 h as (select *, case when depth >= 2 and not coalesce(lag(depth) over (partition by assembly, chrom order by "start") >= 2, false) then 1 else 0 end hf from cov),
 k as (select *, sum(hf) over (partition by assembly, chrom order by "start" rows unbounded preceding) hg from h),
 pk as (select assembly, chrom, min("start") s, max("end") e, max(depth) top, sum(depth * ("end" - "start" + 1)) / sum("end" - "start" + 1) md from k where depth >= 2 group by assembly, chrom, hg)
select 'average' as status, assembly, chrom, bin_idx, n_reads, round(bases / n_reads, 6) as mean_width, null::bigint as "start", null::bigint as "end", null::bigint as top, null::double as mean_depth from reads
union all select 'extrema', assembly, chrom, null, null, null, s, e, top, round(md, 6) from pk"""


@R.add(DENSITY)
def read_density(spark: SparkSession, d: str) -> DataFrame:
    """Density table: pieces that lie inside a bin counted per bin (average), and stretches of high coverage (extrema)."""
    inside = ranges.within_join(pieces(spark, d).select("chrom", "assembly", "row_id", "start", "end"), grid(spark, d), ["chrom"], GRID)
    reads = inside.groupBy(F.col("a_assembly").alias("assembly"), "chrom", F.col("b_bin_idx").alias("bin_idx")).agg(F.count("*").alias("n_reads"), r6(F.avg(F.col("a_end") - F.col("a_start") + 1)).alias("mean_width"))
    tops = ranges.peaks(_steps(spark, d), ["assembly", "chrom"], 2).withColumn("mean_depth", r6("mean_depth"))
    return reads.withColumn("status", F.lit("average")).unionByName(tops.withColumn("status", F.lit("extrema")), allowMissingColumns=True)


QUERIES, ORACLES = R.queries, R.sql
