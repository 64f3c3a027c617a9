"""Queries on tables of cells, annotations and deliveries: joins, reshapes, orders, sets, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions import names as N
from seriesloom.operators import cohort as C
from seriesloom.operators.ordered import numbered, with_group
from seriesloom.operators.references import path_key, plain_key
from seriesloom.plans.base import CELLS, SIGNAL, cells, signal
from seriesloom.plans.registry import Registry
from seriesloom.util import r6, table

R = Registry()
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]

FLAGS = r""", flags as (select * from (select *, lower(trim(split_part(regexp_extract(name, '([^/\\]*)$', 1), '.', 1))) cell, row_number() over (partition by lower(trim(split_part(regexp_extract(name, '([^/\\]*)$', 1), '.', 1))) order by recorded_at desc nulls last, flag_id desc) rn from flagstat where name is not null) where rn = 1 and cell <> '')"""
INFO = r""", info as (select * from (select *, lower(trim(split_part(regexp_extract(filename, '([^/\\]*)$', 1), '.', 1))) cell, row_number() over (partition by lower(trim(split_part(regexp_extract(filename, '([^/\\]*)$', 1), '.', 1))) order by recorded_at desc nulls last, info_id desc) rn from cellcycle_info where filename is not null) where rn = 1 and cell <> '')"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Latest flagstat row of each cell."""
    f = table(spark, d, "flagstat").where("name is not null").withColumn("cell", path_key(F.col("name"))).where("cell <> ''")
    return C.first_rows(f, ["cell"], [F.desc_nulls_last("recorded_at"), F.desc("flag_id")])


def info(spark: SparkSession, d: str) -> DataFrame:
    """Latest annotation of each cell."""
    f = table(spark, d, "cellcycle_info").where("filename is not null").withColumn("cell", path_key(F.col("filename"))).where("cell <> ''")
    return C.first_rows(f, ["cell"], [F.desc_nulls_last("recorded_at"), F.desc("info_id")])


@R.add(CELLS + FLAGS + "select c.cell, c.row_id, f.qctotal, f.qcmapped from cells c left join flags f on c.cell = f.cell")
def join_flagstat(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their alignment counts."""
    return cells(spark, d).select("cell", "row_id").join(flags(spark, d).select("cell", "qctotal", "qcmapped"), "cell", "left")


@R.add(CELLS + INFO + 'select c.cell, c.uid, c.slx, i.uid as "uid.y", i.slx as "slx.y", i.cellcycle from cells c left join info i on c.cell = i.cell')
def join_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their annotation; columns that both have get a suffix."""
    return C.join_suffix(cells(spark, d).select("cell", "uid", "slx"), info(spark, d).select("cell", "uid", "slx", "cellcycle"), ["cell"], ".y")


@R.add(CELLS + INFO + "select c.cell, c.row_id, i.info_id from cells c join info i on c.cell = i.cell and c.uid = upper(trim(i.uid))")
def join_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose annotation names the same UID."""
    i = info(spark, d).select("cell", F.upper(F.trim("uid")).alias("uid"), "info_id")
    return cells(spark, d).select("cell", "uid", "row_id").join(i, ["cell", "uid"]).select("cell", "row_id", "info_id")


@R.add(CELLS + INFO + FLAGS + """, j as (select c.cell, c.ploidy, c.gini, i.s_phase_prob, f.qctotal / 1e6 reads_m from cells c join info i on c.cell = i.cell left join flags f on c.cell = f.cell)
select cell, 'ploidy' as variable, ploidy as value from j union all select cell, 'gini', gini from j union all select cell, 's_phase_prob', s_phase_prob from j union all select cell, 'reads_m', reads_m from j""")
def join_chain(spark: SparkSession, d: str) -> DataFrame:
    """Measures from three tables in long form."""
    j = cells(spark, d).select("cell", "ploidy", "gini").join(info(spark, d).select("cell", "s_phase_prob"), "cell").join(flags(spark, d).select("cell", (F.col("qctotal") / 1e6).alias("reads_m")), "cell", "left")
    return C.unpivot(j, ["cell"], ["ploidy", "gini", "s_phase_prob", "reads_m"])


@R.add(CELLS + INFO + "select cell, exists (select 1 from info i where i.cell = c.cell) as annotated from cells c")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Cells with and without an annotation."""
    c, i = cells(spark, d).select("cell"), info(spark, d).select("cell")
    return c.join(i, "cell", "left_semi").withColumn("annotated", F.lit(True)).unionByName(c.join(i, "cell", "left_anti").withColumn("annotated", F.lit(False)))


@R.add("""with a as (select uid, chrom, bin_idx, max(copynumber) top from assaydata group by 1, 2, 3), b as (select chrom, bin_idx, uid, count(*) n from assaydata where calls is not null group by 1, 2, 3)
select a.uid, a.chrom, a.bin_idx, a.top, b.n from a join b on a.uid = b.uid and a.chrom = b.chrom and a.bin_idx = b.bin_idx""")
def natural_join(spark: SparkSession, d: str) -> DataFrame:
    """Two summaries of bins per UID joined on all common columns."""
    s = table(spark, d, "assaydata")
    return C.natural_join(s.groupBy("uid", "chrom", "bin_idx").agg(F.max("copynumber").alias("top")), s.where("calls is not null").groupBy("chrom", "bin_idx", "uid").agg(F.count("*").alias("n")))


@R.add(SIGNAL + "select s.name, s.chrom, s.bin_idx, s.calls from sig s join bins b on s.chrom = b.chrom and s.bin_idx = b.bin_idx where b.usable and b.mappability > 0.95")
def lookup_positions(spark: SparkSession, d: str) -> DataFrame:
    """Signal at the positions of a list of good bins."""
    good = table(spark, d, "bins").where("usable and mappability > 0.95").select("chrom", "bin_idx")  # fixed catalogue
    return signal(spark, d).select("name", "chrom", "bin_idx", "calls").join(F.broadcast(good), ["chrom", "bin_idx"], "left_semi")


@R.add(CELLS + """, g as (select cell, floor(ploidy * 4) px, floor(gini * 20) py from cells where ploidy is not null and gini is not null), n as (select px, py, count(*) n from g group by 1, 2)
select g.cell, cast(n.n as bigint) as density from g join n on g.px = n.px and g.py = n.py""")
def grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Number of cells in the grid square of each cell."""
    g = cells(spark, d).where("ploidy is not null and gini is not null").select("cell", F.floor(F.col("ploidy") * 4).alias("px"), F.floor(F.col("gini") * 20).alias("py"))
    return g.withColumn("density", F.count("*").over(Window.partitionBy("px", "py"))).select("cell", "density")


CHANGES = SIGNAL + """, s as (select name, chrom, bin_idx, copynumber <> lag(copynumber) over w a, abs(segmented - lag(segmented) over w) > 0.5 b from sig window w as (partition by name, chrom order by bin_idx))"""


@R.add(CHANGES + "select x.name, x.chrom, x.bin_idx from s x where x.a and exists (select 1 from s y where y.b and y.name = x.name and y.chrom = x.chrom and abs(y.bin_idx - x.bin_idx) <= 2)")
def tolerance_hits(spark: SparkSession, d: str) -> DataFrame:
    """Changes of copy number with a change of segment level within two bins."""
    w = Window.partitionBy("name", "chrom").orderBy("bin_idx")
    s = signal(spark, d).select("name", "chrom", "bin_idx", (F.col("copynumber") != F.lag("copynumber").over(w)).alias("a"), (F.abs(F.col("segmented") - F.lag("segmented").over(w)) > 0.5).alias("b"))
    return C.tolerance_match(s.where("a").select("name", "chrom", "bin_idx"), s.where("b").select("name", "chrom", "bin_idx"), ["name", "chrom"], "bin_idx", 2)


@R.add(CELLS + INFO + "select c.cell, case when i.cellcycle is null or trim(i.cellcycle) = '' then 'unknown' else i.cellcycle end as phase from cells c left join info i on c.cell = i.cell where i.quality >= 0.5 or i.quality is null")
def sentinel_override(spark: SparkSession, d: str) -> DataFrame:
    """Phase of each cell whose annotation is good or missing; blank phases become unknown."""
    j = cells(spark, d).select("cell").join(info(spark, d).select("cell", "cellcycle", "quality"), "cell", "left").where("quality >= 0.5 or quality is null")
    return j.select("cell", F.when(F.col("cellcycle").isNull() | (F.trim("cellcycle") == ""), "unknown").otherwise(F.col("cellcycle")).alias("phase"))


@R.add(CELLS + ", u as (select uid, count(*) n, avg(ploidy) m from cells group by 1) select uid, scale, round(m * scale, 9) as scaled, n from u cross join (select unnest([0.5::double, 1.0, 1.5, 2.0]) scale)")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean ploidy of each UID under four scales."""
    u = cells(spark, d).groupBy("uid").agg(F.count("*").alias("n"), F.avg("ploidy").alias("m"))
    return u.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5, 2.0)]))).select("uid", "scale", F.round(F.col("m") * F.col("scale"), 9).alias("scaled"), "n")


@R.add("""select row_id, split_part(trim(name), '_', 1) as uid_part, nullif(split_part(trim(name), '_', 2), '') as slx_part, try_cast(nullif(split_part(trim(name), '_', 3), '') as bigint) as cell_no, nullif(split_part(trim(name), '_', 4), '') as tag_part from pdata where name is not null""")
def separate_name(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the cell names."""
    u, s, c, t = N.name_fields(F.trim("name"))
    e = lambda x: F.nullif(x, F.lit(""))
    return table(spark, d, "pdata").where("name is not null").select("row_id", u.alias("uid_part"), e(s).alias("slx_part"), e(c).try_cast("bigint").alias("cell_no"), e(t).alias("tag_part"))


@R.add(r"""select info_id, regexp_extract(filename, '([^/\\]*)$', 1) as base, regexp_replace(filename, '[/\\]?[^/\\]*$', '') as folder, regexp_replace(regexp_extract(filename, '([^/\\]*)$', 1), '\.[^.]*$', '') as stem, starts_with(upper(trim(regexp_extract(filename, '([^/\\]*)$', 1))), 'UID') as has_uid, md5(filename) as digest from cellcycle_info where filename is not null""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Folder, base name, stem and digest of annotation paths."""
    f = F.col("filename")
    b = N.base_name(f)
    return table(spark, d, "cellcycle_info").where("filename is not null").select("info_id", b.alias("base"), N.dir_name(f).alias("folder"), N.without_extension(b).alias("stem"), F.startswith(F.upper(F.trim(b)), F.lit("UID")).alias("has_uid"), F.md5(f).alias("digest"))


@R.add(SIGNAL + """, u as (select uid, count(distinct name) a from sig where calls is not null group by 1), p as (select uid, chrom, bin_idx, count(distinct name) n from sig where calls is not null group by 1, 2, 3)
select p.uid, p.chrom, p.bin_idx from p join u on p.uid = u.uid and p.n = u.a""")
def complete_loci(spark: SparkSession, d: str) -> DataFrame:
    """Bins that every cell of a UID has."""
    s = signal(spark, d).where("calls is not null").select("uid", "name", "chrom", "bin_idx")
    n = s.groupBy("uid").agg(F.count_distinct("name").alias("a"))
    p = s.groupBy("uid", "chrom", "bin_idx").agg(F.count_distinct("name").alias("n"))
    return p.join(n, "uid").where("n = a").select("uid", "chrom", "bin_idx")


@R.add(SIGNAL + ", k as (select name, chrom, round(avg(copynumber), 6) v from sig group by 1, 2) select name, " + ", ".join(f"max(case when chrom = '{c}' then v end) as c{c.lower()}" for c in CHROMOSOMES) + " from k group by 1")
def pivot_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """Mean copy number of all chromosomes side by side."""
    k = signal(spark, d).groupBy("name").pivot("chrom", CHROMOSOMES).agg(r6(F.avg("copynumber")))
    return k.select("name", *[F.col(c).alias(f"c{c.lower()}") for c in CHROMOSOMES])


@R.add(SIGNAL + "select name, coalesce(list(copynumber order by chrom_rank, bin_idx) filter (copynumber is not null), []) as states from sig group by 1")
def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """The known states of a cell in genome order as one array."""
    x = F.sort_array(F.collect_list(F.when(F.col("copynumber").isNotNull(), F.struct("chrom_rank", "bin_idx", "copynumber"))))
    return signal(spark, d).groupBy("name").agg(F.transform(x, lambda s: s["copynumber"]).alias("states"))


@R.add(CELLS + "select row_id, rank, ploidy from (select row_id, ploidy, rank() over (order by ploidy desc) as rank from cells where ploidy is not null) where rank <= 100")
def top_ploidy(spark: SparkSession, d: str) -> DataFrame:
    """The hundred cells of highest ploidy, with ties."""
    c = cells(spark, d).where("ploidy is not null").select("row_id", "ploidy")
    edge = c.orderBy(F.desc("ploidy")).limit(100).agg(F.min("ploidy").alias("edge"))  # one row
    kept = c.join(F.broadcast(edge), c["ploidy"] >= F.col("edge")).drop("edge")  # about a hundred rows
    return kept.withColumn("rank", F.rank().over(Window.orderBy(F.desc("ploidy")))).select("row_id", "rank", "ploidy")


@R.add(CELLS + "select uid, row_id, gini from (select *, row_number() over (partition by uid order by gini, row_id) rn from cells where gini is not null) where rn = 1")
def first_min(spark: SparkSession, d: str) -> DataFrame:
    """The most even cell of each UID."""
    return C.first_rows(cells(spark, d).where("gini is not null").select("uid", "row_id", "gini"), ["uid"], [F.asc("gini"), F.asc("row_id")])


@R.add(CELLS + "select row_id, uid, used_reads from (select *, rank() over (partition by uid order by used_reads desc) r, count(*) over (partition by uid) n from cells where used_reads is not null) where r <= floor(0.75::double * n)")
def slice_max_prop(spark: SparkSession, d: str) -> DataFrame:
    """The three quarters of each UID's cells with most reads."""
    return C.top_share(cells(spark, d).select("row_id", "uid", "used_reads"), ["uid"], "used_reads", 0.75)


@R.add("select row_id, uid from pdata where substr(md5('3|' || row_id), 1, 8) < '1999999a'")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible tenth of the deliveries."""
    return C.hash_sample(table(spark, d, "pdata"), ["row_id"], 0.1, 3).select("row_id", "uid")


@R.add("""select row_id, c3 - c2 as width from centromere where c2 is not null and c3 > c2 order by width desc, row_id limit 1120""")
def widest_regions(spark: SparkSession, d: str) -> DataFrame:
    """The 1120 widest regions."""
    return table(spark, d, "centromere").where("c2 is not null and c3 > c2").select("row_id", (F.col("c3") - F.col("c2")).alias("width")).orderBy(F.desc("width"), "row_id").limit(1120)


@R.add(r"""with c as (select row_id, regexp_extract(upper(regexp_replace(c1, '[\s\x{a0}]', '', 'g')), '^(?:CHR)?0*(1[0-9]|2[0-2]|[1-9]|X|Y)$', 1) chrom from centromere)
select row_id, chrom, case chrom when 'X' then 23 when 'Y' then 24 else try_cast(chrom as int) end as chrom_rank from c where chrom in ('1','2','3','4','5','6','7','8','9','10','X')""")
def select_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of some chromosomes with their place in genome order."""
    from seriesloom.plans.problems import chrom_name

    c = table(spark, d, "centromere").select("row_id", chrom_name(F.col("c1")).alias("chrom"))
    keep = [str(i) for i in range(1, 11)] + ["X"]
    return c.where(F.col("chrom").isin(keep)).withColumn("chrom_rank", N.chromosome_rank(F.col("chrom")))


@R.add(CELLS + INFO + """select coalesce(c.cell, i.cell) as cell, c.cell is not null as in_cells, i.cell is not null as in_info from cells c full join info i on c.cell = i.cell""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Union of two sets of names with where each name is from, by union, intersect and subtract."""
    c, i = cells(spark, d).select("cell"), info(spark, d).select("cell")
    flag = lambda x, a, b: x.withColumn("in_cells", F.lit(a)).withColumn("in_info", F.lit(b))
    return flag(c.intersect(i), True, True).unionByName(flag(c.subtract(i), True, False)).unionByName(flag(i.subtract(c), False, True))


@R.add("""select 'cellcycle_info' as src, info_id as id, uid, slx, recorded_at, null::double as qctotal from cellcycle_info union all select 'flagstat', flag_id, null, null, recorded_at, qctotal from flagstat""")
def union_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Two tables in one; columns that one lacks are null there."""
    a = table(spark, d, "cellcycle_info").select(F.lit("cellcycle_info").alias("src"), F.col("info_id").alias("id"), "uid", "slx", "recorded_at")
    b = table(spark, d, "flagstat").select(F.lit("flagstat").alias("src"), F.col("flag_id").alias("id"), "recorded_at", "qctotal")
    return C.union_lenient([a, b])


@R.add("select uid, slx, 1 as src from cellcycle_info union all select uid, slx, 2 from pdata")
def union_common(spark: SparkSession, d: str) -> DataFrame:
    """Two cohorts with the columns that both have."""
    c, p = table(spark, d, "cellcycle_info"), table(spark, d, "pdata")
    return C.union_common([c.select("uid", "slx", "quality", F.lit(1).alias("src")), p.select("uid", "slx", "genome", F.lit(2).alias("src"))])


@R.add("select * from (select row_id, name, uid, row_number() over (partition by name order by loaded_at nulls last, row_id) rn from pdata) where rn = 1", name="distinct_first")
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each name."""
    p = table(spark, d, "pdata").select("row_id", "name", "uid", "loaded_at")
    return C.first_rows(p, ["name"], [F.asc_nulls_last("loaded_at"), F.asc("row_id")]).select("row_id", "name", "uid").withColumn("rn", F.lit(1).cast("long"))


@R.add(CELLS + ", x as (select *, min(abs(ploidy - 2)) over (partition by uid) best from cells where ploidy is not null) select uid, row_id, round(abs(ploidy - 2), 6) as off from (select *, row_number() over (partition by uid order by gini nulls last, row_id) rn from x where abs(ploidy - 2) <= best + 0.1) where rn = 1")
def latest_best(spark: SparkSession, d: str) -> DataFrame:
    """Of a UID's cells nearest to ploidy 2 (within a tolerance) the most even one."""
    x = cells(spark, d).where("ploidy is not null").withColumn("off", F.abs(F.col("ploidy") - 2))
    x = with_group(x, ["uid"], best=F.min("off")).where("off <= best + 0.1")
    return C.first_rows(x, ["uid"], [F.asc_nulls_last("gini"), F.asc("row_id")]).select("uid", "row_id", r6("off").alias("off"))


REPL = CELLS + """, q as (select uid, median(round(mapd, 3)) m, quantile_cont(round(mapd, 3), 0.25) q1, quantile_cont(round(mapd, 3), 0.75) q3, quantile_cont(gini, 0.25) i1, quantile_cont(gini, 0.75) i3 from cells group by 1),
 x as (select c.*, q.* exclude (uid) from cells c join q on c.uid = q.uid), s as (select uid, stddev_samp(case when round(mapd, 3) < m and round(mapd, 3) >= q1 - 1.5 * (q3 - q1) then round(mapd, 3) end) sd from x group by 1)
select row_id, round(m + 1.5 * sqrt(sd * sd / (1 - 2 / pi())), 6) as cutoff, coalesce(round(mapd, 3) > m + 1.5 * sqrt(sd * sd / (1 - 2 / pi())), false) or coalesce(gini > i3 + 1.5 * (i3 - i1), false) as is_replicating from x join s on x.uid = s.uid"""


@R.add(REPL)
def replicating_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose noise or unevenness stands out in their UID."""
    x = C.replicating(cells(spark, d).select("row_id", "uid", "mapd", "gini"), ["uid"], "mapd", "gini", k=1.5)
    return x.select("row_id", r6("cutoff").alias("cutoff"), "is_replicating")


@R.add(CELLS + "select row_id, not coalesce(abs(ploidy - median(ploidy) over (partition by uid)) <= 0.5, false) as is_outlier from cells")
def ploidy_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose ploidy is more than half a copy from their UID's median."""
    return C.off_median(cells(spark, d).select("row_id", "uid", "ploidy"), ["uid"], "ploidy", 0.5).select("row_id", "is_outlier")


@R.add(CELLS + """, x as (select row_id, uid, coverage, min(coverage) over (partition by uid) lo, max(coverage) over (partition by uid) hi from cells),
 y as (select *, avg(case when coverage > lo and coverage < hi then coverage end) over (partition by uid) mu, stddev_samp(case when coverage > lo and coverage < hi then coverage end) over (partition by uid) sd from x)
select row_id, coalesce(abs(coverage - mu) > 1.96 * sd, false) as outside from y""")
def band_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose coverage lies outside the band of their UID."""
    return C.bands(cells(spark, d).select("row_id", "uid", "coverage"), ["uid"], "coverage").select("row_id", "outside")


@R.add(SIGNAL + """, m as (select uid, chrom, bin_idx, median(calls) m from sig group by 1, 2, 3), u as (select *, m < quantile_cont(m, 0.1) over (partition by uid) low from m)
select chrom, bin_idx, bool_and(low) as all_low, bool_or(low) as any_low, count(*) filter (low) as n_low from u where low is not null group by 1, 2""")
def quorum_flags(spark: SparkSession, d: str) -> DataFrame:
    """Bins that are low in all, any and how many UIDs."""
    m = signal(spark, d).groupBy("uid", "chrom", "bin_idx").agg(F.median("calls").alias("m"))
    q = m.groupBy("uid").agg(F.percentile("m", F.lit(0.1)).alias("q"))
    u = m.join(q, "uid").withColumn("low", F.col("m") < F.col("q")).where("low is not null")
    return u.groupBy("chrom", "bin_idx").agg(F.bool_and("low").alias("all_low"), F.bool_or("low").alias("any_low"), F.count_if("low").alias("n_low"))


@R.add(CELLS + ", b as (select uid, count(*) n, sum(cast(is_paired as int)) k from cells group by 1) select uid, n, k = n or k = 0 as consistent from b")
def paired_check(spark: SparkSession, d: str) -> DataFrame:
    """UIDs whose cells are all paired or all single."""
    return cells(spark, d).groupBy("uid").agg(F.count("*").alias("n"), (F.bool_and("is_paired") | ~F.bool_or("is_paired")).alias("consistent"))


@R.add(CELLS + """, c as (select uid, read_size, count(*) n from cells where read_size is not null group by 1, 2), m as (select uid, read_size from (select *, row_number() over (partition by uid order by n desc, read_size) rn from c) where rn = 1)
select row_id, m.read_size as usual_size, round(used_reads * (cast(is_paired as int) + 1) * m.read_size / 3.2e9, 15) as depth from cells join m on cells.uid = m.uid""")
def read_length_mode(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent read size of each UID, and coverage by it."""
    from seriesloom.operators.metrics import modes

    c = cells(spark, d).select("row_id", "uid", "used_reads", "is_paired", "read_size")
    m = modes(c, ["uid"], "read_size").select("uid", F.col("mode").alias("usual_size"))
    return c.join(m, "uid").select("row_id", "usual_size", F.round(F.col("used_reads") * (F.col("is_paired").cast("int") + 1) * F.col("usual_size") / 3.2e9, 15).alias("depth"))


@R.add("""with n as (select chrom, chrom_rank, max(end_pos) size from bins group by 1, 2), o as (select *, coalesce(sum(size) over (order by chrom_rank rows between unbounded preceding and 1 preceding), 0) as off from n)
select b.chrom, b.bin_idx, cast(b.start_pos + o.off as bigint) as genome_start from bins b join o on b.chrom = o.chrom""")
def chrom_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Start of each bin counted from the start of the genome."""
    b = table(spark, d, "bins")
    n = b.groupBy("chrom", "chrom_rank").agg(F.max("end_pos").alias("size"))  # one row per chromosome
    o = n.select("chrom", F.coalesce(F.sum("size").over(Window.orderBy("chrom_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return b.join(F.broadcast(o), "chrom").select("chrom", "bin_idx", (F.col("start_pos") + F.col("off")).alias("genome_start"))


@R.add("""select uid, chrom, bin_idx, round(avg(segmented), 9) as mean_track, count(segmented) as support from assaydata group by 1, 2, 3""")
def track_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a track over the cells of a UID with its support."""
    return table(spark, d, "assaydata").groupBy("uid", "chrom", "bin_idx").agg(F.round(F.avg("segmented"), 9).alias("mean_track"), F.count("segmented").alias("support"))


@R.add("""with c as (select cast(floor((l_partkey - 1) / 100) as bigint) as bin, l_suppkey as series, count(*) n from lineitem group by 1, 2), g as (select s_suppkey series, b.bin from supplier cross join (select distinct cast(floor((p_partkey - 1) / 100) as bigint) as bin from part) b)
select g.series, g.bin, coalesce(c.n, 0) as n from g left join c on g.series = c.series and g.bin = c.bin""")
def bin_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each series per fixed-width bin of the position, empty bins included."""
    width = 100
    c = table(spark, d, "lineitem").groupBy(F.floor((F.col("l_partkey") - 1) / width).alias("bin"), F.col("l_suppkey").alias("series")).agg(F.count("*").alias("n"))
    top = table(spark, d, "part").agg(F.floor((F.max("p_partkey") - 1) / width).alias("top"), F.floor((F.min("p_partkey") - 1) / width).alias("low"))  # one row
    g = table(spark, d, "supplier").select(F.col("s_suppkey").alias("series")).crossJoin(F.broadcast(top)).select("series", F.explode(F.sequence("low", "top")).alias("bin"))
    return g.join(c, ["series", "bin"], "left").select("series", "bin", F.coalesce("n", F.lit(0)).alias("n"))


UNIQUE = """with r as (select l_suppkey series, l_partkey pos, l_orderkey fragment, l_linenumber line, l_linestatus = 'F' plus from lineitem),
 u as (select * from (select *, row_number() over (partition by series, pos, plus order by fragment, line) rn from r) where rn = 1),
 m as (select * exclude (rn) from (select * exclude (rn), row_number() over (partition by series, fragment order by line, pos, plus) rn from u) where rn = 1)
"""


@R.add(UNIQUE + "select series, cast(floor((pos - 1) / 100) as bigint) as bin, count(*) as n from m group by 1, 2")
def bin_counts_unique(spark: SparkSession, d: str) -> DataFrame:
    """Reads of each series per bin without duplicates (same place and strand) and with one mate of each fragment; bins without reads have no row."""
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("fragment"), F.col("l_linenumber").alias("line"), (F.col("l_linestatus") == "F").alias("plus"))
    m = C.one_mate(C.without_duplicates(r, ["series", "pos", "plus"], ["fragment", "line"]), ["series", "fragment"], ["line", "pos", "plus"])
    return m.groupBy("series", F.floor((F.col("pos") - 1) / 100).alias("bin")).agg(F.count("*").alias("n"))


@R.add(UNIQUE + "select series, pos, plus, case when plus then pos else pos + 75 end as start, count(*) over (partition by series, fragment) as mates from u")
def read_starts(spark: SparkSession, d: str) -> DataFrame:
    """First base of each read without duplicates: the place itself on the plus strand, the other end of a read of 76 bases on the minus strand; and the number of its fragment's reads."""
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("fragment"), F.col("l_linenumber").alias("line"), (F.col("l_linestatus") == "F").alias("plus"))
    u = C.without_duplicates(r, ["series", "pos", "plus"], ["fragment", "line"])
    u = u.join(u.groupBy("series", "fragment").agg(F.count("*").alias("mates")), ["series", "fragment"])
    return u.select("series", "pos", "plus", F.when(F.col("plus"), F.col("pos")).otherwise(F.col("pos") + 75).alias("start"), "mates")


@R.add(SIGNAL + """, k as (select name, chrom || ':' || start_pos || '-' || end_pos as key, chrom_rank from sig)
select name, key, split_part(key, ':', 1) as chrom, cast(split_part(split_part(key, ':', 2), '-', 1) as bigint) as start_bp, cast(split_part(split_part(key, ':', 2), '-', 2) as bigint) as end_bp,
 row_number() over (partition by name, split_part(key, ':', 1) order by cast(split_part(split_part(key, ':', 2), '-', 1) as bigint)) as place from k""")
def range_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys such as 1:1-25000000 as ranges in base pairs, and by their place among the cell's keys of the chromosome."""
    k = signal(spark, d).select("name", F.concat("chrom", F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string")).alias("key"))
    chrom, start, end = N.range_fields(F.col("key"))
    x = k.select("name", "key", chrom.alias("chrom"), start.alias("start_bp"), end.alias("end_bp"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("name", "chrom").orderBy("start_bp")).cast("bigint"))


@R.add(CELLS + INFO + "select c.cell, coalesce(i.quality, 0.5::double) as weight, round(c.ploidy * coalesce(i.quality, 0.5::double), 9) as weighted from cells c left join info i on c.cell = i.cell")
def cell_parameter(spark: SparkSession, d: str) -> DataFrame:
    """A parameter given for each cell, with one default for cells that have none: ploidy weighted by the quality of the annotation."""
    j = cells(spark, d).select("cell", "ploidy").join(info(spark, d).select("cell", "quality"), "cell", "left").withColumn("weight", F.coalesce("quality", F.lit(0.5)))
    return j.select("cell", "weight", F.round(F.col("ploidy") * F.col("weight"), 9).alias("weighted"))


@R.add(SIGNAL + "select chrom as chr, start_pos as \"start\", end_pos as \"end\", copynumber as state, round(segmented, 6) as copy, name as cell_id from sig where usable")
def export_signals(spark: SparkSession, d: str) -> DataFrame:
    """Usable bins in the form of the signal export."""
    return signal(spark, d).where("usable").select(F.col("chrom").alias("chr"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("copynumber").alias("state"), r6("segmented").alias("copy"), F.col("name").alias("cell_id"))


@R.add(SIGNAL + ", c as (select uid, name, avg(copynumber) m from sig group by 1, 2) select uid, greatest(2, round_even(median(m), 0)) as ploidy from c group by 1 having median(m) is not null")
def ploidy_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Usual whole ploidy of each UID, 2 at least."""
    c = signal(spark, d).groupBy("uid", "name").agg(F.avg("copynumber").alias("m"))
    return c.groupBy("uid").agg(F.median("m").alias("m")).where("m is not null").select("uid", F.greatest(F.lit(2.0), F.bround("m", 0)).alias("ploidy"))


@R.add(CELLS + SIGNAL.replace("with sig", ", sig") + ", k as (select name, median(segmented) m from sig group by 1) select s.name, s.chrom, s.bin_idx, round(s.segmented * 2 / k.m + 0.1, 6) as scaled, s.copynumber from sig s join k on s.name = k.name where k.m > 0")
def scale_apply(spark: SparkSession, d: str) -> DataFrame:
    """Segment levels scaled per cell to median 2 and shifted; other layers as they are."""
    s = signal(spark, d).select("name", "chrom", "bin_idx", "segmented", "copynumber")
    k = s.groupBy("name").agg(F.median("segmented").alias("m")).where("m > 0")
    return s.join(k, "name").select("name", "chrom", "bin_idx", r6(F.col("segmented") * 2 / F.col("m") + 0.1).alias("scaled"), "copynumber")


@R.add(CELLS + """, x as (select uid, avg(rpc) over (partition by uid) c, rpc - avg(rpc) over (partition by uid) x, rpc, used_reads::double / 1000 y from cells where rpc is not null and used_reads is not null),
 s as (select uid, count(*)::double n, min(c) c, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2 from x group by 1),
 z as (select *, nullif(n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2), 0) det from s where n >= 3),
 k as (select uid, n, c m, (n*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / det c2, (n*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1)) / det c1 from z)
select uid, n, round(c2, 3) + 0.0 as c, round(c1 - 2 * c2 * m, 2) + 0.0 as b from k""")
def quadratic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Reads as a quadratic function of reads per copy for UIDs with three cells or more."""
    x = cells(spark, d).where("used_reads is not null and rpc is not null").select("uid", "rpc", (F.col("used_reads").cast("double") / 1000).alias("y"))
    f = C.quadratic_fit(x, ["uid"], "rpc", "y")
    return f.select("uid", "n", (F.round("c", 3) + 0.0).alias("c"), (F.round("b", 2) + 0.0).alias("b"))  # no negative zeros


@R.add(SIGNAL + """, g as (select name, copynumber, count(calls) w, avg(calls) m, var_samp(calls) v from sig where copynumber >= 1 group by 1, 2 having count(calls) >= 2)
select name, round(sum(w * m * m * (v - m)) / nullif(sum(w * pow(m, 4)), 0), 6) as alpha from g group by 1""")
def wls_no_intercept(spark: SparkSession, d: str) -> DataFrame:
    """Over-dispersion of each cell: slope through the origin of variance minus mean on squared mean over its copy states."""
    g = signal(spark, d).where("copynumber >= 1").groupBy("name", "copynumber").agg(F.count("calls").alias("w"), F.avg("calls").alias("m"), F.var_samp("calls").alias("v")).where("w >= 2")
    g = g.select("name", "w", (F.col("m") * F.col("m")).alias("x"), (F.col("v") - F.col("m")).alias("y"))
    return g.groupBy("name").agg(r6(C.slope_through_origin("x", "y", "w")).alias("alpha"))


@R.add("select o_orderpriority as method, o_orderstatus as status, round(avg(abs(o_totalprice - m)), 3) as mean_error, round(stddev_samp(abs(o_totalprice - m)), 3) as sd_error from (select *, median(o_totalprice) over (partition by o_orderpriority) m from orders) group by 1, 2")
def weighted_error(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sd of the absolute error of a median forecast per method and group."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    o = with_group(o, ["o_orderpriority"], m=F.median("o_totalprice")).withColumn("e", F.abs(F.col("o_totalprice") - F.col("m")))
    return o.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("status")).agg(F.round(F.avg("e"), 3).alias("mean_error"), F.round(F.stddev_samp("e"), 3).alias("sd_error"))


@R.add(CELLS + "select row_id, 'hg19' as run_genome, 500 as run_bin_kb, '1-2-4' as run_ploidies, md5(concat_ws('|', cell, uid)) as run_digest from cells")
def stamp_run(spark: SparkSession, d: str) -> DataFrame:
    """Cells stamped with the parameters of a run; vectors become one text."""
    p = F.array_join(F.array(*[F.lit(str(x)) for x in (1, 2, 4)]), "-")
    return cells(spark, d).select("row_id", F.lit("hg19").alias("run_genome"), F.lit(500).alias("run_bin_kb"), p.alias("run_ploidies"), F.md5(F.concat_ws("|", "cell", "uid")).alias("run_digest"))


@R.add("select info_id as id, 'cellcycle_info' as src, recorded_at from cellcycle_info where coalesce(quality, 0) >= 0.8 union all select flag_id, 'flagstat', recorded_at from flagstat where qctotal > 100000")
def route_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows routed to a source by its name, then filtered by the rule of that source."""
    a = table(spark, d, "cellcycle_info").select(F.col("info_id").alias("id"), F.lit("cellcycle_info").alias("src"), "recorded_at", F.coalesce("quality", F.lit(0.0)).alias("q"), F.lit(None).cast("double").alias("t"))
    b = table(spark, d, "flagstat").select(F.col("flag_id").alias("id"), F.lit("flagstat").alias("src"), "recorded_at", F.lit(None).cast("double").alias("q"), F.col("qctotal").alias("t"))
    return a.unionByName(b).where(((F.col("src") == "cellcycle_info") & (F.col("q") >= 0.8)) | ((F.col("src") == "flagstat") & (F.col("t") > 100000))).select("id", "src", "recorded_at")


@R.add('select flag_id as "m.flag_id", qctotal as "m.qctotal", qcmapped as "m.qcmapped" from flagstat')
def affix_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns with a prefix."""
    return C.affix(table(spark, d, "flagstat").select("flag_id", "qctotal", "qcmapped"), prefix="m.")


@R.add(SIGNAL + ", k as (select name, chrom, list(copynumber order by chrom_rank, bin_idx) l from sig where copynumber is not null group by 1, 2) select name, chrom, i - 1 as place, l[i] as state from (select name, chrom, l, unnest(range(1, len(l) + 1)) i from k)")
def list_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lists as rows with their place: the known states of each cell and chromosome."""
    x = signal(spark, d).where("copynumber is not null").groupBy("name", "chrom").agg(F.sort_array(F.collect_list(F.struct("bin_idx", "copynumber"))).alias("l"))
    return x.select("name", "chrom", F.posexplode("l").alias("place", "v")).select("name", "chrom", F.col("place").cast("bigint").alias("place"), F.col("v.copynumber").alias("state"))


@R.add(CELLS + FLAGS + """, w as (select uid, row_number() over (order by n desc, uid) place from (select uid, count(*) n from cells where uid is not null group by 1))
select w.place, c.row_id, f.qcmapped from cells c join w on c.uid = w.uid join flags f on c.cell = f.cell""")
def order_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two tables put together by key (never by position) and placed in the order of a third."""
    c = cells(spark, d).select("cell", "uid", "row_id")
    w = c.where("uid is not null").groupBy("uid").agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    w = numbered(w, [], ["less", "uid"], "place").select("uid", "place")
    return c.join(w, "uid").join(flags(spark, d).select("cell", "qcmapped"), "cell").select("place", "row_id", "qcmapped").orderBy("place", "row_id")


@R.add("select info_id, recorded_at from cellcycle_info")
def complete_columns(spark: SparkSession, d: str) -> DataFrame:
    """Only the columns of the annotation that are never null."""
    return C.without_null_columns(table(spark, d, "cellcycle_info").select("info_id", "filename", "cellcycle", "recorded_at"))


QUERIES, ORACLES = R.queries, R.sql
