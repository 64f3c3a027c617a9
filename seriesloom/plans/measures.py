"""Queries on statistics of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.operators import metrics as M
from seriesloom.operators import runs
from seriesloom.operators.ordered import with_group
from seriesloom.plans.base import CELLS, SIGNAL, cells, signal
from seriesloom.plans.registry import Registry
from seriesloom.plans.signals import FILLED, PART, _segments
from seriesloom.util import r6, table

R = Registry()
BY, GENOME = ["name"], ["chrom_rank", "bin_idx"]


@R.add(SIGNAL + """, m as (select name, (lag(calls) over (partition by name order by chrom_rank, bin_idx) - calls) / nullif(avg(calls) over (partition by name), 0) dd from sig where calls is not null),
 x as (select name, dd, median(dd) over (partition by name) md from m) select name, round(median(abs(dd - md)), 6) as mapd from x group by 1""")
def mapd(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour noise of the reads of each cell."""
    return M.mapd(signal(spark, d).select("name", *GENOME, "calls"), BY, GENOME, "calls").select("name", r6("mapd").alias("mapd"))


GINI = """ select name{0}, count(*) n, 2 * sum(i * calls) / (count(*) * nullif(sum(calls), 0)) - (count(*) + 1) / count(*) gini from
 (select name{0}, calls, row_number() over (partition by name{0} order by calls) i from {1}) group by name{0} """


@R.add(SIGNAL + "select name, n, round(gini, 6) as gini from (" + GINI.format("", "sig where calls is not null") + ")")
def gini(spark: SparkSession, d: str) -> DataFrame:
    """Unevenness of the reads of each cell."""
    return M.gini(signal(spark, d).select("name", "calls"), BY, "calls").select("name", "n", r6("gini").alias("gini"))


@R.add(SIGNAL + "select name, round(sum(gini * n) / sum(case when gini is not null then n end), 6) as gini_norm from (" + GINI.format(", chrom, copynumber", "sig where calls is not null and copynumber > 0") + ") where n > 2 group by 1")
def gini_norm(spark: SparkSession, d: str) -> DataFrame:
    """Unevenness within bins of one chromosome and copy number."""
    g = M.gini_by_state(signal(spark, d).select("name", "chrom", "copynumber", "calls"), BY, ["chrom"], "copynumber", "calls", 2)
    return g.select("name", r6("gini_norm").alias("gini_norm"))


@R.add(SIGNAL + """select name, round(sum(calls / nullif(segmented, 0)) / count(case when usable then 1 end), 6) as rpc_segmented, round(avg(case when chrom not in ('X', 'Y') then calls / nullif(copynumber, 0) end), 6) as rpc_state, round(avg(segmented), 6) as ploidy from sig where usable group by 1""")
def rpc(spark: SparkSession, d: str) -> DataFrame:
    """Reads per copy, by segment level and by copy number, and mean ploidy of each cell."""
    s = signal(spark, d).where("usable")
    auto = ~F.col("chrom").isin("X", "Y")
    a = F.sum(F.col("calls") / F.nullif(F.col("segmented"), F.lit(0.0))) / F.count("*")
    b = F.avg(F.when(auto, F.col("calls") / F.nullif(F.col("copynumber"), F.lit(0))))
    return s.groupBy("name").agg(r6(a).alias("rpc_segmented"), r6(b).alias("rpc_state"), r6(F.avg("segmented")).alias("ploidy"))


@R.add(SIGNAL + """, r as (select name, avg(calls / nullif(copynumber, 0)) rpc from sig where chrom not in ('X', 'Y') group by 1)
select s.name, round(sqrt(sum(pow(calls / r.rpc - copynumber, 2))), 5) as l2 from sig s join r on s.name = r.name where r.rpc > 0 group by 1""")
def l2_error(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the scaled reads from the copy number."""
    s = signal(spark, d)
    r = s.where(~F.col("chrom").isin("X", "Y")).groupBy("name").agg(F.avg(F.col("calls") / F.nullif(F.col("copynumber"), F.lit(0))).alias("rpc")).where("rpc > 0")
    return s.join(r, "name").groupBy("name").agg(F.round(F.sqrt(F.sum(F.pow(F.col("calls") / F.col("rpc") - F.col("copynumber"), 2))), 5).alias("l2"))


@R.add(SIGNAL + """, v as (select name, chrom_rank, bin_idx, calls / nullif(avg(calls) over (partition by name), 0) v from sig where calls is not null),
 x as (select name, v - lag(v) over (partition by name order by chrom_rank, bin_idx) dd from v), q as (select name, quantile_cont(dd, 0.001) lo, quantile_cont(dd, 0.999) hi from x group by 1)
select x.name, round(var_samp(dd) / 2, 6) as obs_variance from x join q on x.name = q.name where dd between lo - 1e-9 and hi + 1e-9 group by 1""")
def obs_variance(spark: SparkSession, d: str) -> DataFrame:
    """Difference-based variance of the normalised reads."""
    return M.observed_variance(signal(spark, d).select("name", *GENOME, "calls"), BY, GENOME, "calls").select("name", r6("obs_variance").alias("obs_variance"))


DISCRETE = SIGNAL + """, t as (select name, copynumber c, ntile(4) over (partition by name order by calls, chrom_rank, bin_idx) r, ntile(4) over (partition by name order by gc, chrom_rank, bin_idx) g from sig where calls is not null and copynumber is not null and gc is not null)
"""


def _discrete(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).where("calls is not null and copynumber is not null and gc is not null")
    s = M.equal_frequency(s, BY, "calls", 4, GENOME, "r")
    return M.equal_frequency(s, BY, "gc", 4, GENOME, "g").select("name", F.col("copynumber").alias("c"), "r", "g")


@R.add(DISCRETE + """, j as (select name, r, g, count(*) k from t group by 1, 2, 3), p as (select name, k, sum(k) over (partition by name, r) kr, sum(k) over (partition by name, g) kg, sum(k) over (partition by name) n from j)
select name, round(sum(k / n * ln(k * n / (kr * kg))), 5) as mi from p group by 1""")
def mutual_info(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of reads and gc content in quartiles."""
    return M.mutual_information(_discrete(spark, d), BY, "r", "g").select("name", F.round("mi", 5).alias("mi"))


@R.add(DISCRETE + """, j as (select name, r, g, c, count(*) k from t group by 1, 2, 3, 4), p as (select name, k, sum(k) over (partition by name, r, c) krz, sum(k) over (partition by name, g, c) kgz, sum(k) over (partition by name, c) kz, sum(k) over (partition by name) n from j),
 e as (select name, c, count(*) k from t group by 1, 2), h as (select name, ln(sum(k)) - sum(k * ln(k)) / sum(k) h from e group by 1)
select p.name, round(sum(k / n * ln(k * kz / (krz * kgz))), 5) as cmi, round(min(h.h), 5) as state_entropy from p join h on p.name = h.name group by 1""")
def cond_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    """The same given the copy number, and the entropy of the copy number."""
    t = _discrete(spark, d)
    c = M.conditional_mutual_information(t, BY, "r", "g", "c").join(M.entropy(t, BY, ["c"], "state_entropy"), "name")
    return c.select("name", F.round("cmi", 5).alias("cmi"), F.round("state_entropy", 5).alias("state_entropy"))


@R.add(SIGNAL + "select name, count(calls) n, round(case when count(calls) >= 10 then skewness(calls) end, 5) as skew, round(case when count(calls) >= 10 then kurtosis(calls) end, 5) as kurt from sig group by 1 having stddev_pop(calls) > 0")
def spss_moments(spark: SparkSession, d: str) -> DataFrame:
    """Bias-corrected skewness and kurtosis of the reads of cells with ten bins or more."""
    x = signal(spark, d).groupBy("name").agg(F.count("calls").alias("n"), M.spss_skewness(F.col("calls")).alias("skew"), M.spss_kurtosis(F.col("calls")).alias("kurt"), F.stddev_pop("calls").alias("sd"))
    enough = F.col("n") >= 10
    return x.where("sd > 0").select("name", "n", F.round(F.when(enough, F.col("skew")), 5).alias("skew"), F.round(F.when(enough, F.col("kurt")), 5).alias("kurt"))


@R.add(FILLED + """, t as (select *, count(*) over (partition by name, chrom, seg_id) n0, row_number() over (partition by name, chrom, seg_id order by bin_idx) i from seg),
 s as (select name, chrom, seg_id, min(n0) len, skewness(calls) sk from t where n0 >= 6 and i > 1 and i <= n0 - 1 group by 1, 2, 3 having count(calls) > 2 and stddev_pop(calls) > 0),
 c as (select name, sk, len, sum(len) over (partition by name order by sk, chrom, seg_id rows unbounded preceding) cum, sum(len) over (partition by name) tot from s)
select name, round(min(case when 2 * cum >= tot then sk end), 5) as weighted_median_skew, count(*) as n_segments from c group by 1""")
def segment_moments(spark: SparkSession, d: str) -> DataFrame:
    """Length-weighted median of the skewness of long segments without their end bins."""
    s = _segments(spark, d).select(*PART, "bin_idx", "seg_id", "calls").withColumn("len", F.count("*").over(Window.partitionBy(*PART, "seg_id")))
    g = runs.smooth(s, PART, ["bin_idx"], "seg_id", [F.min("len").alias("len"), M.spss_skewness(F.col("calls")).alias("sk")], 6, 1).where("sk is not null")
    w = Window.partitionBy("name")
    c = g.withColumn("cum", F.sum("len").over(w.orderBy("sk", "chrom", "seg_id").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum("len").over(w))
    return c.groupBy("name").agg(F.round(F.min(F.when(2 * F.col("cum") >= F.col("tot"), F.col("sk"))), 5).alias("weighted_median_skew"), F.count("*").alias("n_segments"))


WEIGHTED = FILLED + ", g as (select name, chrom, seg_id, count(*) w, min(filled)::double x from seg where filled is not null group by 1, 2, 3)"


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where("filled is not null").groupBy(*PART, "seg_id").agg(F.count("*").alias("w"), F.first("filled").cast("double").alias("x"))


@R.add(WEIGHTED + """, e as (select name, x from g, unnest(range(w)) u(i)) select name, round(avg(x), 6) as mean_w, round(quantile_cont(x, 0.25), 6) as q1, round(median(x), 6) as q2, round(quantile_cont(x, 0.75), 6) as q3, round(stddev_samp(x), 5) as sd_w from e group by 1""")
def weighted_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, quartiles and sd of segment levels weighted by length."""
    g = _weighted(spark, d)
    mean = F.sum(F.col("x") * F.col("w")) / F.sum("w")
    return g.groupBy("name").agg(r6(mean).alias("mean_w"), *[r6(M.weighted_quantile("x", "w", q)).alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))], F.round(M.weighted_sd("x", "w"), 5).alias("sd_w"))


@R.add(SIGNAL + """, x as (select name, calls v, row_number() over (partition by name order by calls) i, count(*) over (partition by name) n, quantile_cont(calls, 0.95) over (partition by name) q from sig where calls is not null)
select name, round(avg(case when i <= floor(0.95::double * n) then v end), 6) as low95, round(avg(case when i <= floor(0.99::double * n) then v end), 6) as low99, round(avg(case when i > floor(0.05::double * n) and i <= n - floor(0.05::double * n) then v end), 6) as trim5, round(avg(case when v <= q then v end), 6) as upto95 from x group by 1""")
def trimmed_means(spark: SparkSession, d: str) -> DataFrame:
    """Truncated and trimmed means of the reads."""
    t = M.trimmed_means(signal(spark, d).select("name", "calls"), BY, "calls")
    return t.select("name", *[r6(c).alias(c) for c in ("low95", "low99", "trim5", "upto95")])


@R.add(SIGNAL + """, c as (select name, cast(round_even(segmented, 0) as int) m, count(*) n from sig where segmented is not null group by 1, 2) select name, m as mode, n from (select *, row_number() over (partition by name order by n desc, m) rn from c) where rn = 1""")
def mode_state(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent rounded segment level."""
    s = signal(spark, d).select("name", F.bround("segmented", 0).cast("int").alias("m"))
    return M.modes(s, BY, "m")


@R.add("""select least(greatest(bin_size, 0), 5000) as bin_kb, species, sum(cast(is_paired as int)) as paired, sum(cast(not is_paired as int)) as single, count(*) n, round(count(*) / sum(count(*)) over (partition by species), 6) as share from pdata group by 1, 2""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Rows of pdata by bin size, species and pairing, with shares inside each species."""
    p = table(spark, d, "pdata").withColumn("bin_kb", F.least(F.greatest("bin_size", F.lit(0)), F.lit(5000)))
    x = p.groupBy("bin_kb", "species").agg(F.sum(F.col("is_paired").cast("int")).alias("paired"), F.sum((~F.col("is_paired")).cast("int")).alias("single"), F.count("*").alias("n"))
    return x.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("species"))))


PHASES = """with t as (select cellcycle = 'S' truth, s_phase_prob > 0.5 pred from cellcycle_info where cellcycle is not null and s_phase_prob is not null and not isnan(s_phase_prob)),
 c as (select count(*) filter (truth and pred)::double tp, count(*) filter (not truth and pred)::double fp, count(*) filter (truth and not pred)::double fn, count(*) filter (not truth and not pred)::double tn from t)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity,
 round(((tp + tn) / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2)) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2), 0), 6) as kappa from c"""


@R.add(PHASES)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """S phase by annotation against S phase by probability, with the usual rates."""
    t = table(spark, d, "cellcycle_info").where(F.col("cellcycle").isNotNull() & F.col("s_phase_prob").isNotNull() & ~F.isnan("s_phase_prob"))
    a, b = F.col("cellcycle") == "S", F.col("s_phase_prob") > 0.5
    n = lambda c: F.sum(c.cast("double"))
    c = t.agg(F.coalesce(n(a & b), F.lit(0.0)).alias("tp"), F.coalesce(n(~a & b), F.lit(0.0)).alias("fp"), F.coalesce(n(a & ~b), F.lit(0.0)).alias("fn"), F.coalesce(n(~a & ~b), F.lit(0.0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = F.nullif(tp + fp + fn + tn, F.lit(0.0))
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    acc = (tp + tn) / total
    nz = lambda x: F.nullif(x, F.lit(0.0))
    return c.select("tp", "fp", "fn", "tn", r6(acc).alias("accuracy"), r6(tp / nz(tp + fn)).alias("sensitivity"), r6(tn / nz(tn + fp)).alias("specificity"), r6((acc - chance) / nz(1 - chance)).alias("kappa"))


@R.add(CELLS + """, x as (select uid, count(*) n, case when isfinite(corr(ploidy, gini)) then corr(ploidy, gini) end r from cells where ploidy is not null and gini is not null group by 1) select uid, n, round(r, 6) as r, round(r * sqrt((n - 2) / nullif(1 - r * r, 0)), 4) as t from x where n > 2""")
def corr_test(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of ploidy and unevenness per UID with its t value."""
    x = cells(spark, d).where("ploidy is not null and gini is not null").groupBy("uid").agg(F.count("*").alias("n"), M.correlation("ploidy", "gini").alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return x.where("n > 2").select("uid", "n", r6("r").alias("r"), F.round(t, 4).alias("t"))


@R.add(SIGNAL + """, m as (select name, median(calls + 1) m from sig group by 1) select chrom, bin_idx, round(median((calls + 1) / m), 6) as depth from sig s join m on s.name = m.name group by 1, 2""")
def read_depth_median(spark: SparkSession, d: str) -> DataFrame:
    """Median over cells of the reads of each bin, after cells were scaled by their median."""
    s = signal(spark, d).select("name", "chrom", "bin_idx", "calls")
    m = s.groupBy("name").agg(F.median(F.col("calls") + 1).alias("m"))
    return s.join(m, "name").groupBy("chrom", "bin_idx").agg(r6(F.median((F.col("calls") + 1) / F.col("m"))).alias("depth"))


@R.add(SIGNAL + """, c as (select name, copynumber x, cast(floor(segmented * 2) as int) y, count(*) k from sig where copynumber is not null and segmented is not null group by 1, 2, 3),
 p as (select a.name, sum(sign(b.y - a.y) * a.k * b.k)::bigint s from c a join c b on a.name = b.name and a.x < b.x group by 1)
select n.name, coalesce(p.s, 0) as s from (select distinct name from c) n left join p on n.name = p.name""")
def mann_kendall_s(spark: SparkSession, d: str) -> DataFrame:
    """Concordance of copy number and segment level (in halves) per cell."""
    s = signal(spark, d).select("name", F.col("copynumber").alias("x"), F.floor(F.col("segmented") * 2).cast("int").alias("y"))
    return M.kendall_s(s, BY, "x", "y")


@R.add(SIGNAL + """, v as (select name, calls x, gc y, mappability z from sig where calls is not null and gc is not null and mappability is not null),
 q as (select name, rank() over (partition by name order by x) + (count(*) over (partition by name, x) - 1) / 2 rx, rank() over (partition by name order by y) + (count(*) over (partition by name, y) - 1) / 2 ry, rank() over (partition by name order by z) + (count(*) over (partition by name, z) - 1) / 2 rz from v),
 c as (select name, corr(rx, ry) xy, corr(rx, rz) xz, corr(ry, rz) yz from q group by 1 having count(*) > 10)
select name, round((xy - xz * yz) / nullif(sqrt((1 - xz * xz) * (1 - yz * yz)), 0), 5) as rho from c""")
def partial_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of reads and gc without the part of mappability."""
    s = signal(spark, d).select("name", F.col("calls").alias("x"), F.col("gc").alias("y"), F.col("mappability").alias("z")).dropna()
    for c in "xyz":
        s = M.average_rank(s, BY, c, f"r{c}")
    c = s.groupBy("name").agg(F.count("*").alias("n"), M.correlation("rx", "ry").alias("xy"), M.correlation("rx", "rz").alias("xz"), M.correlation("ry", "rz").alias("yz")).where("n > 10")
    return c.select("name", F.round(M.partial_correlation(F.col("xy"), F.col("xz"), F.col("yz")), 5).alias("rho"))


@R.add(CELLS + "select row_id, uid, round((ploidy - avg(ploidy) over w) / nullif(stddev_samp(ploidy) over w, 0), 6) as z, round(median(ploidy) over w, 6) as usual from cells where ploidy is not null window w as (partition by uid)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """Ploidy of a cell against its UID, with the UID's median on every row."""
    z = with_group(M.standardise(cells(spark, d).where("ploidy is not null"), ["uid"], "ploidy"), ["uid"], usual=F.median("ploidy"))
    return z.select("row_id", "uid", r6("z").alias("z"), r6("usual").alias("usual"))


@R.add(CELLS + """, p as (select row_id, uid, gini p from cells where gini between 0 and 1), a as (select *, rank() over (partition by uid order by p) + count(*) over (partition by uid, p) - 1 i, count(*) over (partition by uid) m from p),
 q as (select *, p * m / i q0 from a) select row_id, round(least(min(q0) over (partition by uid order by p desc range between unbounded preceding and current row), 1), 4) as bh,
 round(least(min(q0 * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::double / i))) over (partition by uid order by p desc range between unbounded preceding and current row), 1), 4) as "by" from q""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """False-discovery rates of numbers between 0 and 1 within each UID."""
    p = cells(spark, d).where("gini between 0 and 1").select("row_id", "uid", F.col("gini").alias("p"))
    x = M.adjust_p(M.adjust_p(p, ["uid"], "p", "bh"), ["uid"], "p", "by", dependent=True)
    return x.select("row_id", F.round("bh", 4).alias("bh"), F.round("by", 4).alias("by"))


QUERIES, ORACLES = R.queries, R.sql
