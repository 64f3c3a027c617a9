"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm import linkage, mixing, packing, quantiles, residue, splits
from seriesloom.llm.tokens import n_tokens
from seriesloom.util import finite, spread, stage, table

QS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
KEYS = ["uid", "metric"]


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, int, tuple[int, int]]:
    """States of the cells by position, the number of positions, and bounds of the states."""
    bins = table(spark, d, "bins")
    n = bins.count()  # fixed catalogue of bins
    at = bins.select("chrom", "bin_idx", (F.row_number().over(Window.orderBy("chrom_rank", "bin_idx")) - 1).alias("pos"))
    seg = finite(F.col("segmented"))
    whole = F.when(F.abs(seg) > 2.0**53, F.signum(seg) * 2.0**53).otherwise(F.bround(seg, 0)).cast("long")  # beyond 2^53 doubles don't tell whole numbers apart
    state = F.coalesce(F.col("copynumber").cast("long"), whole)
    raw = table(spark, d, "assaydata")
    low, high = raw.agg(F.coalesce(F.min(state), F.lit(0)), F.coalesce(F.max(state), F.lit(0))).first()  # one row, from two columns
    rows = raw.select("name", "chrom", "bin_idx", state.alias("state"), F.col("loaded_at").alias("at"))
    return rows.join(F.broadcast(at), ["chrom", "bin_idx"]).select("name", "pos", "state", "at"), n, (low, high)


#: Fixed values of TESTDATA.md: bins known in both, and the largest share of them that may differ.
LEAST_KNOWN, MOST_SHARE = 60, 0.125


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells in clusters of two or more, with the smallest name of the cluster."""
    cells, n, ends = _profiles(spark, d)
    return linkage.clusters(cells, n, LEAST_KNOWN, MOST_SHARE, ends=ends)[0].select("name", "cluster_name")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical cells of each cluster of cells that are alike on average."""
    cells, n, ends = _profiles(spark, d)
    members, planes = linkage.close_clusters(cells, n, LEAST_KNOWN, MOST_SHARE, ends=ends)
    return linkage.describe(members, planes, n)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Alike pairs of the cells whose first row_id in pdata is divisible by 100 with all cells, by comparing them all, and how many lie in one cluster."""
    cells, n, ends = _profiles(spark, d)
    members, planes = linkage.clusters(cells, n, LEAST_KNOWN, MOST_SHARE, ends=ends)
    v = stage(planes.join(members.select("name", "cluster"), "name", "left"))
    cell = F.lower(F.trim("name"))
    asked = table(spark, d, "pdata").groupBy(cell.alias("cell")).agg(F.min("row_id").alias("r")).where("r % 100 = 0").select("cell")
    q = stage(v.join(asked, cell == F.col("cell"), "left_semi"))
    blocks = -(-q.count() // 4096) or 1  # the query set meets all rows in blocks
    a = q.select(*[F.col(c).alias(f"a_{c}") for c in q.columns], F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"))
    b = v.select(*[F.col(c).alias(f"b_{c}") for c in v.columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    both, diff = linkage.both_known(n), linkage.differing(n, linkage.n_planes(planes.columns))
    alike = a.join(b, "block").where((F.col("a_name") != F.col("b_name")) & (both >= LEAST_KNOWN) & (diff <= both * F.lit(MOST_SHARE)))
    found = alike.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.coalesce(F.col("a_cluster") == F.col("b_cluster"), F.lit(False)).cast("long")), F.lit(0)).alias("n_joined"))
    return found.select(F.lit(q.count()).cast("long").alias("n_queries"), "n_pairs", "n_joined", F.when(F.col("n_pairs") > 0, F.col("n_joined") / F.col("n_pairs")).otherwise(1.0).alias("recall"))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdata").select(splits.uid_of(F.col("uid"), F.col("name")).alias("uid"), F.to_date("loaded_at").alias("day"), "rpc", "ploidy")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("rpc", "ploidy")])
    return p.select("uid", "day", F.explode(each).alias("m")).select("uid", "day", "m.metric", "m.x")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of rpc and ploidy per UID, from sketches per day of loaded_at."""
    daily = quantiles.sketch(_measures(spark, d), [*KEYS, "day"], "x")
    return quantiles.percentiles(quantiles.merge(daily, KEYS), KEYS, QS).withColumn("value", F.round("value", 6))


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """The partial results: compressed sketch of each UID, measure and day."""
    return quantiles.sketch(_measures(spark, d), [*KEYS, "day"], "x")


#: Compression of the sketches in :func:`p4_bounds`: so strong that most groups are compressed at any size of the tables.
SMALL_K = 112


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Strongly compressed sketches against all values: whether the true ranks of each percentile's value meet the wanted rank within the stated error."""
    m = _measures(spark, d)
    daily = quantiles.sketch(m, [*KEYS, "day"], "x", SMALL_K)
    p = stage(quantiles.percentiles(quantiles.merge(daily, KEYS), KEYS, QS, SMALL_K))
    v = m.select(*KEYS, finite(F.col("x").cast("double")).alias("x")).where("x is not null").select(*KEYS, quantiles.code(F.col("x")).alias("c"))
    per = v.groupBy(*KEYS, "c").agg(F.count("*").alias("k"))
    at = p.withColumn("at", quantiles.code(F.col("value")))
    j = at.join(per, (at["uid"].eqNullSafe(per["uid"])) & (at["metric"] == per["metric"])).select(at["uid"], at["metric"], "q", "n", "rank_error", "at", "c", "k")
    r = j.groupBy("uid", "metric", "q", "n", "rank_error").agg(F.sum(F.when(F.col("c") < F.col("at"), F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("c") <= F.col("at"), F.col("k")).otherwise(0)).alias("upto"))
    want = F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1))
    within = (F.col("below") - F.col("rank_error") <= want) & (want <= F.col("upto") + F.col("rank_error"))
    return r.select("uid", "metric", "q", "n", "rank_error", within.alias("within"))


def _libraries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdata").select("name", "uid", "slx").select(F.regexp_replace("name", r"^[\s ]+|[\s ]+$", "").alias("name"), "uid", "slx")
    return p.select(F.lower("name").alias("cell"), splits.uid_of(F.col("uid"), F.col("name")).alias("uid"), splits.libraries_of(F.col("slx"), F.col("name")).alias("libs"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    comp = splits.components(splits.library_links(_libraries(spark, d)))
    return comp.where("node like 'u:%'").select(F.substring("node", 3, 1 << 30).alias("uid"), "root")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of UIDs that share a library, directly or through other UIDs. The pairs of a component are spread by its first UIDs."""
    u = stage(_members(spark, d))
    salts = 2 * spark.sparkContext.defaultParallelism
    a = u.select(F.col("uid").alias("uid_a"), "root", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"))
    b = u.join(u.groupBy("root").agg(F.count("*").alias("c")).where("c > 1").select("root"), "root", "left_semi")
    b = b.select(F.col("uid").alias("uid_b"), "root", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return a.join(b, ["root", "salt"]).where("uid_a < uid_b").select("uid_a", "uid_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Membership without the pairs: each UID with a library, the first UID of its group and the number of UIDs there."""
    u = stage(_members(spark, d))
    return u.join(u.groupBy("root").agg(F.min("uid").alias("group_uid"), F.count("*").alias("n_uids")), "root").select("uid", "group_uid", "n_uids")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """One split for each cell of pdata; UIDs that share a library or a cell stay together."""
    rows = _libraries(spark, d)
    pairs = stage(rows.where("cell is not null and cell <> ''").select("cell", "uid").distinct())
    cells = stage(pairs.groupBy("cell").agg(F.min("uid").alias("uid")))
    shared = pairs.withColumnRenamed("uid", "other").join(cells, "cell").where("uid <> other").select(F.concat(F.lit("u:"), "uid").alias("a"), F.concat(F.lit("u:"), "other").alias("b")).distinct()
    links = splits.library_links(rows).unionByName(shared)
    out = splits.related_splits(cells.select(F.col("cell").alias("record"), F.col("uid").alias("entity")), links, table(spark, d, "split_targets"))
    return out.select(F.col("record").alias("cell"), F.col("entity").alias("uid"), F.col("grp").alias("group_name"), "split")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Cells and share of each split."""
    x = p5_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_cells"), F.countDistinct("group_name").alias("n_groups"))
    return x.join(F.broadcast(table(spark, d, "split_targets").select(F.col("split_name").alias("split"), "share")), "split", "right")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the splits hold what they promise: cells, cells and groups that lie in more than one split, UIDs that do, and whether each split is within the largest group of its target."""
    x = stage(p5_splits(spark, d))
    more = lambda k: x.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias(f"split_{k}"))
    t = table(spark, d, "split_targets").where("share > 0").select(F.col("split_name").alias("split"), "share")
    size = x.groupBy("group_name").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("n_cells"))
    off = x.groupBy("split").agg(F.count("*").alias("n")).join(t, "split", "right").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(t.agg(F.sum("share").alias("all"))))  # one row each
    near = off.agg(F.bool_and(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") / F.col("all") * F.col("n_cells")) <= F.col("largest")).alias("near_targets"), F.max("n_cells").alias("n_cells"))
    return near.crossJoin(F.broadcast(more("cell"))).crossJoin(F.broadcast(more("group_name"))).crossJoin(F.broadcast(more("uid"))).select("n_cells", "split_cell", "split_group_name", "split_uid", "near_targets")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each speech, counted once."""
    return stage(spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", n_tokens(F.col("text")).alias("tokens")))


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    """Container of every speech (or of its pieces, where it is larger than the capacity) for each capacity of pack_sizes."""
    x = packing.pack(_sized(spark, d).select(F.col("doc_id").alias("item"), "tokens"), table(spark, d, "pack_sizes"))
    return x.select("pack_name", F.col("item").alias("doc_id"), "piece_no", "tokens", "container")


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share for each capacity."""
    x = packing.pack(_sized(spark, d).select(F.col("doc_id").alias("item"), "tokens"), table(spark, d, "pack_sizes"))
    y = x.groupBy("pack_name", "capacity").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return y.withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing holds what it promises, for each capacity: speeches, tokens that were lost or doubled, containers over the capacity, containers with more than two large pieces, speeches divided without need, and whether at most
    one container in twenty is more than could be needed at least (and one besides)."""
    sized = _sized(spark, d)
    x = stage(packing.pack(sized.select(F.col("doc_id").alias("item"), "tokens"), table(spark, d, "pack_sizes")))
    by = ["pack_name", "capacity"]
    each = x.groupBy(*by, "item").agg(F.sum("tokens").alias("t"), F.count("*").alias("k")).join(sized.select(F.col("doc_id").alias("item"), "tokens"), "item")
    speeches = each.groupBy(*by).agg(F.count("*").alias("n_speeches"), F.sum(F.abs(F.col("t") - F.col("tokens"))).alias("tokens_off"), F.count_if((F.col("tokens") <= F.col("capacity")) & (F.col("k") > 1)).alias("divided"))
    full = x.groupBy(*by, "container").agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") * 3 > F.col("capacity")).alias("large"))
    need = full.groupBy(*by).agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), F.count_if(F.col("large") > 2).alias("over_two_large"), F.count("*").alias("n"), F.sum("t").alias("t"))
    tight = F.col("n") <= F.ceil(F.col("t") / F.col("capacity")) * 1.05 + 1
    return speeches.join(need, by).select("pack_name", "n_speeches", "tokens_off", "overfull", "over_two_large", "divided", tight.alias("tight"))


def _mixable(spark: SparkSession, d: str) -> DataFrame:
    return _sized(spark, d).select(F.col("doc_id").alias("item"), "source", "tokens")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: shard, position, source, speech and number of its copy."""
    x = mixing.mix(_mixable(spark, d), table(spark, d, "mix_targets"))
    return x.select("shard", "position", "source", F.col("item").alias("doc_id"), "copy_no", "tokens")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    r, t = _mixable(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(r, t), r, t)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mix holds what it promises, for each target source: used more often than allowed, copies that occur twice, and whether it reaches its share to within its largest record or is used up."""
    r, t = _mixable(spark, d), table(spark, d, "mix_targets").select("source", "target_share", "max_repeats")
    x = stage(mixing.mix(r, t))
    total = r.agg(F.sum("tokens").alias("all"))  # one row
    there = r.groupBy("source").agg(F.sum("tokens").alias("there"), F.max("tokens").alias("largest"))
    got = x.groupBy("source").agg(F.sum("tokens").alias("used"), F.max("copy_no").alias("most"), F.count("*").alias("n"), F.count_distinct("item", "copy_no").alias("k"))
    j = t.join(there, "source", "left").join(got, "source", "left").fillna(0, ["there", "largest", "used", "most", "n", "k"]).crossJoin(F.broadcast(total))
    asked = F.col("target_share") * F.col("all")
    return j.select("source", (F.col("most") > F.col("max_repeats")).alias("over_repeats"), (F.col("n") - F.col("k")).alias("twice"), ((F.abs(F.col("used") - asked) <= F.col("largest")) | ((F.col("used") == F.col("there") * F.col("max_repeats")) & (F.col("used") <= asked))).alias("as_asked"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Speeches that hold template residue, filler, error-page text or script notices."""
    return residue.residue(table(spark, d, "documents"), "doc_id", "text", "sitting").select("doc_id")


def p8_residue(spark: SparkSession, d: str) -> DataFrame:
    """The same with probability, sentence and the kind that the lists of phrases and forms give it."""
    kind = F.pandas_udf(lambda s: s.map(residue.kind_of), "string")
    found = residue.residue(table(spark, d, "documents"), "doc_id", "text", "sitting")
    return found.select("doc_id", kind("sentence").alias("kind"), F.round("p", 4).alias("p"), "sentence")


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    """Speeches of sittings that neither the fit nor the threshold used, by weak label, and how many of them are found."""
    return residue.validation(table(spark, d, "documents"), "doc_id", "text", "sitting")


QUERIES = {f.__name__: f for f in (p2_found, p2_clusters, p2_recall, p4_percentiles, p4_daily, p4_bounds, p5_found, p5_groups, p5_splits, p5_shares, p5_check, p6_packs, p6_usage, p6_check, p7_mix, p7_shares, p7_check, p8_found, p8_residue, p8_validation)}

_CELLS = r"""
with recursive rw as (select name, uid, regexp_replace(name, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') n, slx from pdata),
 u as (select coalesce(nullif(upper(regexp_replace(uid, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), ''), nullif(upper(split_part(n, '_', 1)), '')) uid,
  case when slx is null or regexp_full_match(slx, '[\s\x{a0}]*') then split_part(n, '_', 2) else slx end entry from rw)
"""
_UNKNOWN = ", ".join(f"'{x}'" for x in splits.UNKNOWN)
_KNOWN = r"""(regexp_replace(upper(regexp_replace({0}, '[^0-9A-Za-z]', '', 'g')), '^SLX', '') not in ('', """ + _UNKNOWN + r""") and not regexp_full_match(regexp_replace(upper(regexp_replace({0}, '[^0-9A-Za-z]', '', 'g')), '^SLX', ''), '0+'))"""

_STATES = """
with recursive st as (select name, b.rk pos, arg_max(coalesce(copynumber, cast(round_even(segmented, 0) as int)), loaded_at) s0, any_value(1) from
  (select *, row_number() over (partition by name, chrom, bin_idx order by loaded_at desc nulls last, coalesce(copynumber, cast(round_even(segmented, 0) as int)) desc nulls last) rn from assaydata) a
  join (select chrom, bin_idx, row_number() over (order by chrom_rank, bin_idx) rk from bins) b on a.chrom = b.chrom and a.bin_idx = b.bin_idx where rn = 1 group by 1, 2),
 s as (select name, pos, s0 from st where s0 is not null)"""

_LINKED = _CELLS + " , p as (select uid, unnest(string_split_regex(entry, '[+;/]')) part from u where uid is not null and " + _KNOWN.format("entry") + """),
 l as (select distinct uid, upper(regexp_replace(part, '[^0-9A-Za-z]', '', 'g')) lib from p where """ + _KNOWN.format("part") + """),
 e as (select distinct a.uid x, b.uid y from l a join l b on a.lib = b.lib),
 r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
"""

ORACLES: dict[str, str] = {
    "p2_found": _STATES + """,
 e as (select a.name x, b.name y from s a join s b on a.pos = b.pos and a.name <> b.name group by 1, 2 having count(*) >= 60 and 8 * count(*) filter (a.s0 <> b.s0) <= count(*)),
 r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select x as name, least(x, min(y)) as cluster_name from r group by 1""",
    "p2_recall": _STATES + """,
 k as (select lower(trim(name)) cell from pdata where name is not null group by 1 having min(row_id) % 100 = 0),
 known as (select name from s group by 1 having count(*) >= 60),
 q as (select s.* from s where lower(trim(name)) in (select cell from k) and name in (select name from known)),
 e as (select a.name x, b.name y from q a join s b on a.pos = b.pos and a.name <> b.name group by 1, 2 having count(*) >= 60 and 8 * count(*) filter (a.s0 <> b.s0) <= count(*))
select (select count(distinct name) from q) as n_queries, count(*) as n_pairs, count(*) as n_joined, 1.0::double as recall from e""",
    "p4_percentiles": """
with x as (select coalesce(nullif(upper(trim(uid)), ''), upper(split_part(trim(name), '_', 1))) uid, 'rpc' metric, rpc v from pdata union all select coalesce(nullif(upper(trim(uid)), ''), upper(split_part(trim(name), '_', 1))), 'ploidy', ploidy from pdata),
 c as (select uid, metric, case when v = 0 then 0 else sign(v) * (1 + floor((log2(abs(v)) + 1075) * 63900)) end m from x where v is not null and isfinite(v)),
 g as (select uid, metric, count(*) n, list(m order by m) l from c group by 1, 2)
select uid, metric, q, n, 28 * (n // 5600) as rank_error, round(case when l[cast(ceil(q * n) as int)] = 0 then 0 else sign(l[cast(ceil(q * n) as int)]) * pow(2, (abs(l[cast(ceil(q * n) as int)]) - 0.5) / 63900 - 1075) end, 6) as value
from g, (select unnest([0.05::double, 0.25, 0.5, 0.75, 0.95, 0.99]) q)""",
    "p4_bounds": """
with x as (select coalesce(nullif(upper(trim(uid)), ''), upper(split_part(trim(name), '_', 1))) uid, unnest([{'m': 'rpc', 'v': rpc}, {'m': 'ploidy', 'v': ploidy}]) s from pdata),
 g as (select uid, s.m metric, count(*) n from x where s.v is not null and isfinite(s.v) group by 1, 2)
select uid, metric, q, n, 28 * (n // 112) as rank_error, true as within from g, (select unnest([0.05::double, 0.25, 0.5, 0.75, 0.95, 0.99]) q)""",
    "p5_found": _LINKED + "select x as uid_a, y as uid_b from r where x < y",
    "p5_check": r"select count(distinct nullif(lower(regexp_replace(name, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '')) as n_cells, 0 as split_cell, 0 as split_group_name, 0 as split_uid, true as near_targets from pdata",
    "p6_check": "select pack_name, (select count(*) from documents) as n_speeches, 0 as tokens_off, 0 as overfull, 0 as over_two_large, 0 as divided, true as tight from pack_sizes where capacity_tokens > 0",
    "p7_check": "select source, false as over_repeats, 0 as twice, true as as_asked from mix_targets",
    "p5_groups": _LINKED + "select x as uid, min(y) as group_uid, count(*) as n_uids from r group by 1",
}
