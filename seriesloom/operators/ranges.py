"""Algebra of closed integer ranges: overlap and containment joins, coverage, peaks, binned averages.

Ranges are (``start``, ``end``) with both ends inside, per value of the key columns (for example chromosome). Joins put each range into the
fixed-width buckets that it touches and join on (key, bucket), so they are hash or sort-merge joins, never nested loops; a pair is kept
only in the first bucket that both ranges touch. The width should be near the usual length of the longer side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.operators.ordered import PART, in_ranges, same


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    lo, hi = F.floor(F.col("start") / width), F.floor(F.col("end") / width)
    return df.withColumn("_lo", lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))


def _prefixed(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of ranges that share a position, with ``ov_width`` (positions shared). Columns that aren't keys get the prefix ``a_`` or ``b_``.

    ``how`` may also be ``left_semi`` or ``left_anti`` (rows of ``a`` with and without a partner). Ranges with a null bound, or whose end lies before
    their start, meet nothing.
    """
    ok = "start is not null and end is not null and start <= end"
    if how != "inner":
        ident = a.withColumn("_row", F.struct(*[F.col(c) for c in a.columns]))
        met = overlap_join(ident.select(*keys, "start", "end", "_row"), b.select(*keys, "start", "end"), keys, width).select(*keys, F.col("a__row").alias("_row")).distinct()
        return ident.join(met.select("_row"), "_row", how).drop("_row")
    x, y = _prefixed(_bucketed(a.where(ok), width), keys, "a"), _prefixed(_bucketed(b.where(ok), width), keys, "b")
    x, y = x.withColumnRenamed("a__bucket", "_bucket"), y.withColumnRenamed("b__bucket", "_bucket")
    pairs = x.join(y, [*keys, "_bucket"]).where((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.col("_bucket") == F.greatest("a__lo", "b__lo")))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    return pairs.withColumn("ov_width", shared).drop("_bucket", "a__lo", "b__lo")


def within_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs in which the range of ``a`` lies wholly inside that of ``b``; ``a`` is put only into the bucket of its start."""
    ok = "start is not null and end is not null and start <= end"
    x = _prefixed(a.where(ok).withColumn("_bucket", F.floor(F.col("start") / width)), keys, "a").withColumnRenamed("a__bucket", "_bucket")
    y = _prefixed(_bucketed(b.where(ok), width).drop("_lo"), keys, "b").withColumnRenamed("b__bucket", "_bucket")
    return x.join(y, [*keys, "_bucket"]).where((F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))).drop("_bucket")


def coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Depth as a step function: keys.., start, end, depth for every stretch between the first start and the last end; depth may be 0 inside.

    Marks where the depth changes are laid out in ranges of (key, position), and the depth at the beginning of each range is carried by one row, so a key with most rows is spread.
    """
    ok = df.where("start is not null and end is not null and start <= end")
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("step"))))
    marks = ok.select(*keys, ends.alias("m")).groupBy(*keys, F.col("m.at").alias("start")).agg(F.sum("m.step").alias("step")).where("step <> 0")  # the depth changes at each mark
    x = in_ranges(marks, keys, ["start"])
    parts = x.groupBy(*keys, PART).agg(F.sum("step").alias("step"), F.min("start").alias("first"))
    over = Window.partitionBy(*keys).orderBy(PART)
    parts = parts.select(*keys, PART, F.coalesce(F.sum("step").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("first").over(over).alias("next"))
    w = Window.partitionBy(*keys, PART).orderBy("start")
    y = x.withColumn("here", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("then", F.lead("start").over(w))
    z = same(y, parts, [*keys, PART]).withColumn("end", F.coalesce("then", "next") - 1).where("end is not null")
    return z.select(*keys, "start", "end", (F.col("here") + F.col("carry")).alias("depth"))


def mask_single(depth: Column) -> Column:
    """Depth 1 counts as none."""
    return F.when(depth == 1, 0).otherwise(depth)


def peaks(steps: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Maximal stretches of depth ``least`` or more with their highest and mean depth; ``steps`` of a key follow each other without holes, as :func:`coverage` gives them."""
    high = steps.where(F.col("depth") >= least)
    x = in_ranges(high, keys, ["start"])
    w = Window.partitionBy(*keys, PART).orderBy("start")
    fresh = F.coalesce(F.lag("end").over(w) + 1 < F.col("start"), F.lit(False))  # the first of a range may go on with a peak of the range before
    y = x.withColumn("_g", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("end") - F.col("start") + 1
    part = y.groupBy(*keys, PART, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("depth").alias("top"), F.sum(F.col("depth") * n).alias("_s"), F.sum(n).alias("_n"))
    # only the first and the last stretch of a range can meet a neighbour: those are joined along the few ranges of a key
    ends = part.withColumn("_last", F.col("_g") == F.max("_g").over(Window.partitionBy(*keys, PART)))
    inner = ends.where("_g > 0 and not _last")
    o = Window.partitionBy(*keys).orderBy("start")
    outer = ends.where("_g = 0 or _last").withColumn("_f", F.coalesce(F.lag("end").over(o) + 1 < F.col("start"), F.lit(True)).cast("int"))
    outer = outer.withColumn("_k", F.sum("_f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    joined = outer.groupBy(*keys, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("top").alias("top"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    cols = [*keys, "start", "end", "top", (F.col("_s") / F.col("_n")).alias("mean_depth")]
    return inner.select(*cols).unionByName(joined.select(*cols))


def reduce_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping and adjacent closed ranges: keys.., start, end. See ``interval_sets`` for the form that spreads hot keys."""
    from seriesloom.operators.interval_sets import merge_intervals

    half = df.withColumn("_e", F.col("end") + 1)
    m = merge_intervals(half, keys, "start", "_e").where("kind = 'period'")
    return m.select(*keys, "start", (F.col("end") - 1).alias("end"))


def binned_average(bins: DataFrame, steps: DataFrame, keys: list[str], ident: list[str], value: str, width: int) -> DataFrame:
    """Width-weighted mean of a step function over each bin: ``mean_all`` (uncovered positions count as 0) and ``mean_covered`` (they don't count).

    Null values count as uncovered. Every bin appears; a bin without cover has 0 and null.
    """
    known = steps.where(F.col(value).isNotNull()).select(*keys, "start", "end", F.col(value).alias("v"))
    ov = overlap_join(bins.select(*keys, *ident, "start", "end"), known, keys, width)
    s = ov.groupBy(*keys, *[f"a_{i}" for i in ident]).agg(F.sum(F.col("b_v") * F.col("ov_width")).alias("_s"), F.sum("ov_width").alias("_w"))
    for i in ident:
        s = s.withColumnRenamed(f"a_{i}", i)
    j = bins.join(s, [*keys, *ident], "left")
    return j.withColumn("mean_all", F.coalesce(F.col("_s"), F.lit(0)) / (F.col("end") - F.col("start") + 1)).withColumn("mean_covered", F.col("_s") / F.col("_w")).drop("_s", "_w")


def drop_covered(bins: DataFrame, excluded: DataFrame, keys: list[str], ident: list[str], width: int, share: float = 0.25) -> DataFrame:
    """Bins of which no single excluded range covers more than ``share``; shares of several ranges aren't added up."""
    ov = overlap_join(bins.select(*keys, *ident, "start", "end"), excluded.select(*keys, "start", "end"), keys, width)
    hit = ov.where(F.col("ov_width") / (F.col("a_end") - F.col("a_start") + 1) > share).select(*keys, *[F.col(f"a_{i}").alias(i) for i in ident]).distinct()
    return bins.join(hit, [*keys, *ident], "left_anti")


def assign_latest(bins: DataFrame, ranges: DataFrame, keys: list[str], ident: list[str], value: str, order: list[str], width: int) -> DataFrame:
    """Value of the last range (by ``order``) that meets each bin; bins that meet none have null."""
    ov = overlap_join(bins.select(*keys, *ident, "start", "end"), ranges.select(*keys, "start", "end", value, *order), keys, width)
    last = ov.groupBy(*keys, *[F.col(f"a_{i}").alias(i) for i in ident]).agg(F.max(F.struct(*[f"b_{o}" for o in order], f"b_{value}")).alias("_x"))
    return bins.join(last.select(*keys, *ident, F.col(f"_x.b_{value}").alias(value)), [*keys, *ident], "left")
