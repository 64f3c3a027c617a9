"""Joins, reshapes and rules on tables of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.operators.ordered import ranked, with_group


def join_suffix(a: DataFrame, b: DataFrame, on: list[str], suffix: str, how: str = "left") -> DataFrame:
    """Join in which columns of ``b`` that ``a`` also has get a suffix and the others keep their names."""
    clash = {c: f"{c}{suffix}" for c in b.columns if c in a.columns and c not in on}
    return a.join(b.withColumnsRenamed(clash), on, how)


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both have."""
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def tolerance_match(a: DataFrame, b: DataFrame, keys: list[str], at: str, within: int) -> DataFrame:
    """Rows of ``a`` that have a row of ``b`` with equal keys at most ``within`` places away; an equi-join on widened places, not a band join."""
    wide = b.where(F.col(at).isNotNull()).select(*keys, F.explode(F.sequence(F.col(at) - within, F.col(at) + within)).alias(at))
    return a.join(wide, [*keys, at], "left_semi")


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order, with all columns."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def without_duplicates(reads: DataFrame, place: list[str], order: list[str]) -> DataFrame:
    """One read, the first by ``order``, of those at the same place (series, position, strand); reads with nulls in the place are alike there. Aggregated with partial results, so a place of very many reads isn't gathered."""
    rest = [c for c in reads.columns if c not in place and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_x")
    return reads.groupBy(*place).agg(first).select(*place, *[F.col(f"_x.{c}").alias(c) for c in [*order, *rest]]).select(*reads.columns)


def one_mate(reads: DataFrame, fragment: list[str], order: list[str]) -> DataFrame:
    """The first read of each fragment by ``order``."""
    return without_duplicates(reads, fragment, order)


def top_share(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Rows among the highest ``share`` of each group; ties at the border are all kept. Null values are never kept."""
    x = with_group(df.where(F.col(value).isNotNull()).withColumn("_d", -F.col(value)), by, _n=F.count("*"))
    return ranked(x, by, "_d", "_r").where(F.col("_r") <= F.floor(share * F.col("_n"))).drop("_r", "_n", "_d")


def hash_sample(df: DataFrame, ident: list[str], share: float, seed: int = 0) -> DataFrame:
    """Reproducible sample: the rows whose MD5 digest of seed and ``ident`` (texts joined by ``|``) begins in the given share of the range."""
    edge = min(max(round(share * 16**8), 0), 16**8)
    return df.where(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident])), 1, 8) < F.lit(f"{edge:08x}" if edge < 16**8 else "g"))


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Long form of several columns."""
    return df.unpivot(ids, values, name, value)


def complete_positions(df: DataFrame, series: list[str], position: list[str], value: str) -> DataFrame:
    """Rows of the positions that have a value in every series."""
    have = df.where(F.col(value).isNotNull())
    n = have.select(*series).distinct().agg(F.count("*").alias("_all"))  # one row
    full = have.groupBy(*position).agg(F.count_distinct(*series).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all"))
    return have.join(full.select(*position), position, "left_semi")


def union_lenient(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(frames: list[DataFrame]) -> DataFrame:
    """All rows with the columns that every frame has, in the order of the first."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def without_null_columns(df: DataFrame) -> DataFrame:
    """Only the columns that have no null in any row; counts the nulls of all columns in one pass."""
    n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if not n[c]])


def affix(df: DataFrame, prefix: str = "", suffix: str = "", but: tuple[str, ...] = ()) -> DataFrame:
    """Prefix and suffix on every column name."""
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in but})


def replicating(df: DataFrame, batch: list[str], activity: str, info: str, k: float = 1.0, iqr: float = 1.5, hard: float | None = None) -> DataFrame:
    """Marks records whose activity is far above their batch's.

    Per batch: median of the activity; half-normal sd of the values between the lower whisker and the median, sqrt(sd^2 / (1 - 2 / pi)); a
    record is out if its activity exceeds median + k sd, its ``info`` exceeds the third quartile by ``iqr`` times the quartile range, or its
    activity exceeds ``hard``. Adds cutoff and is_replicating; null measures are never out.
    """
    a = F.round(activity, 3)
    q = df.groupBy(*batch).agg(F.median(a).alias("_m"), F.percentile(a, F.lit(0.25)).alias("_q1"), F.percentile(a, F.lit(0.75)).alias("_q3"), F.percentile(info, F.lit(0.25)).alias("_i1"), F.percentile(info, F.lit(0.75)).alias("_i3"))
    x = df.join(q, batch)
    low = (a < F.col("_m")) & (a >= F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1")))
    s = x.groupBy(*batch).agg(F.stddev_samp(F.when(low, a)).alias("_sd"))
    y = x.join(s, batch).withColumn("cutoff", F.col("_m") + k * F.sqrt(F.col("_sd") * F.col("_sd") / (1 - 2 / F.lit(3.141592653589793))))
    out = F.coalesce(a > F.col("cutoff"), F.lit(False)) | F.coalesce(F.col(info) > F.col("_i3") + iqr * (F.col("_i3") - F.col("_i1")), F.lit(False))
    if hard is not None:
        out = out | F.coalesce(F.col(activity) > hard, F.lit(False))
    return y.withColumn("is_replicating", out).drop("_m", "_q1", "_q3", "_i1", "_i3", "_sd")


def off_median(df: DataFrame, batch: list[str], value: str, within: float, out: str = "is_outlier") -> DataFrame:
    """Marks values more than ``within`` from their batch's median; null values are marked too."""
    return with_group(df, batch, _m=F.median(value)).withColumn(out, ~F.coalesce(F.abs(F.col(value) - F.col("_m")) <= within, F.lit(False))).drop("_m")


def bands(df: DataFrame, batch: list[str], value: str, k: float = 1.96) -> DataFrame:
    """Marks values outside mean ± k sd of their batch, where the batch's extremes are left out of mean and sd."""
    x = with_group(df, batch, _lo=F.min(value), _hi=F.max(value))
    inner = F.when((F.col(value) > F.col("_lo")) & (F.col(value) < F.col("_hi")), F.col(value))
    x = with_group(x, batch, _mu=F.avg(inner), _sd=F.stddev_samp(inner))
    return x.withColumn("outside", F.coalesce(F.abs(F.col(value) - F.col("_mu")) > k * F.col("_sd"), F.lit(False))).drop("_lo", "_hi", "_mu", "_sd")


def quadratic_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares y = a + b x + c x^2 per group from summed moments of centred x, solved in closed form; null where x has fewer than 3 values."""
    m = with_group(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, _m=F.avg(x)).withColumn("_x", F.col(x) - F.col("_m"))
    p = lambda k: F.sum(F.pow("_x", F.lit(float(k))))
    s = m.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.first("_m").alias("_m"), p(1).alias("s1"), p(2).alias("s2"), p(3).alias("s3"), p(4).alias("s4"), F.sum(y).alias("t0"), F.sum(F.col("_x") * F.col(y)).alias("t1"), F.sum(F.pow("_x", F.lit(2.0)) * F.col(y)).alias("t2"))
    det = "(n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))"
    a = F.expr(f"(t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / nullif({det}, 0)")
    b = F.expr(f"(n*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1)) / nullif({det}, 0)")
    c = F.expr(f"(n*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / nullif({det}, 0)")
    z = s.where("n >= 3").withColumn("_a", a).withColumn("_b", b).withColumn("c", c)
    return z.select(*by, "n", (F.col("_a") - F.col("_b") * F.col("_m") + F.col("c") * F.col("_m") * F.col("_m")).alias("a"), (F.col("_b") - 2 * F.col("c") * F.col("_m")).alias("b"), "c")


def slope_through_origin(x: str, y: str, w: str) -> Column:
    """Weighted least-squares slope without intercept."""
    return F.sum(F.col(w) * F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(w) * F.col(x) * F.col(x)), F.lit(0.0))
