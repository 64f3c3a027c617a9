"""Statistics per series. All skip nulls, use hash aggregation with partial sums where the statistic allows, and give null for empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.operators.ordered import with_group


def _ranked(df: DataFrame, by: list[str], value: str, out: str = "_i") -> DataFrame:
    return df.where(F.col(value).isNotNull()).withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value)))


def mapd(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Median absolute deviation (without factor) of neighbouring differences divided by the mean."""
    w = Window.partitionBy(*by)
    x = df.where(F.col(value).isNotNull())
    x = x.withColumn("_d", (F.lag(value).over(w.orderBy(*order)) - F.col(value)) / F.nullif(F.avg(value).over(w), F.lit(0.0)))
    x = x.withColumn("_m", F.median("_d").over(w))  # a series, which its operators hold as one group throughout
    return x.groupBy(*by).agg(F.median(F.abs(F.col("_d") - F.col("_m"))).alias("mapd"))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient from the order statistics: (2 sum i x_(i)) / (n sum x) - (n + 1) / n; null where the sum is 0."""
    x = _ranked(df, by, value)
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("_s"), F.sum(F.col("_i") * F.col(value)).alias("_t"))
    return g.withColumn("gini", 2 * F.col("_t") / (F.col("n") * F.nullif(F.col("_s"), F.lit(0))) - (F.col("n") + 1) / F.col("n")).drop("_s", "_t")


def gini_by_state(df: DataFrame, by: list[str], part: list[str], state: str, value: str, more_than: int = 10) -> DataFrame:
    """Mean of the Gini coefficients of each part and positive state with more than ``more_than`` rows, weighted by their rows."""
    g = gini(df.where(F.col(state) > 0), [*by, *part, state], value).where(F.col("n") > more_than)
    return g.groupBy(*by).agg((F.sum(F.col("gini") * F.col("n")) / F.sum(F.when(F.col("gini").isNotNull(), F.col("n")))).alias("gini_norm"))


def spss_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than 3 values or no spread."""
    n = F.count(x)
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def spss_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than 4 values or no spread."""
    n = F.count(x)
    return F.when((n > 3) & (F.stddev_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def observed_variance(df: DataFrame, by: list[str], order: list[str], value: str, trim: float = 0.001) -> DataFrame:
    """Half the variance of neighbouring differences of the mean-normalised signal, between its ``trim`` and 1 - ``trim`` percentiles."""
    w = Window.partitionBy(*by)
    x = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value) / F.nullif(F.avg(value).over(w), F.lit(0.0)))
    x = x.withColumn("_d", F.col("_v") - F.lag("_v").over(w.orderBy(*order)))
    x = x.withColumn("_lo", F.percentile("_d", F.lit(trim)).over(w)).withColumn("_hi", F.percentile("_d", F.lit(1 - trim)).over(w))
    return x.where("_d between _lo - 1e-9 and _hi + 1e-9").groupBy(*by).agg((F.var_samp("_d") / 2).alias("obs_variance"))


def entropy(df: DataFrame, by: list[str], columns: list[str], out: str) -> DataFrame:
    """Entropy (nats) of the joint distribution of discrete columns."""
    c = df.groupBy(*by, *columns).agg(F.count("*").alias("_c"))
    e = c.groupBy(*by).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.ln("_c")).alias("_l"))
    return e.select(*by, (F.ln("_n") - F.col("_l") / F.col("_n")).alias(out))


def mutual_information(df: DataFrame, by: list[str], x: str, y: str, out: str = "mi") -> DataFrame:
    """I(x; y) of two discrete columns from one set of joint counts."""
    c = df.groupBy(*by, x, y).agg(F.count("*").alias("_c"))
    w = lambda *k: F.sum("_c").over(Window.partitionBy(*by, *k))
    p = c.withColumn("_x", w(x)).withColumn("_y", w(y)).withColumn("_n", w())
    return p.groupBy(*by).agg(F.sum(F.col("_c") / F.col("_n") * F.ln(F.col("_c") * F.col("_n") / (F.col("_x") * F.col("_y")))).alias(out))


def conditional_mutual_information(df: DataFrame, by: list[str], x: str, y: str, z: str, out: str = "cmi") -> DataFrame:
    """I(x; y | z) of discrete columns from one set of joint counts."""
    c = df.groupBy(*by, x, y, z).agg(F.count("*").alias("_c"))
    w = lambda *k: F.sum("_c").over(Window.partitionBy(*by, *k))
    p = c.withColumn("_xz", w(x, z)).withColumn("_yz", w(y, z)).withColumn("_z", w(z)).withColumn("_n", w())
    return p.groupBy(*by).agg(F.sum(F.col("_c") / F.col("_n") * F.ln(F.col("_c") * F.col("_z") / (F.col("_xz") * F.col("_yz")))).alias(out))


def equal_frequency(df: DataFrame, by: list[str], value: str, bins: int, order: list[str], out: str) -> DataFrame:
    """Equal-frequency class of each value (1 to ``bins``); equal values are told apart by ``order``."""
    return df.withColumn(out, F.ntile(bins).over(Window.partitionBy(*by).orderBy(value, *order)))


def weighted_quantile(value: str, weight: str, q: float) -> Column:
    """Quantile of values repeated ``weight`` times, by counts instead of repetition."""
    return F.percentile(value, F.lit(q), F.col(weight))


def weighted_sd(value: str, weight: str) -> Column:
    """Standard deviation of values repeated ``weight`` times."""
    w, x = F.col(weight), F.col(value)
    n, s, ss = F.sum(F.when(x.isNotNull(), w)), F.sum(w * x), F.sum(w * x * x)
    return F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1))


def trimmed_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of the lowest 95 % and 99 %, mean without 5 % at either end, and mean up to the 95th percentile."""
    w = Window.partitionBy(*by)
    x = _ranked(df, by, value).withColumn("_n", F.count("*").over(w))
    x = x.withColumn("_q", F.percentile(value, F.lit(0.95)).over(w))
    v, i, n = F.col(value), F.col("_i"), F.col("_n")
    cut = F.floor(0.05 * n)
    return x.groupBy(*by).agg(
        F.avg(F.when(i <= F.floor(0.95 * n), v)).alias("low95"), F.avg(F.when(i <= F.floor(0.99 * n), v)).alias("low99"),
        F.avg(F.when((i > cut) & (i <= n - cut), v)).alias("trim5"), F.avg(F.when(v <= F.col("_q"), v)).alias("upto95"),
    )


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value; of equally frequent ones the smallest."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return c.groupBy(*by).agg(F.max(F.struct(F.col("_c"), -F.col(value))).alias("_x")).select(*by, (-F.col("_x.col2")).alias("mode"), F.col("_x._c").alias("n"))


def kendall_s(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mann-Kendall S: concordant minus discordant pairs of discrete columns, from counts of distinct (x, y).

    A group's pairs aren't formed one by one: equal rows are one count, so the work is bounded by the number of distinct values.
    """
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_c"))
    a, b = c.alias("a"), c.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by]
    cond = F.col(f"a.{x}") < F.col(f"b.{x}")
    for s in same:
        cond = cond & s
    sign = F.signum(F.col(f"b.{y}") - F.col(f"a.{y}"))
    pairs = a.join(b, cond).groupBy(*[F.col(f"a.{k}").alias(k) for k in by]).agg(F.sum(sign * F.col("a._c") * F.col("b._c")).cast("long").alias("s"))
    return c.select(*by).distinct().join(pairs, by, "left").fillna(0, ["s"])


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rank with ties given their mean rank."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where either column has no spread. Both columns must be null in the same rows."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def partial_correlation(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y without what z explains; null where z explains all."""
    return (xy - xz * yz) / F.nullif(F.sqrt((1 - xz * xz) * (1 - yz * yz)), F.lit(0.0))


def standardise(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean) / sd inside each group; null without spread."""
    x = with_group(df, by, _mu=F.avg(value), _sd=F.stddev_samp(value))
    return x.withColumn(out, (F.col(value) - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mu", "_sd")


def adjust_p(df: DataFrame, by: list[str], p: str, out: str = "p_adjusted", dependent: bool = False) -> DataFrame:
    """False-discovery rates (Benjamini-Hochberg; with ``dependent`` Benjamini-Yekutieli). Null p stay null and don't count."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_i", F.rank().over(w.orderBy(F.col(p).asc_nulls_last())) + F.count(p).over(Window.partitionBy(*by, p)) - 1).withColumn("_m", F.count(p).over(w))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_m"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / i) if dependent else F.lit(1.0)
    x = x.withColumn("_q", F.col(p) * F.col("_m") / F.col("_i") * harmonic)
    back = w.orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(back), F.lit(1.0)))).drop("_i", "_m", "_q")
