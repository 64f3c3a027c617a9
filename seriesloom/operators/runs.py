"""Operators on ordered series: differences, runs, segments, smoothing.

A series is named by the columns ``part`` (for example cell and chromosome) and ordered by ``order``, which must be a total
order inside ``part``. Each operator needs one shuffle on ``part``; chained ones share it. Null values are a state of their own unless said otherwise; empty
input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy(*order)


def differences(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``diff`` (value minus the value before; null at the start) and ``gap_next`` (distance to the next order value; infinite at the end)."""
    w = _w(part, order)
    gap = (F.lead(order[-1]).over(w) - F.col(order[-1])).cast("double")
    return df.withColumn("diff", F.col(value) - F.lag(value).over(w)).withColumn("gap_next", F.coalesce(gap, F.lit(float("inf"))))


def run_ids(df: DataFrame, part: list[str], order: list[str], value: str, name: str = "run_id") -> DataFrame:
    """Adds the 1-based number of the run of equal values each row lies in; nulls are equal to each other."""
    w = _w(part, order)
    first = F.row_number().over(w) == 1
    change = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    marked = df.withColumn("_c", change)
    return marked.withColumn(name, F.sum("_c").over(w)).drop("_c")


def run_lengths(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Runs: part.., run_id, first, last (of the last order column), n, value."""
    x = run_ids(df, part, order, value)
    return x.groupBy(*part, "run_id").agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n"), F.first(value).alias("value"))


def decode_runs(runs: DataFrame, part: list[str]) -> DataFrame:
    """Positions 1..n of each series from its runs: part.., pos, value."""
    w = Window.partitionBy(*part).orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    x = runs.withColumn("_e", F.sum("n").over(w))
    return x.select(*part, F.explode(F.sequence(F.col("_e") - F.col("n") + 1, F.col("_e"))).alias("pos"), "value")


def absorb_gaps(df: DataFrame, part: list[str], order: list[str], value: str, out: str = "filled") -> DataFrame:
    """Fills null stretches between equal values and at the ends of a series; stretches between unequal values stay null."""
    w = _w(part, order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = df.withColumn("_b", before).withColumn("_a", after)
    fill = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (F.col("_a") == F.col("_b")), F.col("_b"))
    return x.withColumn(out, F.coalesce(F.col(value), fill)).drop("_b", "_a")


def trimmed_segments(df: DataFrame, part: list[str], order: list[str], segment: str, min_length: int = 1, trim: int = 0) -> DataFrame:
    """Rows of segments of at least ``min_length`` rows (counted before trimming) without ``trim`` rows at either end."""
    s = Window.partitionBy(*part, segment)
    x = df.withColumn("_n", F.count("*").over(s)).withColumn("_i", F.row_number().over(s.orderBy(*order)))
    keep = (F.col("_n") >= min_length) & (F.col("_i") > trim) & (F.col("_i") <= F.col("_n") - trim)
    return x.where(keep).drop("_n", "_i")


def smooth(df: DataFrame, part: list[str], order: list[str], segment: str, aggs: list[Column], min_length: int = 1, trim: int = 0) -> DataFrame:
    """Aggregates of each segment after :func:`trimmed_segments`."""
    return trimmed_segments(df, part, order, segment, min_length, trim).groupBy(*part, segment).agg(*aggs)


def segment_levels(df: DataFrame, part: list[str], segment: str, value: str, out: str = "level") -> DataFrame:
    """Adds the median of each segment to all of its rows."""
    return df.withColumn(out, F.median(value).over(Window.partitionBy(*part, segment)))


def prefix_sums(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Adds running sums of values (``cum_x``) and squares (``cum_x2``); nulls add nothing."""
    w = _w(part, order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.coalesce(F.col(value), F.lit(0))
    return df.withColumn("cum_x", F.sum(x).over(w)).withColumn("cum_x2", F.sum(x * x).over(w))


def oscillation(df: DataFrame, part: list[str], order: list[str], value: str, by: list[str]) -> DataFrame:
    """Changes of a state path: their number, total size, and the population sd of all steps; steps with a null side don't count."""
    x = differences(df, part, order, value).where("diff is not null")
    return x.groupBy(*by).agg(F.sum((F.col("diff") != 0).cast("int")).alias("n_changes"), F.sum(F.abs("diff")).alias("total_change"), F.stddev_pop("diff").alias("sd_change"))


def discordant_marks(df: DataFrame, part: list[str], order: list[str], a: str, b: str) -> DataFrame:
    """One row for each run of positions where ``a`` and ``b`` differ: first, last, n and the middle position (the earlier of two)."""
    x = df.withColumn("_d", F.coalesce(F.col(a) != F.col(b), F.lit(False)))
    runs = run_ids(x, part, order, "_d").where("_d")
    w = Window.partitionBy(*part, "run_id")
    y = runs.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)))
    mid = F.max(F.when(F.col("_i") == F.floor((F.col("_n") + 1) / 2), F.col(order[-1])))
    return y.groupBy(*part, "run_id").agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n"), mid.alias("middle"))


def transitions(df: DataFrame, part: list[str], order: list[str], state: str) -> DataFrame:
    """Number of steps from each state to each; steps with a null side don't count."""
    x = df.withColumn("from_state", F.lag(state).over(_w(part, order))).where(F.col(state).isNotNull() & F.col("from_state").isNotNull())
    return x.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
