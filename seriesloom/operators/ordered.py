"""Running values over rows in order where one key may hold most rows: rows are laid out in ranges of (key, order), and one summary row for each key and range carries what lies before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.util import stage

PART = "_part"


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of (keys, order) of about equal size, with the number of the range; staged, so that the ranges stay as they are. Rows equal in all of these share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()))


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys in which nulls are equal; b's keys are dropped."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return a.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_group(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Adds aggregates of each group to its rows: aggregated with partial sums and joined back, so that no task holds a group. Null keys are a group."""
    return same(df, df.groupBy(*by).agg(*[v.alias(k) for k, v in values.items()]), by)


def carried(x: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Adds to the rows of :func:`in_ranges` sums over the key's rows in earlier ranges (0 in the first)."""
    s = x.groupBy(*keys, PART).agg(*[v.alias(k) for k, v in values.items()])
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return same(x, s.select(*keys, PART, *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in values]), [*keys, PART])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number from 1 inside each key by ``order`` (ascending; it must tell the rows of a key apart)."""
    x = carried(in_ranges(df, keys, order), keys, _before=F.count("*"))
    n = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*order))
    return x.withColumn(out, n + F.col("_before")).drop("_before", PART)


def ranked(df: DataFrame, keys: list[str], value: str, out: str, ties: str = "low") -> DataFrame:
    """Rank of each value inside its key, ascending: of equal values the ``low`` or the ``high`` place."""
    x = carried(in_ranges(df, keys, [value]), keys, _before=F.count("*"))
    n = F.rank().over(Window.partitionBy(*keys, PART).orderBy(value))
    if ties == "high":
        n = n + F.count("*").over(Window.partitionBy(*keys, PART, value)) - 1
    return x.withColumn(out, n + F.col("_before")).drop("_before", PART)
