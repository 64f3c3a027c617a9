"""Exact positions and running sums inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 12


def positions(df: DataFrame, by: list[str], ident: list[str], seed: int = 0, weight: Column | None = None, bits: int = BITS) -> DataFrame:
    """Adds ``pos`` (0-based) and, with ``weight``, ``before`` (sum of the weights of earlier rows).

    The order inside a group is pseudo-random but fixed: by a hash of ``ident``, then ``ident`` itself. The hash range is cut
    into ``2**bits`` buckets; rows are numbered inside (group, bucket), and one summary row per bucket gives what lies before.
    ``ident`` must tell the rows of a group apart; otherwise the order of equal rows is free.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    h = F.xxhash64(F.lit(seed), *ident)
    x = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits)).withColumn("_w", w)
    keys = [*by, "_b"]
    inner = Window.partitionBy(*keys).orderBy("_h", *ident)
    rows = x.withColumn("_n", F.row_number().over(inner) - 1).withColumn("_s", F.sum("_w").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = x.groupBy(*keys).agg(F.count("*").alias("_c"), F.sum("_w").alias("_t"))
    ahead = total.select(*keys, F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_t0"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = rows.alias("l").join(ahead.alias("r"), cond).select("l.*", "r._c0", "r._t0")
    out = joined.withColumn("pos", F.col("_n") + F.col("_c0"))
    if weight is not None:
        out = out.withColumn("before", F.col("_s") + F.col("_t0"))
    return out.drop("_h", "_b", "_w", "_n", "_s", "_c0", "_t0")
