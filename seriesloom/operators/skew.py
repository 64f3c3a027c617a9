"""Joins in which single keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that hold more rows than half a shuffle partition's fair share: fewer than twice the number of partitions, whatever the data."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))  # one row
    return counts.join(F.broadcast(total), F.col("_c") * 2 * parts > F.col("_t")).select(key)


def salted_join(many: DataFrame, one: DataFrame, key: str, ident: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Sort-merge join of ``many`` with ``one`` (a row per key): the rows of a hot key are dealt to ``salts`` partitions by a hash of ``ident``,
    and its one partner is repeated for each; other keys are joined as they are."""
    hot = F.broadcast(hot_keys(many, key).withColumn("_hot", F.lit(True)))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int")).otherwise(0)
    a = many.join(hot, key, "left").withColumn("_salt", deal).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = one.join(hot, key, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return a.join(b.hint("merge"), [key, "_salt"], how).drop("_salt")
