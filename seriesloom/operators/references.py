"""References to records that do not exist: orphan references against parents with validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.skew import salted_join
from seriesloom.util import strip


def path_key(x: Column) -> Column:
    """Record meant by a path: last component after ``/`` or a backslash, up to its first dot; case and outer blanks ignored."""
    last = F.regexp_extract(x, r"([^/\\]*)$", 1)
    return F.lower(strip(F.substring_index(last, ".", 1)))


def plain_key(x: Column) -> Column:
    """Key compared without case and outer blanks."""
    return F.lower(strip(x))


def parent_validity(parents: DataFrame, key: Column, loaded: str, removed: str) -> DataFrame:
    """One row per parent key: first time it stood (``since``) and whether any of its rows still stands (``alive``)."""
    p = parents.select(key.alias("ref_key"), F.col(loaded).alias("l"), F.col(removed).alias("r")).where("ref_key is not null and ref_key <> ''")
    return p.groupBy("ref_key").agg(F.min("l").alias("since"), F.bool_or(F.col("r").isNull()).alias("alive"))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose parent is missing, deleted or late.

    ``refs`` has (src_table, row_id, ref_key, at), ``parents`` comes from :func:`parent_validity`. Both sides are
    hash-partitioned and sorted by key and merged once (sort-merge join); the parents are aggregated before their shuffle,
    so each key meets one parent row. Keys that hold a large share of all references are dealt to several partitions
    (see ``skew.salted_join``). Result: src_table, row_id, period (``yyyy-MM``), reason.
    References with a null key are none. A null ``at`` can be missing or deleted (period null), never late. A parent
    without any load time is never late. Empty parents: every reference is missing.
    """
    m = salted_join(refs.where("ref_key is not null"), parents, "ref_key", "row_id")
    reason = (
        F.when(F.col("alive").isNull(), "missing")
        .when(~F.col("alive"), "deleted")
        .when(F.col("since") > F.col("at"), "late")
    )
    return m.select("src_table", "row_id", F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason")).where("reason is not null")
