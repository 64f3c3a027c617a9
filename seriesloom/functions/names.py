"""Scalar expressions on names, paths and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ["uid", "slx", "cellid", "celltag"]


def name_fields(name: Column) -> list[Column]:
    """The four fields of a cell name as columns; fields that are missing are null, more than four are dropped."""
    p = F.split(name, "_")
    return [F.get(p, F.lit(i)).alias(f) for i, f in enumerate(FIELDS)]


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dir_name(path: Column) -> Column:
    """Path without its last component and the divider before it."""
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def without_extension(x: Column) -> Column:
    """Text before the last dot."""
    return F.regexp_replace(x, r"\.[^.]*$", "")


def strip_prefix_if_all(x: Column, all_have: Column, prefix: str) -> Column:
    """Drops a prefix only where the whole column has it (``all_have``)."""
    return F.when(all_have, F.regexp_replace(x, f"^{prefix}", "")).otherwise(x)


def log_sum_exp(values: Column) -> Column:
    """log(sum(exp(x))) of an array, without overflow."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def chromosome_rank(chrom: Column) -> Column:
    """1 to 22, then X and Y; null for others."""
    return F.when(chrom == "X", 23).when(chrom == "Y", 24).when(chrom.rlike("^([1-9]|1[0-9]|2[0-2])$"), chrom.cast("int"))


def range_fields(key: Column) -> tuple[Column, Column, Column]:
    """Chromosome, start and end of a key ``chrom:start-end``; null where the key has another form."""
    form = r"^([^:]+):([0-9]+)-([0-9]+)$"
    part = lambda i: F.nullif(F.regexp_extract(key, form, i), F.lit(""))
    return part(1), part(2).try_cast("bigint"), part(3).try_cast("bigint")
