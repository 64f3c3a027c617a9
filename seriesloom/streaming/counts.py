"""Bin counts of a stream of reads. An addition: nothing else in the library needs a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_stream(reads: DataFrame, at: str, position: str, keys: list[str], width: int, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Reads per window, key and bin of ``width`` positions; rows later than ``late`` behind the newest are dropped by the watermark."""
    x = reads.withWatermark(at, late).withColumn("bin", F.floor((F.col(position) - 1) / width))
    return x.groupBy(F.window(at, window), *keys, "bin").agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "bin", "n")
