"""Small helpers shared by all operators: reading tables, cutting lineage, rounding, keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one Parquet file or folder each)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``. Where that is unset, a session on one machine (master ``local``) gets a folder of its own; on a cluster it is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later plans start from the written files, so lost executors cost no recomputation of what came before
    and a result that is used several times is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a table written by :func:`stage` that no later plan reads."""
    spark = df.sparkSession
    folder = getattr(df, "_stage_path", None)
    if folder is None:
        raise ValueError("not a table that stage() wrote")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def r6(x: Column | str) -> Column:
    """Six decimals: the precision in which floating results are given."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def int_state(x: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(x, 0).cast("int")


def strip(x: Column) -> Column:
    """Outer blanks of any kind removed."""
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def spread_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitions on ``keys`` in a number that adaptive execution keeps: for kernels whose work is large against their bytes."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def series_starts(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys; nulls are equal."""
    new = np.zeros(len(b), bool)
    new[:1] = True
    for k in keys:
        v = b[k]
        a, z = v.iloc[1:].to_numpy(), v.iloc[:-1].to_numpy()
        new[1:] |= np.asarray(a != z, bool) & ~(pd.isna(a) & pd.isna(z))
    return np.flatnonzero(new)


def map_series(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, dealt: bool = False) -> DataFrame:
    """``run(rows, starts)`` on tables of many whole series at a time, sorted by keys and order, with the first row of each series: for kernels that would spend more on the calls than on the work if each series were a
    call of its own. A series is never divided; with ``dealt`` no series of ``df`` is in two partitions already."""

    def result(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(parts, ignore_index=True)
        y = run(x, series_starts(x, keys))
        if len(y):  # an empty table has no types
            yield y

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            first = series_starts(b, keys)
            if held and len(series_starts(pd.concat([held[-1][keys].iloc[-1:], b[keys].iloc[:1]]), keys)) == 1:
                first = first[1:]
            if len(first) == 0 or (not held and len(first) == 1):
                held.append(b)
                continue
            cut = int(first[-1])
            if whole := [*held, *([b.iloc[:cut]] if cut else [])]:
                yield from result(whole)
            held = [b.iloc[cut:]]
        if held:
            yield from result(held)

    return (df if dealt else spread_by(df, keys)).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order]).mapInPandas(chunks, schema)


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores where the scan has fewer; a scan that has enough splits isn't shuffled."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(2 * want)
