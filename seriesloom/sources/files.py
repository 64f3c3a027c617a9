"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.names import base_name, without_extension

BED = "chrom string, start0 long, end0 long, a string, b string, c string"
POSITIONS = "chromosome string, start double, length double"
#: Lines of a flagstat report that hold the ten counts, from 1, and the names they get.
FLAGSTAT_LINES = [1, 2, 4, 5, 6, 9, 10, 11, 12, 13]
FLAGSTAT_NAMES = ["qctotal", "qcsecondary", "qcduplicates", "qcmapped", "qcpairedsequencing", "qcproperlypaired", "qcpairedwithitself", "qcsingletons", "qcmatemapped", "qcmatemappedmapq5"]
#: Bin sizes in kb that have a catalogue.
BIN_SIZES = [1, 5, 10, 15, 30, 50, 100, 200, 500, 1000, 2000, 5000]


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of a BED file as closed 1-based ``start``, ``end``; missing columns are null, lines without bounds are dropped."""
    x = spark.read.csv(path, sep="\t", schema=BED, comment="#")
    return x.where("start0 is not null and end0 is not null").select("chrom", (F.col("start0") + 1).alias("start"), F.col("end0").alias("end"), "a", "b", "c")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Read starts with their length as ranges; rows without start are dropped. The end is start + abs(length) - 1."""
    x = spark.read.csv(path, sep="\t", schema=POSITIONS, header=True).where("start is not null")
    start = F.col("start").cast("long")
    return x.select("chromosome", start.alias("start"), (start + F.abs(F.coalesce("length", F.lit(1.0))).cast("long") - 1).alias("end"), base_name(F.input_file_name()).alias("file"))


def read_flagstat(spark: SparkSession, path: str) -> DataFrame:
    """One row per report: name (file without extension) and the first number of each of ten fixed lines; null where a line is missing."""
    x = spark.read.text(path, wholetext=True).select(without_extension(base_name(F.input_file_name())).alias("name"), F.split("value", "\n").alias("l"))
    first = lambda n: F.regexp_extract(F.coalesce(F.get("l", F.lit(n - 1)), F.lit("")), r"^\s*(\d+)", 1).try_cast("double")
    return x.select("name", *[first(n).alias(c) for n, c in zip(FLAGSTAT_LINES, FLAGSTAT_NAMES, strict=True)])


def read_gff_attributes(spark: SparkSession, path: str, feature: str, attribute: str) -> DataFrame:
    """Ranges of one feature type with one of their attributes."""
    x = spark.read.csv(path, sep="\t", schema="chrom string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string", comment="#")
    return x.where(F.col("feature") == feature).select("chrom", "start", "end", F.nullif(F.regexp_extract("attributes", rf"(?:^|;)\s*{attribute}=([^;]*)", 1), F.lit("")).alias(attribute))


def read_cohort(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """Parquet files of several cohorts in one frame; without ``strict`` columns may be missing in some."""
    frames = [spark.read.parquet(p) for p in sorted(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=not strict)
    return out


def read_bins(spark: SparkSession, root: str, genome: str, bin_kb: int) -> DataFrame:
    """Catalogue of bins of a genome and size; the folders are partitions, so only theirs is read."""
    if bin_kb not in BIN_SIZES:
        raise ValueError(f"no catalogue of {bin_kb} kb bins")
    return spark.read.parquet(root).where((F.col("genome") == genome) & (F.col("bin_kb") == bin_kb))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sample sheet with one JSON object per line: the key under ``cell`` and its attributes as columns."""
    return spark.read.json(path)


def write_segments(df: DataFrame, path: str) -> None:
    """Segment table as tab-separated text with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_signals(df: DataFrame, path: str) -> None:
    """Signal export (chr, start, end, state, copy, cell_id), nulls as empty text."""
    df.select("chr", "start", "end", "state", "copy", "cell_id").write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_wide(df: DataFrame, series: str, order: list[str], value: str, path: str) -> None:
    """One line per series with its values in order and no header; unknown values are empty."""
    x = F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda s: F.coalesce(s[value].cast("string"), F.lit("")))
    df.groupBy(series).agg(x.alias("v")).select(F.concat_ws(",", series, F.array_join("v", ",")).alias("value")).write.mode("overwrite").text(path)


def merge_pairs(a: DataFrame, b: DataFrame, share: float, ident: list[str], seed: int = 0) -> DataFrame:
    """Reproducible share of the rows of two files, put together."""
    from seriesloom.operators.cohort import hash_sample

    return hash_sample(a, ident, share, seed).unionByName(hash_sample(b, ident, share, seed + 1))
