"""Mixing sources to target weights, with capped repeats and exact quotas for output shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seriesloom.llm.ranks import positions

#: Rows of one source that stay together, and blocks of a shard.
BLOCK_ROWS = 64
SHARD_BLOCKS = 256


def _halves(c: np.ndarray, seed: int, depth: int, node: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a node of the tree in two halves, by one multivariate hypergeometric draw that depends on the node only."""
    rng = np.random.default_rng([seed, depth, node])
    left = rng.multivariate_hypergeometric(c, int(c.sum()) // 2, method="marginals") if c.sum() else c
    return left, c - left


def shard_runs(blocks: list[int], shards: int, seed: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every source (rows: the shards in ``which``).

    The blocks of all sources are parted in two again and again, down to single shards, so every source's count is used up exactly; ``shards`` is a power of two. A shard's
    part is found by walking down from the root, drawing only the nodes on the way and adding up what lies to the left.
    """
    first, size = np.zeros((len(which), len(blocks)), np.int64), np.zeros((len(which), len(blocks)), np.int64)
    depth = shards.bit_length() - 1
    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for i, k in enumerate(which.tolist()):
        c, begin = np.asarray(blocks, np.int64), np.zeros(len(blocks), np.int64)
        for d in range(depth):
            node = k >> (depth - d)
            if (d, node) not in known:
                if len(known) > 4 * depth + 64:
                    known.clear()
                known[d, node] = _halves(c, seed, d, node)
            left, right = known[d, node]
            if k >> (depth - d - 1) & 1:
                c, begin = right, begin + left
            else:
                c = left
        first[i], size[i] = begin, c
    return first, size


def shard_quotas(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts of all shards."""
    return shard_runs(blocks, shards, seed, np.arange(shards))[1]


def dealt_blocks(spark: SparkSession, names: list[str], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(source, shard, block) of every block; the tasks walk the tree for their own shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = b["id"].to_numpy()
            first, size = shard_runs(blocks, shards, seed, which)
            row, source = np.nonzero(size)
            columns = [pa.array([names[j] for j in source], pa.string()), pa.array(which[row]), pa.array(first[row, source]), pa.array(first[row, source] + size[row, source] - 1)]
            yield pa.RecordBatch.from_arrays(columns, ["source", "shard", "lo", "hi"])

    runs = spark.range(shards).mapInArrow(run, "source string, shard long, lo long, hi long")
    return runs.select("source", "shard", F.explode(F.sequence("lo", "hi")).alias("block"))


def source_totals(records: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """One entry per target source with its quota, full passes and rest; and the tokens of all records."""
    per = records.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    total = records.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    out = []
    for r in targets.select("source", "target_share", "max_repeats").join(per, "source", "left").orderBy("source").collect():  # one row per source that has a target
        tokens, n = r["tokens"] or 0, r["n"] or 0
        most = max(r["max_repeats"] if r["max_repeats"] is not None else 1, 0)
        quota = max(r["target_share"] or 0.0, 0.0) * total
        full = min(int(quota // tokens), most) if tokens else 0
        rest = quota - full * tokens if tokens and full < most else 0.0
        out.append({"source": r["source"], "share": r["target_share"], "most": most, "n": n, "tokens": tokens, "quota": quota, "full": full, "rest": rest})
    return out, total


def mix(records: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """shard, position, source, item, copy_no, tokens: the mixed corpus.

    records: (item, source, tokens), item unique; targets: (source, target_share, max_repeats), one row per source. Each source gets
    its share of all tokens of ``records``: as many full passes as fit and a last pass that ends at the record
    nearest to the quota, together at most ``max_repeats`` passes; what a small source can't give stays open (see :func:`shares`). Records whose source is null
    or has no target aren't used; sources without records give none. A source's records are taken in a pseudo-random order, cut
    into blocks, and the blocks dealt to shards by :func:`shard_quotas`; each shard is shuffled on its own.
    """
    spark = records.sparkSession
    stats, _ = source_totals(records, targets)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("full", T.LongType()), T.StructField("rest", T.DoubleType()), T.StructField("n", T.LongType())])
    plan = spark.createDataFrame([(s["source"], s["full"], s["rest"], s["n"]) for s in stats if s["n"]], schema)
    r = positions(records.where("source is not null").select("item", "source", F.col("tokens").cast("long").alias("tokens")), ["source"], ["item"], seed, weight=F.col("tokens"))
    r = r.join(F.broadcast(plan), "source")  # one row per source with a target
    copies = F.col("full") + (F.col("before") + F.col("tokens") / 2 < F.col("rest")).cast("long")
    r = r.withColumn("copies", copies).where("copies > 0")
    taken = {x["source"]: x["k"] for x in r.groupBy("source").agg(F.sum("copies").alias("k")).collect()}
    names = [s["source"] for s in stats if taken.get(s["source"])]
    blocks = [-(-taken[s] // BLOCK_ROWS) for s in names]
    shards = 1
    while shards * SHARD_BLOCKS < sum(blocks):
        shards *= 2
    dealt = dealt_blocks(spark, names, blocks, shards, seed)
    x = r.select("source", "item", "tokens", "pos", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy_no"))
    x = x.withColumn("block", F.floor(((F.col("copy_no") - 1) * F.col("n") + F.col("pos")) / BLOCK_ROWS).cast("long"))
    x = x.join(dealt, ["source", "block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "item", "copy_no"), "item", "copy_no")
    return x.select("shard", (F.row_number().over(order) - 1).alias("position"), "source", "item", F.col("copy_no").cast("int").alias("copy_no"), "tokens")


def shares(mixed: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source was to give and gave: its share of all tokens of ``records`` and of the mixed corpus."""
    stats, total = source_totals(records, targets)
    spark = records.sparkSession
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("tokens_there", T.LongType())])
    base = spark.createDataFrame([(s["source"], s["share"], s["most"], s["tokens"]) for s in stats], schema)
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.count("*").alias("rows_used"), F.max("copy_no").alias("copies_most"))
    x = base.join(got, "source", "left").fillna(0, ["tokens_used", "rows_used", "copies_most"])
    whole = mixed.agg(F.sum("tokens").alias("mixed_tokens"))
    x = x.crossJoin(F.broadcast(whole))  # one row
    return x.select(
        "source", "target_share", "max_repeats", "tokens_there", "tokens_used", "rows_used", "copies_most",
        (F.col("tokens_used") / F.lit(max(total, 1))).alias("reached_share"),
        (F.col("tokens_used") / F.nullif(F.col("mixed_tokens"), F.lit(0))).alias("share_of_mix"),
    )
