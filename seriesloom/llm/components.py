"""Connected components by union-find on local forests that are merged step by step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.util import drop_stage, stage


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, by hooking to smaller roots and halving paths."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition to a star per local component: every node points to the smallest. Edges are reduced as they come, so that a task holds at most its nodes and ``HELD`` edges."""
    a = b = np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate([a, *[x["a"].to_numpy() for x in held], b, *[x["b"].to_numpy() for x in held]])
        ids, codes = np.unique(ends, return_inverse=True)
        root = roots(codes[: len(ends) // 2], codes[len(ends) // 2 :], len(ids))
        child = np.flatnonzero(root != np.arange(len(root)))
        return ids[child], ids[root[child]]

    for x in batches:
        held.append(x)
        if sum(y.num_rows for y in held) > HELD:
            (a, b), held = reduced(), []
    a, b = reduced()
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: Edges that a task gathers before it reduces them, and that a partition is to have at most when forests are merged.
HELD = 1_000_000


def components(edges: DataFrame, fan_in: int = 8, max_rounds: int = 60, held: int = HELD) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b strings); root is the smallest name of the component in byte order.

    Nodes get 64-bit numbers. Each partition reduces its edges to a spanning forest; forests are merged, at most ``fan_in`` to one, as long as the counted edges
    leave each merged partition ``held`` or fewer, whatever the number of partitions. What is left are at most (nodes in the partition) edges a partition; rounds of large and small stars
    then join partitions for good. Only the minimum of each neighbourhood is shuffled, so a node with very many edges is never gathered in one task.
    Null ends and loops are ignored (a node that has only those isn't returned); repeated edges change nothing.
    """
    pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    named = edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a is not null and b is not null and a <> b")
    names = stage(named.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    side = lambda c: names.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = named.join(side("a"), "a").join(side("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = stage(numbered.mapInArrow(_forest, pair))
    while parts > 1:
        fewer = max(-(-parts // fan_in), -(-e.count() // held), 1)
        if fewer >= parts:
            break
        parts = fewer
        merged = stage(e.repartition(parts).mapInArrow(_forest, pair))  # any division will do, so none can be skewed
        drop_stage(e)
        e = merged
    mark = None
    for _ in range(max_rounds if parts > 1 else 0):  # one partition's forest is a star for each component already
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.select("a", F.col("m").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        done = stage(small)
        s = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stage(e)
        e = done
        if (now := (s[0], s[1])) == mark:
            break
        mark = now
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = names.join(e.select(F.col("a").alias("id"), F.col("b").alias("top")), "id", "left").select("node", F.coalesce("top", "id").alias("top"))
    out = stage(star.join(star.groupBy("top").agg(F.min("node").alias("root")), "top").select("node", "root"))
    for x in (names, e):
        drop_stage(x)
    return out
