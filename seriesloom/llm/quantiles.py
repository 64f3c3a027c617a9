"""Percentiles of large numeric columns from mergeable dyadic-tree counts with a deterministic rank error.

Values are placed on a bounded ordered universe of ``2**28`` codes that holds every finite double: 63 900 steps to each doubling of the magnitude on either
side of zero. A sketch is a set of tree nodes (level, node, count): level 0 holds single codes, level ``l`` blocks of ``2**l`` codes.
Compression moves a node, its sibling and their parent into the parent while they hold at most ``n / k`` values together.
Sketches are merged by adding the counts of equal nodes. A returned value is off by at most ``28 * n / k`` ranks and by a
relative ``2**(1/63900) - 1`` in value; groups with ``n < k`` aren't compressed and have no rank error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 28
STEPS = 63_900
HALF = 1 << (LEVELS - 1)
#: Doublings from the smallest double to 1.
LOWEST = 1075
#: Compression factor: rank error of at most LEVELS / K = 0.5 % of the rows.
K = 5600
#: Rows that a task gathers before it makes them a sketch.
GATHERED = 1 << 20


def code(x: Column) -> Column:
    """Place of a finite value on the universe."""
    m = F.floor((F.log2(F.abs(x)) + LOWEST) * STEPS) + 1
    return (F.when(x == 0, F.lit(HALF)).when(x > 0, HALF + m).otherwise(HALF - m)).cast("int")


def decode(c: np.ndarray) -> np.ndarray:
    """Middle value of a code."""
    m = np.abs(c.astype(np.int64) - HALF)
    return np.sign(c - HALF) * np.where(m == 0, 0.0, 2.0 ** ((m - 0.5) / STEPS - LOWEST))


def compress(g: np.ndarray, level: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Compressed nodes of many sketches at once; ``limit`` is n // k of each sketch, ``g`` its number."""
    kept, lev = [], 0
    cur = [a[level == 0] for a in (g, node, count)]
    for lev in range(LEVELS):
        up = level == lev + 1
        own_g, own_n, own_c = g[up], node[up], count[up]
        k = np.concatenate([cur[0], own_g]) << 32 | np.concatenate([cur[1] >> 1, own_n])
        c = np.concatenate([cur[2], own_c])
        u, inv = np.unique(k, return_inverse=True)
        total = np.bincount(inv, c, len(u)).astype(np.int64)
        fits = total <= limit[u >> 32]
        stays = ~fits[inv[: len(cur[0])]]
        kept.append((cur[0][stays], np.full(stays.sum(), lev, np.int32), cur[1][stays], cur[2][stays]))
        own = np.bincount(inv[len(cur[0]) :], own_c, len(u)).astype(np.int64)
        c = np.where(fits, total, own)
        has = c > 0
        cur = [(u >> 32)[has], (u & 0xFFFFFFFF)[has], c[has]]
    kept.append((cur[0], np.full(len(cur[0]), LEVELS, np.int32), cur[1], cur[2]))
    return tuple(np.concatenate([x[i] for x in kept]) for i in range(4))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends; rows come sorted by key. A group is bounded by the nodes of the universe."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        row = [b[k][b.num_rows - 1].as_py() for k in keys]
        if [b[k][0].as_py() for k in keys] == row and (last is None or row == last):
            held.append(b)
            last = row
            continue
        n = b.num_rows
        while n and [b[k][n - 1].as_py() for k in keys] == row:
            n -= 1
        if n:
            held.append(b.slice(0, n))
        yield pa.Table.from_batches(held)
        held, last = [b.slice(n)], row
    if held:
        yield pa.Table.from_batches(held)


def _numbers(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's group, and the first row of each group; rows are sorted by key."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        d = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
        c = (d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d).indices.to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _arrays(t: pa.Table, keys: list[str], k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    g, first = _numbers(t, keys)
    count = t["count"].to_numpy()
    n = np.bincount(g, count, len(first)).astype(np.int64)
    return compress(g, t["level"].to_numpy(), t["node"].to_numpy().astype(np.int64), count, n // k), n, first


def _compressor(keys: list[str], k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, keys):
            (g, level, node, count), _, first = _arrays(t, keys, k)
            head = t.select(keys).take(pa.array(first[g]))
            for name, a in (("level", level), ("node", node.astype(np.int32)), ("count", count.astype(np.int64))):
                head = head.append_column(name, pa.array(a))
            yield from head.to_batches()

    return run


def _reader(keys: list[str], k: int, qs: list[float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, keys):
            (g, level, node, count), n, first = _arrays(t, keys, k)
            right = ((node + 1) << level) - 1
            o = np.lexsort((level, right, g))
            g, right, count = g[o], right[o], count[o]
            begin = np.r_[0, np.cumsum(n)[:-1]]
            cum = np.cumsum(count)
            for q in qs:
                want = begin + np.clip(np.ceil(q * n).astype(np.int64), 1, n)
                at = np.searchsorted(cum, want)
                out = t.select(keys).take(pa.array(first))
                for name, a in (("q", np.full(len(first), q)), ("value", decode(right[at])), ("n", n), ("rank_error", LEVELS * (n // k))):
                    out = out.append_column(name, pa.array(a))
                yield from out.to_batches()

    return run


def _local(keys: list[str], k: int) -> Callable:
    """Rows of one input partition (keys.., node) to compressed sketches of what was gathered: a group leaves a task as a few thousand nodes, however many rows it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
                if sum(x.num_rows for x in held) < GATHERED:
                    continue
            if not sum(x.num_rows for x in held):
                continue
            t, held = pa.Table.from_batches(held), []
            codes = np.zeros(t.num_rows, np.int64)
            for key in keys:
                d = t[key].combine_chunks().dictionary_encode(null_encoding="encode")
                d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
                codes = np.unique(codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            _, first, g = np.unique(codes, return_index=True, return_inverse=True)
            leaf, count = np.unique(g.astype(np.int64) << 32 | t["node"].to_numpy().astype(np.int64), return_counts=True)
            n = np.bincount(g, minlength=len(first))
            g, level, node, count = compress(leaf >> 32, np.zeros(len(leaf), np.int32), leaf & 0xFFFFFFFF, count, n // k)
            head = t.select(keys).take(pa.array(first[g]))
            for name, a in (("level", level), ("node", node.astype(np.int32)), ("count", count.astype(np.int64))):
                head = head.append_column(name, pa.array(a))
            yield from head.to_batches()

    return run


def _schema(df: DataFrame, keys: list[str], rest: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*df.select(*keys).schema.fields, *[T.StructField(n, t) for n, t in rest]])


NODES = [("level", T.IntegerType()), ("node", T.IntegerType()), ("count", T.LongType())]


def sketch(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """Compressed sketch of the finite values of each key, as rows keys.., level, node, count.

    Null, NaN and infinite values count for nothing, so a key without finite values has no rows. Keys may be null.
    Each input partition makes sketches of its own rows; only their nodes are shuffled, added and compressed again, so that a key with most rows sends each task's few thousand nodes. Adding nodes adds
    the bounds of their counts, so the rank error stays within that for all n values.
    """
    v = F.col(value).cast("double")
    fin = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    parts = fin.select(*keys, code(v).alias("node")).mapInArrow(_local(keys, k), _schema(df, keys, NODES))
    return recompress(merge(parts, keys), keys, k)


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches with fewer keys: counts of equal nodes are added. Compress again with :func:`percentiles` or :func:`recompress`."""
    return sketches.groupBy(*keys, "level", "node").agg(F.sum("count").alias("count"))


def recompress(merged: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merged sketches, compressed to the size for their number of values."""
    rows = merged.select(*keys, "level", "node", "count").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_compressor(keys, k), _schema(merged, keys, NODES))


def percentiles(merged: DataFrame, keys: list[str], qs: list[float], k: int = K) -> DataFrame:
    """keys.., q, value, n, rank_error: the value of rank ceil(q * n), off by at most ``rank_error`` ranks."""
    rows = merged.select(*keys, "level", "node", "count").repartition(*keys).sortWithinPartitions(*keys)
    rest = [("q", T.DoubleType()), ("value", T.DoubleType()), ("n", T.LongType()), ("rank_error", T.LongType())]
    return rows.mapInArrow(_reader(keys, k, qs), _schema(merged, keys, rest))
