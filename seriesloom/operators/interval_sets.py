"""Union and complement of half-open intervals per entity.

The aggregate state of an entity and coordinate tile is a pair of lists: starts and ends of sorted disjoint intervals. States are built from Arrow
batches on the map side, and partial lists are merged linearly in a reduction tree: neighbours in pairs inside a task, and over two
shuffles between tasks (first by part of the tasks, then all). Tiles are bounded by quantiles of the starts, so that a tile holds a bounded number of
rows however the coordinates are spread. The tiles of an entity are then joined through one summary row each, and periods and complements
are emitted tile by tile. No step holds an entity as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seriesloom.util import stage

#: Rows that a tile is to hold, groups of tasks whose lists are merged first, and rows that a task gathers before it makes them lists.
TILE_ROWS, FAN, GATHERED = 1 << 18, 16, 1 << 18


class Lists:
    """Sorted disjoint intervals of many groups: group codes (ascending), starts and ends."""

    def __init__(self, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.group, self.start, self.end = group, start, end

    @staticmethod
    def of_rows(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lists:
        """From rows in any order: the only place where anything is sorted."""
        order = np.lexsort((start, group))
        return Lists(group[order], start[order], end[order]).joined()

    def joined(self) -> Lists:
        """Touching and overlapping intervals of sorted rows made one."""
        group, start, end = self.group, self.start, self.end
        if not len(group):
            return self
        low, high = int(start.min()), int(end.max())
        span = high - low + 2
        if (int(group[-1]) + 1) * span < 2**62:
            reach = np.maximum.accumulate(end - low + group * span) - group * span + low
        else:  # coordinates too large to be shifted apart: one group at a time
            reach = np.empty_like(end)
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(group)], strict=True):
                reach[a:b] = np.maximum.accumulate(end[a:b])
        fresh = np.ones(len(group), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(fresh)
        return Lists(group[first], start[first], reach[np.r_[first[1:] - 1, len(group) - 1]])

    def merged(self, other: Lists) -> Lists:
        """Linear merge of two sets of lists: rows of the other are put between those of this one; nothing is sorted."""
        a, b = self, other
        if not len(a.group) or not len(b.group):
            return a if len(a.group) else b
        low = min(int(a.start.min()), int(b.start.min()))
        span = max(int(a.start.max()), int(b.start.max())) - low + 1
        if (max(int(a.group[-1]), int(b.group[-1])) + 1) * span < 2**62:
            at = np.searchsorted(a.group * span + (a.start - low), b.group * span + (b.start - low))
        else:  # the same, group by group
            lo, hi = np.searchsorted(a.group, b.group), np.searchsorted(a.group, b.group, side="right")
            at = np.empty(len(b.group), np.int64)
            cuts = np.flatnonzero(np.diff(b.group)) + 1
            for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(b.group)], strict=True):
                at[x:y] = lo[x] + np.searchsorted(a.start[lo[x] : hi[x]], b.start[x:y])
        return Lists(*[np.insert(x, at, y) for x, y in ((a.group, b.group), (a.start, b.start), (a.end, b.end))]).joined()


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint union per group of rows in any order; touching intervals become one."""
    x = Lists.of_rows(group, start, end)
    return x.group, x.start, x.end


def merge_tree(group: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lists:
    """Partial lists (one row each: its group and its number of intervals; rows of a group in any order) merged in pairs, round by round, for all groups at once."""
    order = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)  # which of its group's lists a row is
    sorted_group = group[order]
    first = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(group) else np.zeros(0, bool)
    place[order] = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0)) if len(group) else 0
    begin = np.cumsum(size) - size
    level: list[Lists] = []
    for p in range(int(place.max()) + 1 if len(place) else 0):  # the p-th list of every group that has one
        rows = order[place[order] == p]
        rows = rows[np.argsort(group[rows], kind="stable")]
        take = np.repeat(begin[rows], size[rows]) + (np.arange(size[rows].sum()) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]))
        level.append(Lists(np.repeat(group[rows], size[rows]), start[take], end[take]))
    while len(level) > 1:
        level = [level[i].merged(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    none = np.zeros(0, np.int64)
    return level[0] if level else Lists(none, none, none)


def _codes(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group code of every row, and a row of each group."""
    codes = np.zeros(t.num_rows, np.int64)
    for k in keys:
        d = t[k].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        codes = np.unique(codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes, np.unique(codes, return_index=True)[1]


def _rows(head: pa.Table, lists: Lists) -> pa.Table:
    """One row for each group: its key columns and its two lists."""
    present, n = np.unique(lists.group, return_counts=True)
    offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    out = head.take(pa.array(present))
    for name, x in (("s", lists.start), ("e", lists.end)):
        out = out.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(x)))
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int, size: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += size(b)
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _build(keys: list[str], bounds: np.ndarray) -> Callable:
    """Map side: rows (keys.., s, e) to one row of lists for each key and tile among what was gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, GATHERED, lambda b: b.num_rows):
            t = t.append_column("tile", pa.array(np.searchsorted(bounds, t["s"].to_numpy(), side="right")))
            codes, first = _codes(t, [*keys, "tile"])
            lists = Lists.of_rows(codes, t["s"].to_numpy(), t["e"].to_numpy())
            yield from _rows(t.select([*keys, "tile"]).take(pa.array(first)), lists).to_batches()

    return run


def _merge(keys: list[str]) -> Callable:
    """Reduce side, rows sorted by key: what was gathered is merged in a tree; the last group is kept for what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for t in _gathered(batches, GATHERED, lambda b: len(b["s"].flatten())):
            t = t.select([*keys, "s", "e"]) if held is None else pa.concat_tables([held, t.select([*keys, "s", "e"])])
            codes, first = _codes(t, keys)
            flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            s, e = flat(t["s"].combine_chunks()), flat(t["e"].combine_chunks())
            last = int(codes[-1])
            lists = merge_tree(codes, np.diff(s.offsets.to_numpy()).astype(np.int64), s.flatten().to_numpy(), e.flatten().to_numpy())
            out = _rows(t.select(keys).take(pa.array(first)), lists)
            held = out.slice(last, 1)
            yield from pa.concat_tables([out.slice(0, last), out.slice(last + 1)]).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def _emit(keys: list[str]) -> Callable:
    """Lists of a tile with what earlier tiles reach (carry) and where the period that reaches it began (owner) to periods and gaps.

    Every interval beyond the reach closes the period before it and opens the gap between them; the last tile of an entity also closes the last period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            s_list = t["s"].combine_chunks()
            s_list = s_list.combine_chunks() if isinstance(s_list, pa.ChunkedArray) else s_list
            e_list = t["e"].combine_chunks()
            e_list = e_list.combine_chunks() if isinstance(e_list, pa.ChunkedArray) else e_list
            n = np.diff(s_list.offsets.to_numpy()).astype(np.int64)
            s, e = s_list.flatten().to_numpy(), e_list.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            begins = np.cumsum(n) - n
            is_first = np.zeros(len(s), bool)
            is_first[begins] = True
            has = t["carry"].is_valid().to_numpy()
            carry, owner = (t[c].fill_null(0).to_numpy() for c in ("carry", "owner"))
            covered = has[row] & (s <= carry[row])  # a prefix of the tile, since it is sorted
            before_reach = np.where(is_first, carry[row], np.r_[0, e[:-1]])
            before_reach = np.where(has[row], np.maximum(before_reach, carry[row]), before_reach)
            before_owner = np.where(is_first | np.r_[True, covered[:-1]], owner[row], np.r_[0, s[:-1]])
            closes = ~covered & (~is_first | has[row])
            ends = begins + n - 1
            last = t["last"].to_numpy(zero_copy_only=False)
            top = np.where(has, np.maximum(e[ends], carry), e[ends])
            final_owner = np.where(covered[ends], owner, s[ends])
            rows = np.concatenate([row[closes], row[closes], np.flatnonzero(last)])
            kind = np.repeat(["period", "gap", "period"], [closes.sum(), closes.sum(), last.sum()])
            start = np.concatenate([before_owner[closes], before_reach[closes], final_owner[last]])
            end = np.concatenate([before_reach[closes], s[closes], top[last]])
            out = t.select(keys).take(pa.array(rows))
            for name, x in (("kind", pa.array(kind.tolist(), pa.string())), ("start", pa.array(start)), ("end", pa.array(end))):
                out = out.append_column(name, x)
            yield from out.to_batches()

    return run


def tile_bounds(rows: DataFrame, at: str, per_tile: int) -> np.ndarray:
    """Ascending bounds that cut the values of a column into tiles of about equally many rows: ``per_tile``, or a 4096th of the table where that is more."""
    n = rows.count()
    tiles = min(-(-n // per_tile), 4096)
    if tiles < 2:
        return np.zeros(0, np.int64)
    return np.unique(np.array(rows.approxQuantile(at, [i / tiles for i in range(1, tiles)], 0.25 / tiles), np.int64))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Continuous periods and the gaps between them.

    Returns ``keys.., kind, start, end`` with kind ``period`` (maximal stretch covered by the rows of a key; touching
    rows are continuous) or ``gap`` (stretch between two consecutive periods). All stretches are half-open.
    Rows with a null key, a null bound or ``end <= start`` hold no interval and count for nothing; an empty table gives
    no rows; repeated and nested rows change nothing. Other columns are ignored.
    """
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    rows = rows.where("s is not null and e is not null and e > s").dropna(subset=k)
    longs, by = T.ArrayType(T.LongType()), [*k, "tile"]
    heads = [f for f in rows.select(*k).schema]
    schema = T.StructType([*heads, T.StructField("tile", T.LongType()), T.StructField("s", longs), T.StructField("e", longs)])
    parts = rows.mapInArrow(_build(k, tile_bounds(rows, "s", tile_rows)), schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    some = parts.repartition(*by, "part").sortWithinPartitions(*by, "part").drop("part").mapInArrow(_merge(by), schema)
    lists = stage(some.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge(by), schema))

    in_order = Window.partitionBy(*k).orderBy("tile")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ends = lists.select(*by, F.element_at("s", -1).alias("last_s"), F.element_at("e", -1).alias("last_e"))
    tops = ends.withColumn("carry", F.max("last_e").over(before)).withColumn("last", F.lead("tile").over(in_order).isNull())
    opened = F.when(F.col("carry").isNull() | (F.col("last_s") > F.col("carry")), F.col("last_s"))
    sums = tops.withColumn("owner", F.last(opened, ignorenulls=True).over(before)).select(*by, "carry", "owner", "last")
    out_schema = T.StructType([*heads, T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = lists.join(sums, by).mapInArrow(_emit(k), out_schema)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], "kind", "start", "end")
