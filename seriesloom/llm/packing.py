"""Filling containers of fixed capacity with items of varying length.

Items of one length are interchangeable, so the packing is planned on the number of items of each length, at most ``capacity``
numbers, and items take their places by exact position among those of their length. The plan has one entry for
each run of equal steps, whatever the number of items.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.ranks import positions


class Gaps:
    """Runs of containers by free space, with the smallest sufficient space found in a bit set."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.bits = 0

    def put(self, space: int, first: int, n: int) -> None:
        if n:
            self.runs[space].append((first, n))
            self.bits |= 1 << space

    def best(self, size: int) -> int | None:
        rest = self.bits >> size
        return None if not rest else size + (rest & -rest).bit_length() - 1

    def take(self, space: int, n: int) -> tuple[int, int]:
        """Up to n containers of a run with this space."""
        first, there = self.runs[space].pop()
        k = min(n, there)
        if k < there:
            self.runs[space].append((first + k, there - k))
        if not self.runs[space]:
            self.bits &= ~(1 << space)
        return first, k


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (size, first item, number of items, first container, items per container) for items of 1 to ``capacity``.

    Items above a third of the capacity are matched first: the largest takes the largest partner above a third that still fits beside it,
    so at most two of them share a container. Smaller ones follow, largest first, each into the smallest gap that takes it,
    and only else into a new container.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    steps: list[tuple[int, int, int, int, int]] = []
    gaps, bins = Gaps(), 0

    def place(size: int, n: int, first_bin: int, per: int = 1) -> None:
        steps.append((size, used[size], n * per, first_bin, per))
        used[size] += n * per

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    open_bits = sum(1 << s for s in large)
    for a in large:
        while n := left[a]:
            fits = open_bits & ((1 << (capacity - a + 1)) - 1) if capacity > a else 0
            b = fits.bit_length() - 1
            if b <= 0:
                place(a, n, bins)
                gaps.put(capacity - a, bins, n)
                bins, left[a] = bins + n, 0
            elif b == a:
                k = n // 2
                if k:
                    place(a, k, bins, 2)
                    gaps.put(capacity - 2 * a, bins, k)
                    bins, left[a] = bins + k, n - 2 * k
                if left[a]:  # the odd one looks for a smaller partner
                    low = open_bits & ((1 << a) - 1)
                    c = low.bit_length() - 1
                    place(a, 1, bins)
                    if c > 0:
                        place(c, 1, bins)
                        left[c] -= 1
                        if not left[c]:
                            open_bits &= ~(1 << c)
                    gaps.put(capacity - a - max(c, 0), bins, 1)
                    bins, left[a] = bins + 1, 0
            else:
                k = min(n, left[b])
                place(a, k, bins)
                place(b, k, bins)
                gaps.put(capacity - a - b, bins, k)
                bins += k
                left[a] -= k
                left[b] -= k
                if not left[b]:
                    open_bits &= ~(1 << b)
        open_bits &= ~(1 << a)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            space = gaps.best(s)
            if space is None:
                per = capacity // s
                k = n // per
                if k:
                    place(s, k, bins, per)
                    gaps.put(capacity - per * s, bins, k)
                if rest := n - k * per:
                    place(s, 1, bins + k, rest)
                    gaps.put(capacity - rest * s, bins + k, 1)
                bins += k + bool(rest)
                n = 0
            else:
                per = space // s  # equal items fill the same container until the gap is too small for one more
                first, k = gaps.take(space, max(1, n // per))
                per = min(per, n)
                place(s, k, first, per)
                gaps.put(space - per * s, first, k)
                n -= k * per
    return steps


def pieces(items: DataFrame, packs: DataFrame) -> DataFrame:
    """Each item once per container kind: whole, or where it is larger than the capacity, in full pieces and a rest.

    items: (item, tokens); packs: (pack_name, capacity_tokens), small. Returns pack_name, capacity, item, piece_no, tokens.
    Items without tokens (null counts as 0) stay as one piece of 0 tokens; without any kind of container there are no pieces.
    """
    p = packs.where("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    kinds = [(r["pack_name"], r["capacity"]) for r in p.collect()]  # one row per kind of container
    each = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in kinds]).cast("array<struct<pack_name:string,capacity:bigint>>")
    x = items.select("item", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("all"), F.explode(each).alias("k")).select("item", "all", "k.*")
    n = F.greatest(F.ceil(F.col("all") / F.col("capacity")), F.lit(1)).cast("long")
    x = x.select("pack_name", "capacity", "item", "all", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece_no"))
    return x.select("pack_name", "capacity", "item", "piece_no", F.least(F.col("capacity"), F.col("all") - F.col("piece_no") * F.col("capacity")).alias("tokens"))


def pack(items: DataFrame, packs: DataFrame, seed: int = 11) -> DataFrame:
    """pack_name, capacity, item, piece_no, tokens, container: every piece of every item in exactly one container of each kind.

    Container numbers start at 0 for each kind. Pieces of 0 tokens take no space and lie in container 0. ``item`` must be unique.
    """
    spark = items.sparkSession
    x = pieces(items, packs)
    sizes: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in x.groupBy("pack_name", "capacity", "tokens").agg(F.count("*").alias("n")).collect():  # at most capacity + 1 rows for each kind
        sizes[r["pack_name"], r["capacity"]][r["tokens"]] = r["n"]
    rows = []
    for (name, cap), counts in sizes.items():
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for size, first, _, start, per in plan({s: n for s, n in counts.items() if s}, cap):
            by[size].append((first, start, per))
        if 0 in counts:
            by[0].append((0, 0, 1 << 60))
        rows += [(name, s, [f for f, _, _ in sorted(r)], [b for _, b, _ in sorted(r)], [p for _, _, p in sorted(r)]) for s, r in by.items()]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("pack_name", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("first", longs), T.StructField("start", longs), T.StructField("per", longs)])
    steps = spark.createDataFrame(rows, schema)
    placed = positions(x, ["pack_name", "tokens"], ["item", "piece_no"], seed).join(steps, ["pack_name", "tokens"])
    i = F.size(F.filter("first", lambda f: f <= F.col("pos"))) - 1
    y = placed.withColumn("i", i)
    at = F.get("start", F.col("i")) + F.floor((F.col("pos") - F.get("first", F.col("i"))) / F.get("per", F.col("i")))
    return y.select("pack_name", "capacity", "item", "piece_no", "tokens", at.cast("long").alias("container"))
