"""Clusters of mutually similar records: sparse similarity graph and reciprocal-nearest-neighbour average linkage.

Records are vectors of small whole numbers in which positions may be unknown. They are held as bit planes (a few longs), so that a pair is
compared by a handful of bit operations inside generated code.

Candidates: positions are dealt into blocks in turn; a block's key leaves out one of its positions, so two records share a key if some block
differs in at most one place (after unknown places were filled from their neighbours). With ``b`` blocks every pair that differs in
fewer than ``2 b`` filled places shares one. Records of a bucket aren't paired with each other but with the bucket's leader. Those unlike the leader
stay for another round with a new one; those unlike it, but near enough that a record like the leader could still be like them,
are compared with the whole bucket. So no link between records of a bucket is lost to the sparseness of the graph.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seriesloom.util import drop_stage, stage

BLOCKS = 10
#: Edges that one task holds at most for one home; a home with more is spread over several tasks.
HOME_EDGES = 400_000


def _words(n: int) -> int:
    return max(-(-n // 64), 1)


def plane_columns(n: int, planes: int) -> list[str]:
    """Names of the known mask and the bit planes of vectors with n positions."""
    return [f"k{w}" for w in range(_words(n))] + [f"p{i}_{w}" for i in range(planes) for w in range(_words(n))]


def n_planes(columns: list[str]) -> int:
    """Number of bit planes among the columns of a table (with or without prefix)."""
    return len({c.rsplit("_", 1)[0] for c in columns if c.rsplit("_", 1)[0].rsplit("_", 1)[-1].startswith("p") and c.endswith("_0")})


#: Width of the range of states up to which they are held as their distance from the smallest, beyond it as their rank among those that occur.
WIDE = 1 << 16


def vectors(cells: DataFrame, n: int, planes: int | None = None, ends: tuple[int, int] | None = None) -> DataFrame:
    """One row per record: name, known (number of known positions) and its bit planes.

    cells: (name, pos, state, at), pos from 0 to n - 1. Of several rows for a place the one with the latest ``at`` counts (null is earliest; of equally late
    ones that with the largest state); a null state is unknown. Rows without name or pos are ignored. States may be any whole numbers: they are held as their distance from the
    smallest (``ends`` gives bounds of all states where they are known already), or where these lie far apart as ranks, in as many planes as that needs. With ``planes`` they are such numbers already.
    """
    x = cells.where("name is not null and pos is not null")
    ranks, low = None, 0
    if planes is None:
        low, high = ends or x.agg(F.coalesce(F.min("state"), F.lit(0)), F.coalesce(F.max("state"), F.lit(0))).first()  # one row
        planes = max((high - low).bit_length(), 1)
        if high - low >= WIDE:
            ranks = stage(x.where("state is not null").select("state").distinct())
            planes = max((max(ranks.count(), 1) - 1).bit_length(), 1)
            ranks = ranks.select("state", (F.row_number().over(Window.orderBy("state")) - 1).cast("long").alias("s"))  # the distinct states only
    x = x.groupBy("name", "pos").agg(F.max(F.struct("at", "state")).alias("l")).select("name", "pos", "l.state").where("state is not null")
    x = x.withColumn("s", F.col("state").cast("long") - F.lit(low)) if ranks is None else x.join(ranks, "state")
    x = x.select("name", F.floor(F.col("pos") / 64).alias("w"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bit"), "s")
    out = []
    for w in range(_words(n)):
        out.append(F.bit_or(F.when(F.col("w") == w, F.col("bit")).otherwise(0)).alias(f"k{w}"))
    for i in range(planes):
        for w in range(_words(n)):
            has = (F.col("w") == w) & (F.col("s").bitwiseAND(F.lit(1 << i)) != 0)
            out.append(F.bit_or(F.when(has, F.col("bit")).otherwise(0)).alias(f"p{i}_{w}"))
    y = x.groupBy("name").agg(*out)
    return y.withColumn("known", sum((F.bit_count(f"k{w}") for w in range(_words(n))), F.lit(0)))


def both_known(n: int) -> Column:
    """Places known in both of a pair whose columns are prefixed a_ and b_."""
    return sum((F.bit_count(F.col(f"a_k{w}").bitwiseAND(F.col(f"b_k{w}"))) for w in range(_words(n))), F.lit(0))


def differing(n: int, planes: int) -> Column:
    """Places known in both that differ."""
    total = F.lit(0)
    for w in range(_words(n)):
        x = F.col(f"a_p0_{w}").bitwiseXOR(F.col(f"b_p0_{w}"))
        for i in range(1, planes):
            x = x.bitwiseOR(F.col(f"a_p{i}_{w}").bitwiseXOR(F.col(f"b_p{i}_{w}")))
        total = total + F.bit_count(x.bitwiseAND(F.col(f"a_k{w}")).bitwiseAND(F.col(f"b_k{w}")))
    return total


def states(t: pa.Table, n: int) -> np.ndarray:
    """(rows, n) states of a table of bit planes (from 0 for the smallest), -1 where unknown."""
    def bits(c: str) -> np.ndarray:
        a = t[c].to_numpy().astype("<i8")
        return np.unpackbits(a.view(np.uint8).reshape(len(a), 8), axis=1, bitorder="little")

    out = np.zeros((t.num_rows, _words(n) * 64), np.int64)
    for i in range(n_planes(t.column_names)):
        out += np.concatenate([bits(f"p{i}_{w}") for w in range(_words(n))], axis=1).astype(np.int64) << i
    known = np.concatenate([bits(f"k{w}") for w in range(_words(n))], axis=1)
    return np.where(known == 1, out, -1)[:, :n]


def filled(x: np.ndarray) -> np.ndarray:
    """Unknown places take the value of the known place before them, else of the one after."""
    at = np.where(x >= 0, np.arange(x.shape[1]), -1)
    before = np.maximum.accumulate(at, axis=1)
    first = np.argmax(x >= 0, axis=1)
    return np.take_along_axis(x, np.where(before >= 0, before, first[:, None]), axis=1)


def block_keys(x: np.ndarray, blocks: int) -> np.ndarray:
    """(rows, n) keys: the one at place j is a hash of j's block without j."""
    n = x.shape[1]
    rng = np.random.default_rng(2024)
    odd = rng.integers(1, 1 << 62, (2, n), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + odd[0]) * odd[1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    tag = rng.integers(1, 1 << 63, n, dtype=np.int64).view(np.uint64)
    total = np.stack([h[:, b::blocks].sum(axis=1, dtype=np.uint64) for b in range(blocks)], axis=1)
    with np.errstate(over="ignore"):
        return (total[:, np.arange(n) % blocks] - h + tag[None, :]).view(np.int64)


def _keyed(n: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                t = pa.Table.from_batches([b.slice(lo, 2000)])
                keys = block_keys(filled(states(t, n)), blocks)
                ids, gaps = t["id"].to_numpy(), n - t["known"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, n)), pa.array(np.repeat(gaps, n).astype(np.int32))], ["key", "id", "gaps"])

    return run


def compare(pairs: DataFrame, classes: DataFrame, n: int, least_known: int, most_share: float) -> DataFrame:
    """(a, b) with both (places known in both), diff (of these, differing) and alike."""
    planes = n_planes(classes.columns)
    cols = plane_columns(n, planes)
    side = lambda p: classes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    x = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both_known(n).alias("both"), differing(n, planes).alias("diff"))
    return x.withColumn("alike", (F.col("both") >= least_known) & (F.col("diff") <= F.col("both") * F.lit(most_share)))


def similarity_graph(classes: DataFrame, n: int, least_known: int, most_share: float, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Sparse graph (a, b, sim) whose components are those of all alike pairs that share a bucket, and the stars (id, leader) it was made from."""
    key_type = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("gaps", T.IntegerType())])
    rows = classes.mapInArrow(_keyed(n, blocks), key_type)
    reach = 2 * int(n * most_share)
    found: list[DataFrame] = []
    old: list[DataFrame] = []
    held_back: list[DataFrame] = []
    while True:
        lead = rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("gaps").alias("most_gaps"), F.count("*").alias("c")).where("c > 1").drop("c")
        led = stage(rows.join(lead, "key").where("id <> leader"))
        for o in old:
            drop_stage(o)
        seen = stage(compare(led.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), classes, n, least_known, most_share))
        found.append(seen.where("alike").select("a", "b", "both", "diff"))
        unlike = seen.where("not alike").select(F.col("a").alias("id"), F.col("b").alias("leader"), "diff")
        rest = stage(led.join(unlike, ["id", "leader"]))
        old = [led, rest]
        near = rest.where(F.col("diff") <= F.lit(reach) + F.col("most_gaps")).select("key", F.col("id").alias("x"))
        beside = near.join(led.select("key", F.col("id").alias("y")), "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        checked = stage(compare(beside, classes, n, least_known, most_share).where("alike"))
        found.append(checked.select("a", "b", "both", "diff"))
        held_back += [seen, checked]
        rows = rest.select("key", "id", "gaps")
        if rest.isEmpty():
            break
    alike = found[0]
    for f in found[1:]:
        alike = alike.unionByName(f)
    stars = stage(alike.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("leader"), "both", "diff").distinct())
    for o in [*old, *held_back]:
        drop_stage(o)
    # A leader with very many records would merge with them one at a time: where records that follow each other in a star are alike
    # themselves, the chain takes the place of the star's edge.
    follow = F.lag("id").over(Window.partitionBy("leader", F.shiftright("id", 33)).orderBy("id"))
    linked = stars.withColumn("prev", follow)
    chain = compare(linked.where("prev is not null").select(F.col("id").alias("a"), F.col("prev").alias("b")).distinct(), classes, n, least_known, most_share)
    chain = stage(chain.where("alike").select("a", "b", "both", "diff"))
    held = linked.join(chain.select(F.col("a").alias("id"), F.col("b").alias("prev")), ["id", "prev"], "left_anti").select(F.col("id").alias("a"), F.col("leader").alias("b"), "both", "diff")
    edges = held.unionByName(chain).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (1 - F.col("diff") / F.col("both")).alias("sim")).distinct()
    edges = stage(edges)
    drop_stage(chain)
    return edges, stars


def merge_mutual(a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray, fixed: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Labels after merging all mutual best pairs, round by round, while their average similarity is at least ``threshold``.

    Edges carry the sum and number of the similarities they stand for, so that clusters are compared by their average; pairs without an edge don't count. Nodes marked
    ``fixed`` have neighbours elsewhere and aren't merged. Ties are broken by a hash of the pair that is the same from both sides. A node with one neighbour joins it
    in the same round: nothing that happens to the neighbour changes their average, so that it would join in any case. When a round merges few pairs, the rest are merged best pair
    first (the best of all pairs is always mutual), which gives the same clusters.
    """
    label = np.arange(n)
    while len(a):
        mean = total / count
        order = np.lexsort((_pair_hash(a, b), -mean))
        rank = np.empty(len(a), np.int64)
        rank[order] = np.arange(len(a))
        best = np.full(n, len(a))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        good = (mean >= threshold) & ~fixed[a] & ~fixed[b]
        mutual = good & ((best[a] == rank) & (best[b] == rank) | (degree[a] == 1) | (degree[b] == 1))
        if not mutual.any():
            break
        up = np.arange(n)
        ma, mb = a[mutual], b[mutual]
        while len(ma):
            np.minimum.at(up, np.maximum(ma, mb), np.minimum(ma, mb))
            while (up[up] != up).any():
                up = up[up]
            ma, mb = up[ma], up[mb]
            open_ = ma != mb
            ma, mb = ma[open_], mb[open_]
        label = up[label]
        a, b = up[a], up[b]
        keep = a != b
        a, b, total, count = np.minimum(a, b)[keep], np.maximum(a, b)[keep], total[keep], count[keep]
        u, inv = np.unique(a * n + b, return_inverse=True)
        a, b, total, count = u // n, u % n, np.bincount(inv, total, len(u)), np.bincount(inv, count, len(u))
        if mutual.sum() < FEW * len(np.unique(np.concatenate([a, b]))):
            return _best_first(a, b, total, count, fixed, n, threshold)[label]
    return label


#: Share of the nodes that a round must merge to be worth another round over all edges.
FEW = 0.02


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _best_first(a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray, fixed: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """The merges of :func:`merge_mutual`, one pair at a time, best first; the smaller list of neighbours moves to the larger."""
    near: dict[int, dict[int, tuple[float, float]]] = {}
    for x, y, t, c in zip(a.tolist(), b.tolist(), total.tolist(), count.tolist(), strict=True):
        near.setdefault(x, {})[y] = (t, c)
        near.setdefault(y, {})[x] = (t, c)
    heap = list(zip((-(total / count)).tolist(), _pair_hash(a, b).tolist(), a.tolist(), b.tolist(), strict=True))
    heapq.heapify(heap)
    parent, closed = np.arange(n), fixed.copy()
    while heap:
        m, h, x, y = heapq.heappop(heap)
        if -m < threshold:
            break
        tc = near.get(x, {}).get(y)
        if tc is None or -tc[0] / tc[1] != m:
            continue  # merged or averaged since
        if closed[x] or closed[y]:
            closed[x] = closed[y] = True  # the best partner isn't free: neither is this node
            continue
        if len(near[x]) < len(near[y]):
            x, y = y, x
        parent[y] = x
        del near[x][y]
        for z, (t, c) in near.pop(y).items():
            if z == x:
                continue
            del near[z][y]
            t0, c0 = near[x].get(z, (0.0, 0.0))
            near[x][z] = near[z][x] = (t + t0, c + c0)
            lo, hi = min(x, z), max(x, z)
            heapq.heappush(heap, (-(t + t0) / (c + c0), int(_pair_hash(np.array([lo]), np.array([hi]))[0]), lo, hi))
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _merger(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, codes = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
        fixed = np.zeros(len(ids), bool)
        m = t.num_rows
        fixed[codes[:m][t["a_out"].to_numpy(zero_copy_only=False)]] = True
        fixed[codes[m:][t["b_out"].to_numpy(zero_copy_only=False)]] = True
        label = merge_mutual(codes[:m], codes[m:], t["total"].to_numpy(), t["n"].to_numpy().astype(float), fixed, len(ids), threshold)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["id", "into"])

    return run


def best_pairs(edges: DataFrame, weight: Column) -> DataFrame:
    """(id, best, degree): the neighbour with the largest weight of every node of edges (a, b), ties broken by a hash of the pair."""
    both = edges.select("a", "b", weight.alias("m"), F.xxhash64("a", "b").alias("h"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "m", "h"))
    return both.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("m", "h")).alias("best"), F.count("*").alias("degree"))


def mutual_round(edges: DataFrame) -> DataFrame:
    """(id, into) of one round over edges (a, b, total, n) of any number: mutual best pairs, and nodes with a single neighbour. The best of all pairs is mutual, so the round is never empty."""
    top = best_pairs(edges, F.col("total") / F.col("n"))
    x = edges.select("a", "b").join(top.select(F.col("id").alias("a"), F.col("best").alias("ta"), F.col("degree").alias("da")), "a").join(top.select(F.col("id").alias("b"), F.col("best").alias("tb"), F.col("degree").alias("db")), "b")
    pairs = x.where("ta = b and tb = a").select(F.col("b").alias("id"), F.col("a").alias("into"))
    lone = x.where("not (ta = b and tb = a) and (da = 1 or db = 1)").select(F.when(F.col("da") == 1, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("da") == 1, F.col("b")).otherwise(F.col("a")).alias("to"))
    lone = lone.join(pairs.select(F.col("id").alias("to"), F.col("into").alias("root")), "to", "left").select("id", F.coalesce("root", "to").alias("into"))
    return pairs.unionByName(lone)


def relabel(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """(id, into) of all nodes merged so far, after the merges of ``step``; staged."""
    if labels is None:
        return stage(step)
    moved = labels.join(step.select(F.col("id").alias("into"), F.col("into").alias("to")), "into", "left").select("id", F.coalesce("to", "into").alias("into"))
    return stage(moved.unionByName(step))


def contracted(edges: DataFrame, step: DataFrame) -> DataFrame:
    """The edges with x, y, the clusters of their ends after ``step``, without those that lie inside one."""
    c = edges.join(step.select(F.col("id").alias("a"), F.col("into").alias("ia")), "a", "left").join(step.select(F.col("id").alias("b"), F.col("into").alias("ib")), "b", "left")
    return c.withColumn("x", F.coalesce("ia", "a")).withColumn("y", F.coalesce("ib", "b")).where("x <> y")


def average_linkage(edges: DataFrame, homes: DataFrame, threshold: float, home_edges: int = HOME_EDGES) -> DataFrame:
    """(id, cluster) for every node that was merged; the others are clusters of their own.

    edges: (a, b, sim), a < b; homes: (id, home) says which nodes are best held together. In each pass the edges of a home go to one task, which merges mutual best pairs
    round after round (merging them in any order gives the same tree) as long as both ends have no neighbour in another home; a home with more than ``home_edges`` edges
    is spread by id. If no home can merge any, the pass makes one round over the whole graph instead (:func:`mutual_round`), which always merges some: every pass shrinks the graph.
    Then the graph is contracted, edges between the same clusters are averaged, and homes that touch become one.
    """
    pair = T.StructType([T.StructField("id", T.LongType()), T.StructField("into", T.LongType())])
    e = edges.select("a", "b", F.col("sim").alias("total"), F.lit(1).cast("long").alias("n")).where(F.col("sim") >= threshold)
    labels: DataFrame | None = None
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    old: list[DataFrame] = []
    while True:
        h = e.join(homes.select(F.col("id").alias("a"), F.col("home").alias("ha")), "a", "left").join(homes.select(F.col("id").alias("b"), F.col("home").alias("hb")), "b", "left")
        h = stage(h.select("a", "b", "total", "n", F.coalesce("ha", "a").alias("ha"), F.coalesce("hb", "b").alias("hb")))
        big = h.groupBy(F.col("ha").alias("home")).agg(F.count("*").alias("c")).where(F.col("c") > home_edges)
        over = big.select("home", F.lit(True).alias("big"))
        g = h.join(over.withColumnRenamed("home", "ha").withColumnRenamed("big", "ba"), "ha", "left").join(over.withColumnRenamed("home", "hb").withColumnRenamed("big", "bb"), "hb", "left")
        g = g.withColumn("sa", F.when(F.col("ba"), F.shiftright("a", 33)).otherwise(0)).withColumn("sb", F.when(F.col("bb"), F.shiftright("b", 33)).otherwise(0))
        g = g.withColumn("out", (F.col("ha") != F.col("hb")) | (F.col("sa") != F.col("sb")))
        outer = g.where("out").select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("o", F.lit(True))
        inner = g.where("not out").join(outer.select(F.col("id").alias("a"), F.col("o").alias("a_out")), "a", "left").join(outer.select(F.col("id").alias("b"), F.col("o").alias("b_out")), "b", "left").fillna(False, ["a_out", "b_out"])
        step = stage(inner.repartition(max(parts, 1), "ha", "sa").select("a", "b", "total", "n", "a_out", "b_out").mapInArrow(_merger(threshold), pair))
        if step.isEmpty():
            drop_stage(step)
            step = stage(mutual_round(h))
        labels_new = relabel(labels, step)
        c = contracted(h, step).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "total", "n", F.least("ha", "hb").alias("h"))
        nxt = stage(c.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("h").alias("h")).where(F.col("total") / F.col("n") >= threshold))
        done = nxt.isEmpty()
        for o in [*old, h, step, *([labels] if labels is not None else []), *([nxt] if done else [])]:
            drop_stage(o)
        if done:
            return labels_new.select("id", F.col("into").alias("cluster"))
        homes = stage(nxt.select(F.explode(F.array("a", "b")).alias("id"), "h").groupBy("id").agg(F.min("h").alias("home")))
        old, labels, e = [nxt, homes], labels_new, nxt.select("a", "b", "total", "n")


def _kinds(cells: DataFrame, n: int, least_known: int, ends: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    """Records with their vectors, and one row (id, weight, vector) for each kind of equal records; both staged."""
    v = vectors(cells, n, ends=ends).where(F.col("known") >= least_known)
    cols = plane_columns(n, n_planes(v.columns))
    v = stage(v.withColumn("h1", F.xxhash64(*cols)).withColumn("h2", F.xxhash64(F.lit(7), *reversed(cols))))
    kinds = v.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.first("known").alias("known"), *[F.first(c).alias(c) for c in cols])
    return v, stage(kinds.withColumn("id", F.monotonically_increasing_id()))


def _named(v: DataFrame, kinds: DataFrame, merged: DataFrame) -> DataFrame:
    node = kinds.select("id", "h1", "h2").join(merged, "id", "left").select("h1", "h2", F.coalesce("cluster", "id").alias("cluster"))
    member = v.select("name", "h1", "h2").join(node, ["h1", "h2"]).select("name", "cluster")
    named = member.groupBy("cluster").agg(F.min("name").alias("cluster_name"), F.count("*").alias("size")).where("size > 1")
    return member.join(named, "cluster").select("name", "cluster", "cluster_name", "size")


def clusters(cells: DataFrame, n: int, least_known: int, most_share: float, blocks: int = BLOCKS, ends: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, cluster, cluster_name, size) of every record in a cluster of two or more, and its vectors (name, bit planes).

    Two records are alike if at least ``least_known`` places are known in both and at most ``most_share`` of these differ. The graph holds alike
    pairs only and pairs without an edge don't count, so linkage ends when no alike pair joins two clusters: alike directly or through others is one cluster. See
    :func:`close_clusters` for clusters whose members are alike on average. Equal records are one node. Records with fewer than ``least_known`` known places are like none.
    """
    v, kinds = _kinds(cells, n, least_known, ends)
    edges, stars = similarity_graph(kinds, n, least_known, most_share, blocks)
    merged = average_linkage(edges, _homes(stars), 1 - most_share)
    for o in (edges, stars):
        drop_stage(o)
    return _named(v, kinds, merged), v.select("name", *plane_columns(n, n_planes(v.columns)))


PROFILE = "id long, places array<long>, counts array<long>"


def _dense(t: pa.Table, sides: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places that occur, and the counts of the profiles of each side (rows, places)."""
    flat = lambda c: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
    lists = [flat(t[f"{p}places"].combine_chunks()) for p in sides]
    counts = [flat(t[f"{p}counts"].combine_chunks()).flatten().to_numpy() for p in sides]
    places, at = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)
    out, begin = [], 0
    for x, c in zip(lists, counts, strict=True):
        d = np.zeros((t.num_rows, len(places)))
        d[np.repeat(np.arange(t.num_rows), np.diff(x.offsets.to_numpy())), at[begin : begin + len(c)]] = c
        begin += len(c)
        out.append(d)
    return places, out


def _sparse(ids: np.ndarray, places: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    row, col = np.nonzero(dense)
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (places[col].astype(np.int64), dense[row, col].astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["id", "places", "counts"])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.Table]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield pa.Table.from_batches([b.slice(lo, rows)])


def profiles(kinds: DataFrame, n: int, top: int) -> DataFrame:
    """Sparse profile of each kind: place (position * (top + 1) + state) and the number of records there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            x = states(t, n)
            row, pos = np.nonzero(x >= 0)
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(y)) for y in (pos * (top + 1) + x[row, pos], t["weight"].to_numpy()[row])]
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), *lists], ["id", "places", "counts"])

    return kinds.mapInArrow(run, PROFILE)


def average_similarity(pairs: DataFrame, prof: DataFrame, top: int) -> DataFrame:
    """(a, b, sim) of pairs (a, b) of clusters: of all pairs of their records, the share of the places known in both that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            places, (x, y) = _dense(t, ["a_", "b_"])
            pos = places // (top + 1)
            first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
            known = [np.add.reduceat(d, first, axis=1) for d in (x, y)]
            sim = np.einsum("ij,ij->i", x, y) / np.maximum(np.einsum("ij,ij->i", *known), 1)
            yield pa.RecordBatch.from_arrays([t["a"].combine_chunks(), t["b"].combine_chunks(), pa.array(sim)], ["a", "b", "sim"])

    side = lambda p: prof.select(F.col("id").alias(p), F.col("places").alias(f"{p}_places"), F.col("counts").alias(f"{p}_counts"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, sim double")


def merged_profiles(prof: DataFrame, step: DataFrame) -> DataFrame:
    """Profiles after the pairs of ``step`` (id, into) were merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            places, (x, y) = _dense(t, ["", "b_"])
            yield _sparse(t["id"].to_numpy(), places, x + y)

    gone = step.select("id")
    grown = prof.join(step.select(F.col("into").alias("id"), F.col("id").alias("other")), "id").join(prof.select(F.col("id").alias("other"), F.col("places").alias("b_places"), F.col("counts").alias("b_counts")), "other")
    rest = prof.join(gone, "id", "left_anti").join(step.select(F.col("into").alias("id")), "id", "left_anti")
    return rest.select("id", "places", "counts").unionByName(grown.select("id", "places", "counts", "b_places", "b_counts").mapInArrow(run, PROFILE))


#: Edges of a component that one task takes at most; larger ones are worked on in rounds over all tasks until they are as small.
TASK_EDGES = 5_000


class _Task:
    """Average linkage of one component: dense profiles of its clusters and the pairs compared so far."""

    def __init__(self, profile: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> None:
        self.profile, self.known, self.threshold = profile, known, threshold
        self.label = np.arange(len(profile))
        self.a, self.b = np.minimum(a, b), np.maximum(a, b)
        self.sim = self.similarity(self.a, self.b)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.profile[a], self.profile[b]) / np.maximum(np.einsum("ij,ij->i", self.known[a], self.known[b]), 1)

    def merge_round(self) -> bool:
        """Merges all mutual best pairs that reach the threshold and takes the averages of those that changed anew; false if there are none."""
        n = len(self.label)
        good = np.flatnonzero(self.sim >= self.threshold)
        a, b = self.a[good], self.b[good]
        rank = np.empty(len(good), np.int64)
        rank[np.lexsort((_pair_hash(a, b), -self.sim[good]))] = np.arange(len(good))
        best = np.full(n, len(good))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        mutual = (best[a] == rank) & (best[b] == rank)
        if not mutual.any():
            return False
        into, gone = a[mutual], b[mutual]
        self.profile[into] += self.profile[gone]
        self.known[into] += self.known[gone]
        up = np.arange(n)
        up[gone] = into
        self.label = up[self.label]
        changed = np.zeros(n, bool)
        changed[into] = True
        a, b = up[self.a], up[self.b]
        keep = a != b
        a, b, sim = np.minimum(a, b)[keep], np.maximum(a, b)[keep], self.sim[keep]
        u, first = np.unique(a * n + b, return_index=True)
        self.a, self.b, self.sim = u // n, u % n, sim[first]
        again = changed[self.a] | changed[self.b]
        self.sim[again] = self.similarity(self.a[again], self.b[again])
        return True

    def beside(self) -> bool:
        """Compares clusters with a neighbour in common, each with the neighbour's first and the next one; false if none of the new pairs reaches the threshold."""
        n = len(self.label)
        x, y = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
        o = np.lexsort((y, x))
        x, y = x[o], y[o]
        start = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
        first = y[np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))] if len(x) else y
        p, q = np.concatenate([y[~start], y[~start]]), np.concatenate([first[~start], np.roll(y, 1)[~start]])
        keep = p != q
        u = np.unique(np.minimum(p, q)[keep] * n + np.maximum(p, q)[keep])
        u = u[~np.isin(u, self.a * n + self.b)]
        a, b = u // n, u % n
        sim = self.similarity(a, b)
        self.a, self.b, self.sim = np.concatenate([self.a, a]), np.concatenate([self.b, b]), np.concatenate([self.sim, sim])
        return bool((sim >= self.threshold).any())

    def run(self) -> np.ndarray:
        """Cluster of each node: the smallest node in it."""
        while self.merge_round() or self.beside():
            pass
        return self.label


def _finish(top: int, threshold: float):
    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids = np.sort(nodes["id"].to_numpy())
        nodes = nodes.take(pa.array(np.argsort(nodes["id"].to_numpy())))
        places, (profile,) = _dense(nodes, [""])
        pos = places // (top + 1)
        known = np.add.reduceat(profile, np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]]), axis=1)
        label = _Task(profile, known, np.searchsorted(ids, edges["a"].to_numpy()), np.searchsorted(ids, edges["b"].to_numpy()), threshold).run()
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"id": ids[moved], "into": ids[label[moved]]})

    return run


def close_clusters(cells: DataFrame, n: int, least_known: int, most_share: float, blocks: int = BLOCKS, ends: tuple[int, int] | None = None, task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters of records that are alike on average; returns what :func:`clusters` does.

    Average linkage in rounds over the sparse graph of alike records: all mutual best pairs of clusters are merged, then the averages of those that changed are taken anew, over all
    pairs of their records (unlike ones and ones without an edge too), from the clusters' profiles of states. Where no pair reaches the threshold any more, clusters that have a neighbour in common
    are compared, each with the first and the next one beside it; linkage ends when none of these reaches it either. A cluster is a row with one count per place and state, whatever its size.
    Parts that no edge joins (the result of :func:`average_linkage` over alike pairs) don't touch each other: one with up to ``task_edges`` edges is finished in one task, a larger one by
    rounds over all tasks, which are the same, until it is as small.
    """
    v, kinds = _kinds(cells, n, least_known, ends)
    top = (1 << n_planes(v.columns)) - 1
    threshold = 1 - most_share
    edges, stars = similarity_graph(kinds, n, least_known, most_share, blocks)
    parts = average_linkage(edges, _homes(stars), threshold)
    part = F.coalesce("cluster", "a").alias("part")
    e = stage(edges.select("a", "b").join(parts.withColumnRenamed("id", "a"), "a", "left").select("a", "b", part))
    for o in (edges, stars):
        drop_stage(o)
    near = e.select(F.explode(F.array("a", "b")).alias("id"), "part").distinct()
    prof = stage(profiles(kinds, n, top).join(near, "id"))
    labels: DataFrame | None = None
    sims = False  # whether e has the averages: only rounds over all tasks need them
    while True:
        small = e.groupBy("part").agg(F.count("*").alias("c")).where(F.col("c") <= task_edges).select("part")
        step = stage(prof.join(small, "part", "left_semi").groupBy("part").cogroup(e.join(small, "part", "left_semi").select("a", "b", "part").groupBy("part")).applyInArrow(_finish(top, threshold), "id long, into long"))
        labels_new = relabel(labels, step)
        for o in [step, *([labels] if labels is not None else [])]:
            drop_stage(o)
        labels = labels_new
        big = stage(e.join(small, "part", "left_anti"))
        drop_stage(e)
        if big.isEmpty():
            break
        e = big
        if not sims:
            e, sims = stage(_with_sims(big, prof, top)), True
            drop_stage(big)
        e, prof, labels = _round(e, prof, labels, threshold, top)
    for o in (big, prof):
        drop_stage(o)
    return _named(v, kinds, labels.select("id", F.col("into").alias("cluster"))), v.select("name", *plane_columns(n, n_planes(v.columns)))


def _homes(stars: DataFrame) -> DataFrame:
    homes = stars.groupBy("id").agg(F.min("leader").alias("home"))
    return homes.join(homes.select(F.col("id").alias("home"), F.col("home").alias("higher")), "home", "left").select("id", F.coalesce("higher", "home").alias("home"))


def _with_sims(pairs: DataFrame, prof: DataFrame, top: int) -> DataFrame:
    return average_similarity(pairs.select("a", "b"), prof, top).join(pairs.select("a", "b", "part"), ["a", "b"])


def _round(e: DataFrame, prof: DataFrame, labels: DataFrame, threshold: float, top: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over all tasks: edges (a, b, sim, part), profiles and labels after it. A part without a pair that reaches the threshold, compared beside too, has no edges any more."""
    good = e.where(F.col("sim") >= threshold)
    best = best_pairs(good, F.col("sim"))
    pairs = good.select("a", "b").join(best.select(F.col("id").alias("a"), F.col("best").alias("ta")), "a").join(best.select(F.col("id").alias("b"), F.col("best").alias("tb")), "b")
    step = stage(pairs.where("ta = b and tb = a").select(F.col("b").alias("id"), F.col("a").alias("into")))
    stuck = e.join(good.select("part").distinct(), "part", "left_anti")
    more = stage(_beside(stuck, prof, top))
    more_good = more.where(F.col("sim") >= threshold).select("part").distinct()
    labels_new = relabel(labels, step)
    width = merged_profiles(prof, step)
    prof_new = stage(width.join(prof.select("id", "part"), "id"))
    c = contracted(e.join(good.select("part").distinct(), "part", "left_semi"), step.unionByName(step.select(F.col("into").alias("id"), "into")))
    c = stage(c.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.coalesce("ia", "ib")).alias("changed"), F.first("sim").alias("sim"), F.first("part").alias("part")))
    cols = ["a", "b", "sim", "part"]
    nxt = c.where("changed is null").select(*cols).unionByName(_with_sims(c.where("changed is not null"), prof_new, top).select(*cols))
    nxt = stage(nxt.unionByName(stuck.unionByName(more.select(*stuck.columns)).join(more_good, "part", "left_semi").select(*cols)))
    for o in (e, c, step, prof, labels, more):
        drop_stage(o)
    return nxt, prof_new, labels_new


def _beside(e: DataFrame, prof: DataFrame, top: int) -> DataFrame:
    """(a, b, sim, part) of clusters with a neighbour in common that weren't compared yet: each with the neighbour's first and with the next one."""
    both = e.select("a", "b", "part").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    first = both.groupBy("a").agg(F.min("b").alias("f"))
    w = Window.partitionBy("a", F.shiftright("b", 33)).orderBy("b")
    x = both.withColumn("l", F.lag("b").over(w)).join(first, "a").select("b", "part", F.explode(F.array("f", "l")).alias("o")).where("o is not null and b <> o")
    x = x.select(F.least("b", "o").alias("a"), F.greatest("b", "o").alias("b"), "part").distinct()
    return _with_sims(x.join(e.select("a", "b"), ["a", "b"], "left_anti"), prof, top)


def describe(members: DataFrame, planes: DataFrame, n: int, top: int = 3) -> DataFrame:
    """One row per cluster: size and its most typical members, those that differ least from the most frequent state of each place."""
    k = n_planes(planes.columns)
    cols = plane_columns(n, k)
    w = _words(n)
    m = members.join(planes, "name")
    m = stage(m)
    x = m.select("cluster", *cols, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    at = lambda c: F.expr(f"shiftrightunsigned({c}, cast(pos % 64 as int)) & 1L")
    pick = lambda c: sum((F.when(F.floor(F.col("pos") / 64) == i, at(f"{c}{i}")).otherwise(0) for i in range(w)), F.lit(0))
    x = x.where(pick("k") == 1).select("cluster", "pos", sum((pick(f"p{i}_") * (1 << i) for i in range(k)), F.lit(0)).alias("state"))
    mode = x.groupBy("cluster", "pos", "state").agg(F.count("*").alias("c")).groupBy("cluster", "pos").agg(F.max_by("state", F.struct(F.col("c"), -F.col("state"))).alias("state"))
    usual = vectors(mode.select(F.col("cluster").alias("name"), "pos", "state", F.lit(0).alias("at")), n, k)
    a = m.select("cluster", "name", "cluster_name", "size", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = usual.select(F.col("name").alias("cluster"), *[F.col(c).alias(f"b_{c}") for c in cols])
    y = a.join(b, "cluster").select("cluster_name", "size", "name", F.round(1 - differing(n, k) / both_known(n), 6).alias("likeness"))
    best = Window.partitionBy("cluster_name").orderBy(F.desc("likeness"), "name")
    y = y.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    return y.groupBy("cluster_name", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("typical"), F.max("likeness").alias("likeness"))
