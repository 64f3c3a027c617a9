"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.components import components
from seriesloom.llm.ranks import positions

#: Entries, by letters and digits, that say that a library isn't known.
UNKNOWN = ["NA", "NAN", "NIL", "NONE", "NULL", "UNK", "UNKNOWN", "NOTKNOWN", "NOTAVAILABLE", "MISSING", "UNDEFINED", "UNSPECIFIED", "TBD", "TBA", "PENDING", "NOTRECORDED", "NOTSPECIFIED", "NOLIBRARY", "UNBEKANNT", "INCONNU", "DESCONOCIDO"]


def known_library(x: Column) -> Column:
    """Letters and digits of a library in upper case; null if the entry says that it isn't known."""
    bare = F.upper(F.regexp_replace(x, r"[^0-9A-Za-z]", ""))
    rest = F.regexp_replace(bare, r"^SLX", "")
    return F.when((rest != "") & ~rest.isin(UNKNOWN) & ~rest.rlike("^0+$"), bare)


def uid_of(uid: Column, name: Column) -> Column:
    """UID in upper case without outer blanks; the first field of name where it is null or blank."""
    clean = lambda x: F.nullif(F.upper(F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), F.lit(""))
    return F.coalesce(clean(uid), clean(F.split(name, "_").getItem(0)))


def libraries_of(slx: Column, name: Column) -> Column:
    """Array of the known libraries of a row; the second field of name stands in for a null or blank slx."""
    blank = slx.isNull() | slx.rlike(r"^[\s ]*$")
    entry = F.when(blank, F.get(F.split(name, "_"), F.lit(1))).otherwise(slx)
    parts = F.transform(F.split(entry, r"[+;/]"), known_library)
    return F.when(known_library(entry).isNotNull(), F.array_compact(F.array_distinct(parts)))


def library_links(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) edges between a UID and a library; rows has uid, libs."""
    return rows.where("uid is not null").select(F.concat(F.lit("u:"), "uid").alias("a"), F.explode("libs").alias("lib")).select("a", F.concat(F.lit("l:"), "lib").alias("b")).distinct()


def fill(counts: list[tuple[int, int]], shares: list[tuple[str, float]]) -> list[tuple[int, int, int, str]]:
    """Greedy largest first. counts: (size, number of groups of that size); shares: (split, share).

    Returns (size, first, past, split), at most one for each size and split: of the groups of a size, as many go to a split as greedy steps would give it, each to the split
    furthest below its target (ties to the one named first). Groups of a size are alike, so their steps aren't taken one by one: they raise the lowest splits together, like water.
    """
    total = sum(s * n for s, n in counts)
    norm = sum(x for _, x in shares) or 1.0
    lack = [total * x / norm for _, x in shares]  # how far each split is below its target
    out: list[tuple[int, int, int, str]] = []
    for size, n in sorted(counts, reverse=True):
        take = _water(lack, size, n) if size > 0 else [n] + [0] * (len(lack) - 1)
        first = 0
        for i, k in enumerate(take):
            lack[i] -= k * size
            if k:
                out.append((size, first, first + k, shares[i][0]))
                first += k
    return out


def _water(lack: list[float], size: int, n: int) -> list[int]:
    """How many of n groups of one size each split gets when every group goes to the split with the largest lack."""
    def given(level: float) -> list[int]:  # groups that a split gets while its lack is above the level
        return [max(0, math.ceil((x - level) / size)) for x in lack]

    lo, hi = min(lack) - (n + 1) * size, max(lack)  # the lower level gives at least n, the upper none
    while hi - lo > size / 1000:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if sum(given(mid)) > n:
            lo = mid
        else:
            hi = mid
    take = given(hi)
    for _ in range(n - sum(take)):  # at most one or two for each split are left
        i = max(range(len(lack)), key=lambda k: (lack[k] - take[k] * size, -k))
        take[i] += 1
    return take


def assign_groups(groups: DataFrame, shares: DataFrame, seed: int = 7) -> DataFrame:
    """(grp, size) to (grp, size, split).

    Only the number of groups of each size reaches the driver: at most about sqrt(2 N) rows for N records. Which of the
    equally large groups go where follows their exact position in a pseudo-random order.
    """
    spark = groups.sparkSession
    ratio = [(r["split_name"], float(r["share"])) for r in shares.orderBy("split_name").collect() if r["share"] and r["share"] > 0]
    counts = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    ratio.sort(key=lambda x: -x[1])
    steps = _classes(fill(counts, ratio)) if ratio else []
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("of", T.LongType()), T.StructField("cuts", T.ArrayType(T.LongType())), T.StructField("names", T.ArrayType(T.StringType()))])
    plan = spark.createDataFrame(steps, schema)
    placed = positions(groups, ["size"], ["grp"], seed)
    at = F.size(F.filter("cuts", lambda c: c <= F.col("pos")))
    return placed.join(plan, "size").select("grp", "size", F.get("names", at).alias("split"))


def _classes(steps: list[tuple[int, int, int, str]]) -> list[tuple[int, int, list[int], list[str]]]:
    """One row per size: where the groups of each split end."""
    per: dict[int, dict[str, int]] = {}
    for size, a, b, name in steps:
        per.setdefault(size, {})
        per[size][name] = per[size].get(name, 0) + b - a
    out = []
    for size, names in per.items():
        ends, total = [], 0
        for n in names.values():
            total += n
            ends.append(total)
        out.append((size, total, ends[:-1], list(names)))
    return out


def related_splits(records: DataFrame, links: DataFrame, shares: DataFrame) -> DataFrame:
    """Assigns every record to a split.

    records: (record, entity); links: (a, b) between entities and whatever they share, entities written as in ``links.a``. All
    records whose entities are linked, directly or through others, get one split. Returns record, entity, grp, split. Entities without links are
    groups of their own. Null entities are one group each record. Empty records give no rows.
    """
    comp = components(links)
    r = records.withColumn("key", F.coalesce(F.concat(F.lit("u:"), "entity"), F.concat(F.lit("r:"), "record")))
    sizes = r.groupBy("key").agg(F.count("*").alias("n"))
    named = sizes.join(comp, sizes["key"] == comp["node"], "left").select("key", "n", F.coalesce("root", "key").alias("grp"))
    groups = named.groupBy("grp").agg(F.sum("n").alias("size"))
    split = assign_groups(groups, shares)
    entity = named.select("key", "grp").join(split.select("grp", "split"), "grp")
    return r.join(entity, "key").select("record", "entity", "grp", "split")
