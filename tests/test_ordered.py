"""Rows in order with hot keys, duplicates, samples and ranges against brute force; nulls, ties and empty tables."""

import hashlib
import random

from seriesloom.operators import cohort, ordered, ranges


def test_numbers_and_ranks_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), i, rng.randrange(40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    got = {r.i: r.n for r in ordered.numbered(df, ["k"], ["v", "i"], "n").collect()}
    low = {r.i: r.n for r in ordered.ranked(df, ["k"], "v", "n").collect()}
    high = {r.i: r.n for r in ordered.ranked(df, ["k"], "v", "n", "high").collect()}
    for k in ("hot", "a", None):
        part = sorted((v, i) for x, i, v in rows if x == k)
        values = [v for v, _ in part]
        assert [got[i] for _, i in part] == list(range(1, len(part) + 1))
        assert all(low[i] == values.index(v) + 1 and high[i] == len(values) - values[::-1].index(v) for v, i in part)
    assert ordered.numbered(df.where("false"), ["k"], ["i"], "n").count() == 0
    whole = [r.i for r in ordered.numbered(df, [], ["v", "i"], "n").orderBy("n").collect()]
    assert whole == [i for _, i in sorted((v, i) for _, i, v in rows)]


def test_groups_on_rows_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, None)], "k string, v double")
    from pyspark.sql import functions as F

    assert sorted((r.v or 0, r.m) for r in ordered.with_group(df, ["k"], m=F.avg("v")).collect()) == [(0, 5.0), (1.0, 2.0), (3.0, 2.0), (5.0, 5.0)]


def brute_depth(rows):
    out = {}
    for k in {r[0] for r in rows}:
        depth = {}
        for _, s, e in [r for r in rows if r[0] == k and r[1] is not None and r[2] is not None and r[1] <= r[2]]:
            for x in range(s, e + 1):
                depth[x] = depth.get(x, 0) + 1
        if depth:
            out[k] = [depth.get(x, 0) for x in range(min(depth), max(depth) + 1)], min(depth)
    return out


def test_coverage_and_peaks_with_one_key_of_most_rows(spark):
    rng = random.Random(6)
    rows = [("hot", s := rng.randrange(600), s + rng.choice([0, 1, 5, 40])) for _ in range(900)] + [(k, s := rng.randrange(50), s + rng.randrange(9)) for k in "ab" for _ in range(12)] + [("a", None, 4), ("a", 9, 3), ("c", 5, 5), ("c", 5, 5), ("c", 7, 9)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    steps = ranges.coverage(df, ["k"])
    want = brute_depth(rows)
    got = {}
    for r in sorted(steps.collect(), key=lambda r: (r.k, r.start)):
        got.setdefault(r.k, []).append(r)
    assert got.keys() == want.keys()
    for k, v in got.items():
        flat = [r.depth for r in v for _ in range(r.start, r.end + 1)]
        assert flat == want[k][0] and v[0].start == want[k][1]
        assert all(a.end + 1 == b.start and a.depth != b.depth for a, b in zip(v, v[1:], strict=False))
    for least in (1, 2, 5):
        peaks = sorted((r.k, r.start, r.end, r.top, round(r.mean_depth, 9)) for r in ranges.peaks(steps, ["k"], least).collect())
        expect = []
        for k, (d, at) in want.items():
            i = 0
            while i < len(d):
                if d[i] >= least:
                    j = i
                    while j + 1 < len(d) and d[j + 1] >= least:
                        j += 1
                    expect.append((k, at + i, at + j, max(d[i : j + 1]), round(sum(d[i : j + 1]) / (j - i + 1), 9)))
                    i = j
                i += 1
        assert peaks == sorted(expect)
    assert ranges.peaks(ranges.coverage(df.where("false"), ["k"]), ["k"], 1).count() == 0


def test_duplicates_mates_and_samples(spark):
    rows = [("s", 5, True, 2, 1), ("s", 5, True, 1, 2), ("s", 5, False, 1, 1), ("s", 9, True, 1, 3), ("t", 5, True, 1, 1), (None, 5, True, 1, 1), (None, 5, True, 3, 1)]
    df = spark.createDataFrame(rows, "series string, pos int, plus boolean, fragment int, line int")
    u = cohort.without_duplicates(df, ["series", "pos", "plus"], ["fragment", "line"])
    assert sorted(map(str, u.collect())) == sorted(map(str, df.where("not (series = 's' and fragment = 2) and not (series is null and fragment = 3) or series = 't'").unionByName(df.where("series is null and fragment = 1")).distinct().collect()))
    m = cohort.one_mate(u, ["series", "fragment"], ["line", "pos", "plus"])
    assert m.where("series = 's'").count() == 1
    ids = spark.range(5000)
    got = {r.id for r in cohort.hash_sample(ids, ["id"], 0.1, 3).collect()}
    assert got == {i for i in range(5000) if int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:8], 16) < round(0.1 * 16**8)}
    assert cohort.hash_sample(ids, ["id"], 1.0).count() == 5000 and cohort.hash_sample(ids, ["id"], 0.0).count() == 0
