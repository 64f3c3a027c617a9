"""Periods and gaps against brute force, and the defined results of odd input."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.operators.interval_sets import merge_intervals, merge_sorted, merge_tree


def brute(rows):
    out = set()
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    return out


def run(spark, rows, tile):
    df = spark.createDataFrame([(k, s, e, "x", 1) for k, s, e in rows], "k string, s long, e long, kind string, start int")
    got = merge_intervals(df, ["k"], "s", "e", tile).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50), st.integers(1, 30)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_merge_sorted_is_the_union(rows):
    g, s, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    a, b, c = merge_sorted(g, s, s + n)
    got = {(int(x), "period", int(y), int(z)) for x, y, z in zip(a, b, c, strict=True)}
    assert got == {r for r in brute([(int(x), int(y), int(y + z)) for x, y, z in zip(g, s, n, strict=True)]) if r[1] == "period"}


def test_random_rows_over_many_tiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), s := rng.randrange(-300, 3000), s + rng.choice([1, 2, 5, 20, 400])) for _ in range(400)]
    for tile in (7, 64, 1 << 22):
        assert run(spark, rows, tile) == brute(rows)


def test_a_period_over_several_tiles_and_touching_rows(spark):
    rows = [("a", 0, 1000), ("a", 10, 20), ("a", 1000, 1001), ("a", 1002, 1003), ("a", 500, 1001)]
    assert run(spark, rows, 16) == {("a", "period", 0, 1001), ("a", "gap", 1001, 1002), ("a", "period", 1002, 1003)}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5, 5), ("a", 9, 3), ("b", 1, 4), ("b", 1, 4), ("b", 1, 4)]
    assert run(spark, rows, 8) == {("b", "period", 1, 4)}
    assert run(spark, [], 8) == set()


def test_one_key_with_most_rows(spark):
    rows = [("hot", 3 * i, 3 * i + 2) for i in range(5000)] + [("cold", 1, 2)]
    got = run(spark, rows, 256)
    assert len(got) == 5000 + 4999 + 1


def test_partial_lists_merge_linearly_in_a_tree():
    rng = np.random.default_rng(3)
    for wide in (1, 1 << 45):
        for _ in range(60):
            group, size, start, end, rows = [], [], [], [], []
            for _ in range(int(rng.integers(0, 12))):
                g = int(rng.integers(0, 4))
                x = np.sort(rng.choice(200, 2 * int(rng.integers(1, 9)), replace=False)) * wide
                group.append(g), size.append(len(x) // 2), start.extend(x[::2]), end.extend(x[1::2])
                rows += [(g, int(a), int(b)) for a, b in zip(x[::2], x[1::2], strict=True)]
            got = merge_tree(*[np.array(v, np.int64) for v in (group, size, start, end)])
            assert {(int(a), "period", int(b), int(c)) for a, b, c in zip(got.group, got.start, got.end, strict=True)} == {r for r in brute(rows) if r[1] == "period"}


def test_sparse_wide_coordinates_and_a_far_outlier(spark):
    rng = random.Random(8)
    rows = [("t", s := rng.randrange(10**15), s + rng.randrange(1, 10**12)) for _ in range(700)] + [("t", 9 * 10**18, 9 * 10**18 + 5), ("u", -(10**18), 10**18)]
    assert run(spark, rows, 50) == brute(rows)
