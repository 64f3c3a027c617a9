"""Queries on small tables against brute force: every row that belongs to the result is there."""

import datetime
import math
from collections import defaultdict

import numpy as np
import pytest

from seriesloom.operators import states
from seriesloom.plans import kernels

ASSAY = "name string, chrom string, bin_idx int, copynumber double, segmented double, calls int, uid string, loaded_at timestamp"
BINS = "chrom string, bin_idx int, chrom_rank int, start_pos long, end_pos long, gc double, mappability double, usable boolean, replication_timing double"


def write(spark, folder, signal, bins=12):
    """Tables of a few cells: ``signal`` has (name, chrom, [(copy number, reads), ..])."""
    when = datetime.datetime(2020, 1, 1)
    rows = [(name, chrom, i, c, c, y, "U1", when) for name, chrom, xs in signal for i, (c, y) in enumerate(xs)]
    chroms = sorted({x[1] for x in signal})
    spark.createDataFrame(rows, ASSAY).write.parquet(f"{folder}/assaydata.parquet")
    spark.createDataFrame([(c, i, k + 1, i * 1000, i * 1000 + 999, 0.4, 0.9, True, 0.5) for k, c in enumerate(chroms) for i in range(bins)], BINS).write.parquet(f"{folder}/bins.parquet")
    return str(folder)


SIGNAL = [
    ("a", "1", [(1.0, 40), (2.0, 90), (2.0, 131), (3.0, 150), (3.0, 171), (3.0, 120), (4.0, 7), (4.0, 7), (0.0, 0), (1.0, 0), (1.0, 9)]),
    ("a", "Y", [(1.0, 52)]),
    ("b", "1", [(2.0, 60), (2.0, 20), (2.0, 100), (2.0, 0), (5.0, 1)]),
]


def by_segment(signal):
    """Reads of each (name, chrom, number of the run of equal copy number)."""
    out = defaultdict(list)
    for name, chrom, xs in signal:
        seg, before = 0, None
        for c, y in xs:
            seg += c != before
            before = c
            out[name, chrom, seg].append(y)
    return out


def estimate(y, corrected):
    if max(y) == 0:
        return 1.0
    l, m = len(y), sum(y) / len(y)
    s = max((sum(v * v for v in y) / l - m * m) * l / (l - 1), 0) if l > 1 else 0
    s = s or 1e-10
    below = m * m - (s / l if corrected else 0)
    if s > m and below == 0:
        return None
    c = (s - m) / below if s > m else -math.inf
    return c if s > m and c > -1 / max(y) else -1 / max(y) + 1e-8


def nb_cost(y, c, m=None, floor=-math.inf):
    if sum(y) == 0:
        return 0.0
    if c is None:
        return None
    m = m or sum(y) / len(y)
    ll = sum(v * math.log(m) - (v + 1 / c) * math.log1p(max(c * m, floor)) + sum(math.log1p(max(c * j, floor)) for j in range(v)) - math.lgamma(v + 1) for v in y)
    return -ll


@pytest.mark.parametrize("name", ["nb_cost_mm", "nb_cost_bcmm"])
def test_costs_of_segments_of_any_length(spark, tmp_path, name):
    got = {(r["name"], r["chrom"], r["seg_id"]): r["cost"] for r in kernels.QUERIES[name](spark, write(spark, tmp_path, SIGNAL)).collect()}
    segments = by_segment(SIGNAL)
    assert {len(y) for y in segments.values()} >= {1, 2, 3} and got.keys() == segments.keys()
    for k, y in segments.items():
        want = nb_cost(y, estimate(y, name == "nb_cost_bcmm"), floor=-math.inf if name == "nb_cost_mm" else -1 + 1e-6)
        assert got[k] == (want if want is None else pytest.approx(want, abs=0.02)), (k, y)


def test_costs_at_a_given_dispersion_of_segments_of_any_length(spark, tmp_path):
    d = write(spark, tmp_path, SIGNAL)
    for name in ("nb_cost_alpha", "nb_cost_grid"):
        assert {(r["name"], r["chrom"], r["seg_id"]) for r in kernels.QUERIES[name](spark, d).where("cost is not null").collect()} == by_segment(SIGNAL).keys()


def test_events_of_state_zero_are_tested(spark, tmp_path):
    cell = [("a", "1", [(2.0, 20), (2.0, 18), (2.0, 22), (2.0, 20), (2.0, 21), (0.0, 1), (0.0, 0), (3.0, 31), (3.0, 29), (0.0, 0), (0.0, 0), (2.0, 20)])]
    got = {r["seg_id"]: (r["state"], r["p"]) for r in kernels.event_p_values(spark, write(spark, tmp_path, cell)).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: 0.0, 3: 3.0, 4: 0.0}
    assert got[2][1] == 1 / 10_001 and got[4][1] == 1e-16 and 1 / 10_001 < got[3][1] < 0.05


def test_p_values_of_events_against_exact_sums():
    mean_in, mean_out, alpha = 9.0, 6.0, 0.02
    at = np.arange(120.0)
    prob = np.exp(states.nb_log(at, np.full(120, mean_out), np.full(120, alpha)))
    y = [np.array([11.0]), np.array([8.0, 12.0]), np.zeros(3), np.full(21, 6.0)]
    p = states.event_p_values([(v, mean_in) for v in y], mean_out, alpha, 5)
    ratio = states.nb_log(at, np.full(120, mean_out), np.full(120, alpha)) - states.nb_log(at, np.full(120, mean_in), np.full(120, alpha))
    assert p[0] == pytest.approx(prob[ratio <= ratio[11] + 1e-9].sum(), abs=0.01)
    two = ratio[:, None] + ratio[None, :]
    assert p[1] == pytest.approx((prob[:, None] * prob[None, :])[two <= ratio[8] + ratio[12] + 1e-9].sum(), abs=0.01)
    assert p[2] == 1e-16 and p[3] == 1 / 10_001
    assert states.event_p_values([(np.zeros(3), mean_in)], 0.3, alpha, 5, zero_out=True) == [1 - 1e-16]
