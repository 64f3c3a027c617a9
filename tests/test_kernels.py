"""Changepoints, states and scales against exhaustive search and simulated truth."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest

from seriesloom import util
from seriesloom.operators import changepoint as C
from seriesloom.operators import costs, fits, scaling, states


def best_by_force(n, cost, beta, least=2):
    f, last = [0.0 if t == 0 else math.inf for t in range(n + 1)], [0] * (n + 1)
    f[0] = -beta
    for t in range(least, n + 1):
        for s in range(0, t - least + 1):
            if f[s] < math.inf and (v := f[s] + cost(np.array([s]), t)[0] + beta) < f[t] - 1e-12:
                f[t], last[t] = v, s
    return f[n]


@pytest.mark.parametrize("kind", ["normal", "poisson", "nb_alpha", "nb_grid"])
def test_pelt_finds_the_optimum(kind):
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = int(rng.integers(4, 50))
        y = rng.poisson(np.repeat(rng.choice([5, 20, 60], 5), 10)[:n]).astype(float)
        cost = C.cost_function(y, kind, alpha=0.02, rpc=5.0)
        beta = costs.penalty("BIC", n, 2)
        ends = C.pelt(n, cost, beta)
        value = sum(cost(np.array([s]), e)[0] + beta for s, e in zip([0, *ends[:-1]], ends, strict=True)) - beta
        assert value == pytest.approx(best_by_force(n, cost, beta), abs=1e-6)
        assert ends[-1] == n and all(b - a >= 2 for a, b in zip([0, *ends[:-1]], ends, strict=True))


def test_pelt_short_series():
    for n in range(5):
        y = np.zeros(n)
        for kind in ("normal", "poisson", "nb_mm", "nb_bcmm"):
            ends = C.pelt(n, C.cost_function(y, kind), 3.0) if n else C.pelt(0, None, 3.0)
            assert (ends[-1] if n else ends) == (n if n else [])


def test_segments_without_a_corrected_dispersion_are_no_way():
    for y in ([0, 5, 7, 9, 8, 7], [0, 5, 7, 9, 30, 28, 0, 0, 0, 9, 0, 0], [0, 9, 0, 0, 0, 0, 0, 8]):
        y = np.array(y, float)
        cost = C.cost_function(y, "nb_bcmm", mbic=True)
        ends = C.pelt(len(y), cost, 2.0)
        assert cost(np.array([0]), 2)[0] == np.inf and ends[-1] == len(y)
        assert np.isfinite([cost(np.array([s]), e)[0] for s, e in zip([0, *ends[:-1]], ends, strict=True)]).all()
    assert C.pelt(4, C.cost_function(np.array([0.0, 9, 0, 0]), "nb_bcmm"), 2.0) == [4]


@pytest.mark.parametrize("kind", ["normal", "poisson", "nb_mm", "nb_bcmm", "nb_alpha", "nb_grid", "normal_mean", "np"])
def test_costs_of_all_segments_and_solutions_in_step_equal_those_one_by_one(kind):
    rng = np.random.default_rng(17)
    ys = [rng.poisson(np.repeat(rng.choice([0, 0.3, 4, 60, 900], 5), 9)[: int(rng.integers(4, 45))]).astype(float) for _ in range(6)] + [np.zeros(6), np.full(9, 40.0)]
    size = max(map(len, ys)) + 1
    many = np.full((len(ys), size, size), np.inf)
    for k, y in enumerate(ys):
        many[k, : len(y) + 1, : len(y) + 1] = own = C.pair_costs(y, kind)
        cost = C.cost_function(y, kind)
        for t in range(2, len(y) + 1):
            assert own[t, : t - 1] == pytest.approx(cost(np.arange(t - 1), t), rel=1e-9, abs=1e-7)
    n, beta = np.array([len(y) for y in ys]), np.array([5.0 + len(y) / 9 for y in ys])
    assert C.pelt_many(many, n, beta) == [C.pelt(len(y), C.cost_function(y, kind), b) for y, b in zip(ys, beta, strict=True)]
    assert C.crops_many(many, n, beta / 2, beta) == [C.crops(len(y), C.cost_function(y, kind), b / 2, b) for y, b in zip(ys, beta, strict=True)]


@pytest.mark.parametrize("kind", ["nb_mm", "nb_bcmm"])
def test_costs_of_all_segments_hold_no_row_of_terms_for_each(kind):
    y = np.random.default_rng(2).negative_binomial(20, 0.1, 120).astype(float)
    C.pair_costs(y, kind)  # builds the tables of the worker
    tracemalloc.start()
    own = C.pair_costs(y, kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * 8 * len(y) * (len(y) + 1) / 2
    cost = C.cost_function(y, kind)
    assert all(own[t, : t - 1] == pytest.approx(cost(np.arange(t - 1), t), rel=1e-9, abs=1e-7) for t in (2, 50, 120))


def test_series_across_batches_stay_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(None if k == 3 else f"s{k}", i) for k, n in enumerate((1, 30, 6, 8, 7, 1, 1, 15)) for i in range(n)], "s string, i int")
        run = lambda x, at: x.iloc[at].assign(i=np.diff([*at, len(x)]))
        got = util.map_series(df, ["s"], ["i"], run, "s string, i int").collect()
        assert sorted((r.s or "", r.i) for r in got) == sorted((("" if k == 3 else f"s{k}"), n) for k, n in enumerate((1, 30, 6, 8, 7, 1, 1, 15)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_crops_contains_the_single_solutions():
    rng = np.random.default_rng(5)
    y = rng.poisson(np.repeat([5, 30, 12, 50], 15)).astype(float)
    cost = C.cost_function(y, "poisson")
    found = C.crops(len(y), cost, 2.0, 30.0)
    for beta in (2.0, 5.0, 11.0, 30.0):
        ends = C.pelt(len(y), cost, beta)
        assert found[len(ends) - 1] == ends


def test_viterbi_and_posterior_by_enumeration():
    rng = np.random.default_rng(1)
    log_p, log_a = np.log(rng.random((5, 3))), states.steps(5, 3, 0.2, np.array([False, True, False, False]))
    paths = list(itertools.product(range(3), repeat=5))
    score = [log_p[0, p[0]] - math.log(3) + sum(log_a[t, p[t], p[t + 1]] + log_p[t + 1, p[t + 1]] for t in range(4)) for p in paths]
    assert tuple(states.viterbi(log_p, log_a)) == paths[int(np.argmax(score))]
    prob, total = states.posterior(log_p, log_a)
    w = np.exp(score)
    assert total == pytest.approx(math.log(w.sum())) == pytest.approx(states.log_likelihood(log_p, log_a))
    assert prob[2, 1] == pytest.approx(sum(x for x, p in zip(w, paths, strict=True) if p[2] == 1) / w.sum())


def test_emissions_are_negative_binomial():
    y = np.array([0.0, 3, 17])
    e = states.emissions(y, 4, 6.0, 0.4, 0.05, 0.1)
    assert e[:, 2] == pytest.approx(states.nb_log(y, np.full(3, 12.0), np.full(3, 0.05)))
    assert e[:, 0] == pytest.approx(states.nb_log(y, np.full(3, 0.4), np.full(3, 0.1)))


def test_states_of_a_simulated_series_are_recovered(spark):
    rng = np.random.default_rng(2015)
    truth = np.repeat([1, 3, 4, 2, 4, 3, 5, 0], 40)
    mean = np.where(truth == 0, 0.3, 7.4 * truth)
    r = 1 / 0.02
    y = rng.poisson(rng.gamma(r, mean / r))
    rows = [("c", "1", i, int(v), int(t)) for i, (v, t) in enumerate(zip(y, truth, strict=True))]
    df = spark.createDataFrame(rows, "cell string, chrom string, pos int, reads int, level int")
    got = {x.pos: x for x in states.copy_states(df, "cell", "chrom", ["pos"], "reads", "level", 8).collect()}
    assert np.mean([got[i].state == t for i, t in enumerate(truth)]) > 0.95
    assert abs(got[0].rpc - 7.4) < 0.4


def test_segments_of_a_table_with_nulls(spark):
    rows = [("a", i, None if i % 7 == 0 else (5 if i < 30 else 50)) for i in range(60)] + [("b", 1, None), ("c", 1, 4)]
    df = spark.createDataFrame(rows, "cell string, pos int, y int")
    got = sorted((x.cell, x.first, x.last, x.level) for x in C.segment(df, ["cell"], ["pos"], "y", "poisson", "BIC").collect())
    assert got == [("a", 1, 29, 5.0), ("a", 30, 59, 50.0), ("c", 1, 1, 4.0)]


def test_mixture_finds_the_spacing_and_fits_recover_parameters():
    rng = np.random.default_rng(7)
    x = np.sort(np.concatenate([rng.normal(m, 0.08, 80) for m in (2, 4, 6)]))
    w, means, _, xi = scaling.tied_mixture(x, 10, starts=(1.0,))
    assert abs(xi - 1) < 0.05 and set(np.argsort(w)[-3:]) == {2, 4, 6}
    y = rng.poisson(rng.gamma(1 / 0.1, 30 * 0.1, 4000)).astype(float)
    assert abs(fits.dispersion_ml(y) - 0.1) < 0.02 and fits.dispersion_ml(rng.poisson(9, 500) * 0 + 4.0) == 0
    a = rng.random(200) * 10
    b = 2 + 3 * a
    b[:20] += 100
    got = fits.bisquare_line(a, b + rng.normal(0, 0.1, 200))
    assert abs(got[0] - 2) < 0.2 and abs(got[1] - 3) < 0.05
    assert scaling.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-8)


def test_errors_of_candidates_without_a_row_for_each_position_and_candidate(spark):
    rng = np.random.default_rng(4)
    pts = [(s, float(rng.choice([40, 61, 80])), float(rng.integers(20, 90))) for s in ("a", "b") for _ in range(31)] + [("a", None, 5.0), ("c", 9.0, 9.0)]
    cand = [(s, i, 20.0, 0.1, i, i / 20) for s in ("a", "b", "d") for i in (1, 2, 3)]
    df = scaling.score_candidates(spark.createDataFrame(pts, "s string, l double, v double"), spark.createDataFrame(cand, "s string, ordinal int, gap double, product double, k int, scale double"), "s", "l", "v", 1.1, 8, True)
    assert "MapInPandas" in df._jdf.queryExecution().toString()
    got = {(r.s, r.ordinal): r for r in df.collect()}
    assert got.keys() == {(s, i) for s in ("a", "b") for i in (1, 2, 3) if 1.1 <= np.rint(np.array([p[1] for p in pts if p[0] == s and p[1]]) * i / 20).mean() <= 8}
    for (s, i), r in got.items():
        lev, val = (np.array([p[c] for p in pts if p[0] == s and p[1] is not None]) for c in (1, 2))
        seg, every = np.abs(lev * i / 20 - np.rint(lev * i / 20)), np.abs(val * i / 20 - np.rint(lev * i / 20))
        want = (31, val.sum() / np.rint(lev * i / 20).sum(), seg.sum(), np.median(seg), seg.std(ddof=1), every.sum(), np.median(every), np.sqrt((every**2).sum()))
        assert (r.n_bins, r.rpc, r.error_seg_l1, r.error_seg_median, r.error_seg_sd, r.error_all_l1, r.error_all_median, r.error_all_l2) == pytest.approx(want)


def test_mixtures_in_step_equal_those_one_by_one():
    rng = np.random.default_rng(8)
    xs = [np.round(rng.normal(rng.choice([1, 2, 5, 9], int(n)), 0.1), 2) for n in rng.integers(1, 90, 12)] + [np.array([3.0]), np.full(40, 15.0)]
    for x, (w, m, v, xi) in zip(xs, scaling.tied_mixtures(xs), strict=True):
        for got, want in zip((w, m, v, xi), scaling.tied_mixture(x), strict=True):
            assert got == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_bias_correction_removes_the_covariate():
    rng = np.random.default_rng(9)
    gc = rng.random(600)
    effect = np.exp(1.2 * (gc - 0.5))
    base = np.repeat([10.0, 20.0, 30.0], 200)
    f = fits.smooth_factor(rng.poisson(base * effect).astype(float), base, [gc])
    assert np.corrcoef(np.log(f), np.log(effect))[0, 1] > 0.97


@pytest.mark.parametrize("kind", ["normal_mean", "np"])
def test_pelt_finds_the_optimum_of_mean_and_empirical_costs(kind):
    rng = np.random.default_rng(13)
    for _ in range(8):
        n = int(rng.integers(4, 45))
        y = np.round(rng.normal(np.repeat(rng.choice([5, 20, 60], 5), 10)[:n], 2))
        cost = C.cost_function(y, kind)
        beta = costs.penalty("BIC", n, 1)
        ends = C.pelt(n, cost, beta)
        value = sum(cost(np.array([s]), e)[0] + beta for s, e in zip([0, *ends[:-1]], ends, strict=True)) - beta
        assert value <= best_by_force(n, cost, beta) + (1e-6 if kind == "normal_mean" else beta)


def test_segments_that_do_not_differ_are_joined():
    rng = np.random.default_rng(2)
    y = np.r_[rng.normal(10, 1, 40), rng.normal(10, 1, 40), rng.normal(30, 1, 40)]
    assert C.merge_segments(y, [40, 80, 120]) == [80, 120]
    assert C.merge_segments(np.array([5.0, 5, 5, 9, 9]), [1, 3, 5]) == [3, 5]
    assert C.merge_segments(y[:10], [10]) == [10]


def test_counts_of_long_series_equal_direct_sums():
    rng = np.random.default_rng(4)
    whole = rng.poisson(np.repeat([3, 900, 40], 300)).astype(np.int64)
    t = C._Counts(whole)
    assert t.table.size <= (len(whole) // t.STRIDE + 1) * len(np.unique(whole))
    starts, end = np.array([0, 1, 127, 128, 500, 898]), 899
    c = np.array([0.02, 1e-9, 0.5, -1 / 2000, 0.1, 0.3])
    want = [sum(np.log1p(max(k, -1 + 1e-6) * 0 + k * np.arange(v)).sum() for v in whole[s:end]) for s, k in zip(starts, c, strict=True)]
    assert t.rising(starts, end, c, -1 + 1e-15) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_event_probabilities_are_what_the_draws_estimate():
    rng = np.random.default_rng(6)
    for mean_out in (0.8, 12.0, 240.0):
        events = [(rng.poisson(m, n).astype(float), m * 0.9 if m == mean_out else m) for n in (1, 2, 5, 20, 21) for m in (mean_out * 0.6, mean_out, mean_out * 1.7)] + [(np.zeros(3), mean_out * 2)]
        drawn = states.event_p_values(events, mean_out, 0.02, 3)
        y, m = [e[0] for e in events], np.array([e[1] for e in events])
        got = states.event_probabilities([len(v) for v in y], [v.sum() for v in y], m, np.full(len(y), mean_out), 0.02)
        assert got == pytest.approx(drawn, abs=0.02)
    at = np.arange(900.0)
    prob = np.exp(states.nb_log(at, np.full(900, 6.0), np.full(900, 0.02)))
    assert states.beta_share(50.0, np.array([4.0, 12.0, 200.0]), 50 / 56.0) == pytest.approx([prob[:4].sum(), prob[:12].sum(), 1.0], rel=1e-9)


def test_a_fit_of_states_is_no_worse_than_a_fine_grid():
    rng = np.random.default_rng(8)
    truth = np.repeat([2, 3, 4, 2, 0, 3], 25)
    mean = np.where(truth == 0, 0.4, 11.0 * truth)
    y = rng.poisson(rng.gamma(1 / 0.03, mean * 0.03)).astype(float)
    borders = np.zeros(len(y) - 1, bool)
    rpc, rpc0, a, a0, top = states.fit(y, borders, 7, 10.0)
    log_a = states.steps(len(y), 7, 0.01, borders)

    def value(r, r0, x, x0):
        return states.log_likelihood(states.emissions(y, 7, r, r0, x, x0), log_a) - 0.5 * ((r - 10.0) / 1.5) ** 2 - r0 - math.sqrt(x) - math.sqrt(x0)

    assert top == pytest.approx(value(rpc, rpc0, a, a0))
    grid = max(value(r, r0, x, x0) for r in np.linspace(7.5, 12.5, 41) for r0 in (1e-3, 0.1, 0.3, 0.5, 1.0) for x in (1e-4, 0.01, 0.02, 0.03, 0.05, 0.1) for x0 in (1e-4, 0.02, 0.2))
    assert top >= grid - 1e-4 * abs(grid)
    many = states.log_likelihoods(np.stack([states.emissions(y, 7, r, 0.3, 0.02, 0.02) for r in (9.0, 11.0)]), log_a)
    assert many == pytest.approx([states.log_likelihood(states.emissions(y, 7, r, 0.3, 0.02, 0.02), log_a) for r in (9.0, 11.0)])


def test_states_of_series_in_step_equal_those_one_by_one():
    rng = np.random.default_rng(21)
    ys, borders, rpcs = [], [], []
    for n in (10, 33, 60, 61, 120):
        truth = np.repeat(rng.choice([0, 1, 2, 3, 4], 12), 10)[:n]
        ys.append(rng.poisson(rng.gamma(50, np.where(truth == 0, 0.4, 11.0 * truth) / 50)).astype(float))
        borders.append(rng.random(n - 1) < 0.1)
        rpcs.append(float(rng.uniform(9, 12)))
    many = states.Many(ys, borders, 9, 0.01)
    fitted = many.fit(np.array(rpcs))
    for y, b, r, got, (path, prob) in zip(ys, borders, rpcs, fitted, many.decoded(fitted), strict=True):
        assert got[4] == pytest.approx(states.fit(y, b, 9, r)[4], abs=1e-3)
        log_p, log_a = states.emissions(y, 9, *got[:4]), states.steps(len(y), 9, 0.01, b)
        assert (path == states.viterbi(log_p, log_a)).all()
        assert prob == pytest.approx(states.posterior(log_p, log_a)[0][np.arange(len(y)), path], abs=1e-8)


def test_trends_and_their_partial_forms(spark):
    x = np.arange(30.0)
    assert fits.partial_mann_kendall(x, np.r_[x[15:], x[:15]]) > 5 and abs(fits.partial_mann_kendall(x, x)) < 1e-9
    z = np.random.default_rng(1).random(30)
    assert fits.partial_rank_correlation(x, z) == pytest.approx(1.0) and math.isnan(fits.partial_rank_correlation(x, x * 0))
    assert fits._scores(np.array([1.0, 3, 2]))[0] == 1
    assert fits.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05) and fits.chi_square_tail(30, 20) == pytest.approx(0.069853660699) and fits.chi_square_tail(0, 3) == 1
    rows = [("a", 1, float(i), 10 + i, 1 + (i % 3) / 10) for i in range(12)] + [("a", 2, float(i), 0, 1.0) for i in range(12)] + [("b", 1, None, 3, 1.0), ("a", 3, 1.0, 5, 1.0)]
    df = spark.createDataFrame(rows, "cell string, seg int, time double, reads int, factor double")
    got = {r.cell: r for r in fits.trend_summary(df, "cell", ["seg"], "time", "reads", 4, "factor").collect()}
    assert len(got["a"].asDict()) == 3 + 26 and got["a"].n_segments == 1 and got["a"].n_points == 12
    assert got["a"].tau_mean == 1 and got["a"].p_mean < 0.001 and got["a"].tau_partial_wmean > 3 and got["a"].rho_partial_wmedian == pytest.approx(1.0)
    assert got["b"].n_segments == 0 and got["b"].tau_mean is None
    assert len(fits.trend_summary(df, "cell", ["seg"], "time", "reads", 4).columns) == 3 + 12


def test_bias_model_tells_a_real_effect_from_none(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cell, strength in (("flat", 0.0), ("bent", 1.5)):
        for i in range(300):
            g = rng.random()
            rows.append((cell, i, int(rng.poisson(40 * np.exp(strength * (g - 0.5)))), 2.0, float(g)))
    rows += [("none", i, 0, 2.0, 0.5) for i in range(40)] + [("few", 1, 4, 2.0, 0.5), ("few", 2, None, 2.0, None)]
    df = spark.createDataFrame(rows, "cell string, pos int, reads int, level double, gc double")
    got = {r.cell: r for r in fits.bias_model(df, "cell", ["pos"], "reads", "level", ["gc"]).collect()}
    assert got["bent"].p_value < 1e-6 < got["flat"].p_value and got["bent"].dev_expl > 0.5 > got["flat"].dev_expl
    assert got["none"].alpha is None and got["few"].n == 1 and got["few"].deviance is None
