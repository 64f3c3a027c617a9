"""Hidden states along a series: negative-binomial emissions, Viterbi path, posterior, fit, event p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seriesloom.util import map_series, spread_by


def log_gamma(y: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function."""
    return np.array([math.lgamma(v) for v in np.ravel(y)]).reshape(np.shape(y))


def nb_log(y: np.ndarray, mean: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Log-probability with variance mean + alpha mean^2."""
    r = 1 / np.maximum(alpha, 1e-9)
    mean = np.maximum(mean, 1e-9)
    return log_gamma(y + r) - log_gamma(r + 0 * y) - log_gamma(y + 1.0) + r * np.log(r / (r + mean)) + y * np.log(mean / (r + mean))


def emissions(y: np.ndarray, states: int, rpc: float, rpc0: float, alpha: float, alpha0: float) -> np.ndarray:
    """(points, states) log-probabilities: state 0 has mean rpc0, state k has k rpc."""
    k = y.astype(int)
    out = np.empty((len(y), states))
    for first, past, a in ((0, 1, alpha0), (1, states, alpha)):
        r = 1 / max(a, 1e-9)
        rising = np.r_[0.0, np.cumsum(np.log1p(np.arange(k.max() + 1) / r) - np.log(np.arange(1, k.max() + 2)))][k]
        mean = np.maximum(np.array([rpc0]) if first == 0 else rpc * np.arange(first, past), 1e-9)
        out[:, first:past] = rising[:, None] + y[:, None] * np.log(mean)[None, :] - (y[:, None] + r) * np.log1p(mean / r)[None, :]
    return out


def steps(n: int, states: int, change: float, borders: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """(n - 1, states, states) log transition matrices: a state is kept with 1 - p and left for each other with p / (states - 1); p is
    ``change``, or ``own`` for each step, and one half where a new part begins."""
    p = np.full(n - 1, change) if own is None else np.asarray(own, float)
    p = np.where(borders, 0.5, np.clip(p, 1e-12, 1 - 1e-12))
    out = np.broadcast_to((p / (states - 1))[:, None, None], (n - 1, states, states)).copy()
    i = np.arange(states)
    out[:, i, i] = (1 - p)[:, None]
    return np.log(out)


def viterbi(log_p: np.ndarray, log_a: np.ndarray) -> np.ndarray:
    """Most probable path from a uniform start; of equally probable predecessors the lowest state."""
    n, k = log_p.shape
    score = log_p[0] - math.log(k)
    back = np.zeros((n, k), int)
    for t in range(1, n):
        m = score[:, None] + log_a[t - 1]
        back[t] = m.argmax(0)
        score = m.max(0) + log_p[t]
    path = np.zeros(n, int)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posterior(log_p: np.ndarray, log_a: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each state at each point, and the log-likelihood."""
    n, k = log_p.shape
    f, b = np.empty((n, k)), np.zeros((n, k))
    f[0] = log_p[0] - math.log(k)
    for t in range(1, n):
        f[t] = _lse(f[t - 1][:, None] + log_a[t - 1], 0) + log_p[t]
    for t in range(n - 2, -1, -1):
        b[t] = _lse(log_a[t] + (log_p[t + 1] + b[t + 1])[None, :], 1)
    total = float(_lse(f[-1], 0))
    return np.exp(f + b - total), total


def log_likelihood(log_p: np.ndarray, log_a: np.ndarray) -> float:
    """Log-likelihood alone, by scaled forward sums."""
    p, a = np.exp(log_p - log_p.max(1, keepdims=True)), np.exp(log_a)
    f = p[0] / p.shape[1]
    total = float(log_p.max(1).sum())
    for t in range(1, len(p)):
        s = f.sum()
        total += math.log(max(s, 1e-300))
        f = ((f / max(s, 1e-300)) @ a[t - 1]) * p[t]
    return total + math.log(max(f.sum(), 1e-300))


def log_likelihoods(log_p: np.ndarray, log_a: np.ndarray) -> np.ndarray:
    """Log-likelihoods of several sets of emissions (sets, points, states) under the same transitions, in one pass of scaled forward sums."""
    top = log_p.max(2, keepdims=True)
    p, a = np.exp(log_p - top), np.exp(log_a)
    total = top[:, :, 0].sum(1)
    f = p[:, 0] / p.shape[2]
    for t in range(1, p.shape[1]):
        s = np.maximum(f.sum(1), 1e-300)
        total += np.log(s)
        f = ((f / s[:, None]) @ a[t - 1]) * p[:, t]
    return total + np.log(np.maximum(f.sum(1), 1e-300))


def width_of(rpc: float) -> float:
    """How far a fit may move rpc: fixed bounds of 5, 10 and 25 per cent."""
    return 0.05 if rpc < 5 else 0.10 if rpc < 10 else 0.25


#: Relative gain below which a fit has settled, and the share of a parameter's range that its steps must have come down to.
GAIN, FINEST = 1e-5, 1e-3


def fit(y: np.ndarray, borders: np.ndarray, states: int, rpc: float, change: float = 0.01, most: int = 60) -> tuple[float, float, float, float, float]:
    """MAP values (rpc, rpc0, alpha, alpha0, log posterior) by coordinate search; rpc stays within :func:`width_of`, rpc0 below a fifth of rpc.

    A round tries steps either way for each parameter (dispersions and rpc0 in their logarithm). A parameter's step grows when it helps and halves when it doesn't; the search ends when steps are below ``FINEST`` of the ranges
    and a round gains less than ``GAIN`` relative.
    """
    log_a = steps(len(y), states, change, borders)
    lo = np.array([rpc * (1 - width_of(rpc)), math.log(min(1e-3, 0.1 * rpc)), math.log(1e-4), math.log(1e-4)])
    hi = np.array([rpc * (1 + width_of(rpc)), math.log(0.2 * rpc), math.log(0.5), math.log(0.5)])

    def values(vs: list[np.ndarray]) -> np.ndarray:
        e, prior = [], []
        for v in vs:
            r, r0, a, a0 = v[0], *np.exp(v[1:])
            e.append(emissions(y, states, r, r0, a, a0))
            prior.append(-0.5 * ((r - rpc) / (0.15 * rpc)) ** 2 - r0 - math.sqrt(a) - math.sqrt(a0))
        return log_likelihoods(np.stack(e), log_a) + np.array(prior)

    best = np.clip(np.array([rpc, math.log(0.05 * rpc), math.log(0.02), math.log(0.02)]), lo, hi)
    step = (hi - lo) / 4
    top = float(values([best])[0])
    for _ in range(most):
        before = top
        for i in range(4):
            trial = []
            for g in (-1.0, -0.5, 0.5, 1.0):
                v = best.copy()
                v[i] = np.clip(best[i] + g * step[i], lo[i], hi[i])
                trial.append(v)
            s = values(trial)
            k = int(s.argmax())
            if s[k] > top:
                best, top = trial[k], float(s[k])
                step[i] *= 1.5 if k in (0, 3) else 1.0
            else:
                step[i] /= 3
        if (step < FINEST * (hi - lo)).all() and top - before <= GAIN * abs(top):
            break
    return (float(best[0]), *np.exp(best[1:]).tolist(), top)


def event_p_values(events: list[tuple[np.ndarray, float]], mean_out: float, alpha: float, seed: int, draws: int = 10_000, longest: int = 20, zero_out: bool = False) -> list[float]:
    """Monte-Carlo p-values of the events (values, inner mean) of one series: share of draws at the outer mean whose summed log-ratio favours
    the inner mean as much as the data do. Events longer than ``longest`` points get 1 / (draws + 1), shorter ones without any reads nearly 0, or
    nearly 1 where the outer state is 0 (``zero_out``). All events share the draws, an event of n points the first n of each."""
    sim, sums, out = None, {}, []
    one = lambda z, m: nb_log(z, np.full(z.shape, m), np.full(z.shape, alpha))
    for y, mean_in in events:
        n = len(y)
        if n > longest:
            out.append(1 / (draws + 1))
            continue
        if not np.any(y):
            out.append(1 - 1e-16 if zero_out else 1e-16)
            continue
        if sim is None:
            rng, r = np.random.default_rng(seed), 1 / max(alpha, 1e-6)
            sim = rng.poisson(rng.gamma(r, mean_out / r, (longest, draws)))
            levels = np.arange(int(max(sim.max(), *(e.max() for e, _ in events))) + 1, dtype=float)
            outer = one(levels, mean_out)
        if (mean_in, n) not in sums:
            ratio = outer - one(levels, mean_in)
            sums[mean_in, n] = ratio, np.sort(ratio[sim[:n]].sum(0))
        ratio, drawn = sums[mean_in, n]
        out.append(float((1 + np.searchsorted(drawn, ratio[y.astype(int)].sum() + 1e-9, side="right")) / (1 + draws)))
    return out


def log_gamma_many(x: np.ndarray) -> np.ndarray:
    """:func:`log_gamma` for x > 0 without a call for each number: Stirling's series behind six factors."""
    z = x + 6
    f = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f / 1188)))) / z - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


class Many:
    """Many series in step, padded to the longest: :func:`fit`, then :func:`viterbi` and :func:`posterior`. A step beyond a series' end changes nothing."""

    def __init__(self, ys: list[np.ndarray], borders: list[np.ndarray], states: int, change: float) -> None:
        self.n, self.states = np.array([len(y) for y in ys]), states
        size = int(self.n.max())
        self.y, self.p, self.inside = np.zeros((len(ys), size)), np.zeros((len(ys), size - 1)), np.arange(size) < self.n[:, None]
        for i, (y, b) in enumerate(zip(ys, borders, strict=True)):
            self.y[i, : len(y)], self.p[i, : len(b)] = y, np.where(b, 0.5, change)
        self.factorial = log_gamma_many(self.y + 1)

    def part(self, at: np.ndarray, mean: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """(series, sets, points, states) log-probabilities at means (series, sets, states) and dispersions (series, sets); 0 beyond the end."""
        y, r = self.y[at][:, None, :], 1 / np.maximum(alpha, 1e-9)[:, :, None]
        mean = np.maximum(mean, 1e-9)
        rise = log_gamma_many(y + r) - log_gamma_many(r) - y * np.log(r) - self.factorial[at][:, None, :]
        out = rise[..., None] + y[..., None] * np.log(mean)[:, :, None, :] - (y + r)[..., None] * np.log1p(mean / r)[:, :, None, :]
        out *= self.inside[at][:, None, :, None]
        return out

    def parts(self, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of state 0 and of the others at (series, sets, 4) values."""
        return self.part(at, np.exp(v[..., 1:2]), np.exp(v[..., 3])), self.part(at, v[..., :1] * np.arange(1, self.states), np.exp(v[..., 2]))

    def likelihoods(self, at: np.ndarray, zero: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log-likelihoods of (series, sets)."""
        sets = max(zero.shape[1], rest.shape[1])
        top = np.maximum(zero[..., 0], rest.max(3))
        e = np.empty((top.shape[2], len(at), sets, self.states))
        e[..., :1], e[..., 1:] = np.moveaxis(np.exp(zero - top[..., None]), 2, 0), np.moveaxis(np.exp(rest - top[..., None]), 2, 0)
        total = top.sum(2)
        p = self.p[at].T[:, :, None, None]
        q = p / (self.states - 1)
        keep = 1 - p - q
        f = e[0] / self.states
        for t in range(1, len(e)):
            s = np.maximum(f.sum(2, keepdims=True), 1e-300)
            total += np.log(s[..., 0])
            f *= keep[t - 1] / s
            f += q[t - 1]
            f *= e[t]
        return total + np.log(np.maximum(f.sum(2), 1e-300))

    def fit(self, rpc: np.ndarray, most: int = 60) -> np.ndarray:
        """(series, 5) what :func:`fit` gives for each."""
        width = np.array([width_of(r) for r in rpc])
        fixed = lambda x: np.full(len(rpc), math.log(x))
        lo = np.stack([rpc * (1 - width), np.log(np.minimum(1e-3, 0.1 * rpc)), fixed(1e-4), fixed(1e-4)], 1)
        hi = np.stack([rpc * (1 + width), np.log(0.2 * rpc), fixed(0.5), fixed(0.5)], 1)
        best = np.clip(np.stack([rpc, np.log(0.05 * rpc), fixed(0.02), fixed(0.02)], 1), lo, hi)
        step, at = (hi - lo) / 4, np.arange(len(rpc))
        prior = lambda v, k: -0.5 * ((v[..., 0] - rpc[k, None]) / (0.15 * rpc[k, None])) ** 2 - np.exp(v[..., 1]) - np.exp(0.5 * v[..., 2]) - np.exp(0.5 * v[..., 3])
        zero, rest = self.parts(at, best[:, None])
        top = (self.likelihoods(at, zero, rest) + prior(best[:, None], at))[:, 0]
        for _ in range(most):
            before = top.copy()
            for i in range(4):
                v = np.repeat(best[at][:, None], 4, 1)
                v[:, :, i] = np.clip(v[:, :, i] + np.array([-1.0, -0.5, 0.5, 1.0]) * step[at, None, i], lo[at, None, i], hi[at, None, i])
                own = i in (1, 3)  # which part the value belongs to
                new = self.part(at, np.exp(v[..., 1:2]), np.exp(v[..., 3])) if own else self.part(at, v[..., :1] * np.arange(1, self.states), np.exp(v[..., 2]))
                s = self.likelihoods(at, new if own else zero, rest if own else new) + prior(v, at)
                k = s.argmax(1)
                value = s[np.arange(len(at)), k]
                up = value > top[at]
                best[at[up]], top[at[up]] = v[up, k[up]], value[up]
                (zero if own else rest)[up, 0] = new[up, k[up]]
                step[at, i] *= np.where(up, np.where((k == 0) | (k == 3), 1.5, 1.0), 1 / 3)
            go = ~((step[at] < FINEST * (hi - lo)[at]).all(1) & (top[at] - before[at] <= GAIN * np.abs(top[at])))
            at, zero, rest = at[go], zero[go], rest[go]
            if not len(at):
                break
        return np.column_stack([best[:, 0], np.exp(best[:, 1:]), top])

    def decoded(self, best: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Most probable path of each series and the posterior probability of its states."""
        b, size = self.y.shape
        at, rows, k = np.arange(b), np.arange(b), self.states
        log_p = np.concatenate(self.parts(at, np.column_stack([best[:, 0], np.log(best[:, 1:4])])[:, None]), 3)[:, 0]
        inside = self.p > 0
        p = np.where(inside, self.p, 0.5)
        same, other = np.log(1 - p), np.log(p / (k - 1))
        score, back = log_p[:, 0] - math.log(k), np.zeros((b, size, k), np.int8)
        for t in range(1, size):
            m = np.repeat((score[:, :, None] + other[:, t - 1, None, None]), k, 2)
            m[:, np.arange(k), np.arange(k)] = score + same[:, t - 1, None]
            go = inside[:, t - 1, None]
            back[:, t] = np.where(go, m.argmax(1), np.arange(k))
            score = np.where(go, m.max(1) + log_p[:, t], score)
        path = np.zeros((b, size), np.int64)
        path[:, -1] = score.argmax(1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = back[rows, t, path[:, t]]
        e = np.exp(log_p - log_p.max(2, keepdims=True))
        q = self.p / (k - 1)
        f, g = np.empty((b, size, k)), np.ones((b, size, k))
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, size):
            x = (f[:, t - 1] * (1 - self.p - q)[:, t - 1, None] + q[:, t - 1, None]) * e[:, t]
            f[:, t] = x / x.sum(1, keepdims=True)
        for t in range(size - 2, -1, -1):
            x = e[:, t + 1] * g[:, t + 1]
            x = x * (1 - self.p - q)[:, t, None] + q[:, t, None] * x.sum(1, keepdims=True)
            g[:, t] = x / x.sum(1, keepdims=True)
        w = f * g
        prob = np.take_along_axis(w / w.sum(2, keepdims=True), path[:, :, None], 2)[:, :, 0]
        return [(path[i, :n], prob[i, :n]) for i, n in enumerate(self.n)]


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int = 5000) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones(len(a)), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out, h, at = d.copy(), d.copy(), np.arange(len(a))
    for m in range(1, most):
        for k in ((m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        go = np.abs(c * d - 1) > 1e-14
        if not go.all():
            out[at] = h
            at, a, b, x, c, d, h = (v[go] for v in (at, a, b, x, c, d, h))
            if not len(at):
                return out
    out[at] = h
    return out


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for a, b > 0 and 0 < x < 1."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    f = _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)) * front / np.where(low, a, b)
    return np.clip(np.where(low, f, 1 - f), 0, 1)


def event_probabilities(n: np.ndarray, total: np.ndarray, mean_in: np.ndarray, mean_out: np.ndarray, alpha: float, draws: int = 10_000, longest: int = 20) -> np.ndarray:
    """What :func:`event_p_values` estimates, without draws, for many events given by their points and summed reads, at the resolution of so many draws.

    With one dispersion the summed log-ratio is linear in the summed reads, and the sum of n negative-binomial counts is negative binomial with n times the size and mean: so the share of draws
    that favour the inner mean as much is a tail of that distribution, on the side on which the inner mean lies.
    """
    n, total, mean_in, mean_out = (np.asarray(v, float) for v in (n, total, mean_in, mean_out))
    r = 1 / max(alpha, 1e-6)
    mean_in, mean_out = np.maximum(mean_in, 1e-9), np.maximum(mean_out, 1e-9)
    out = np.full(len(n), 1 / (draws + 1))
    none = (n <= longest) & (total == 0)
    out[none] = 1e-16
    at = np.flatnonzero((n <= longest) & ~none)
    below = mean_in[at] < mean_out[at]
    share = beta_share(np.where(below, n[at] * r, total[at]), np.where(below, total[at] + 1, n[at] * r), np.where(below, r, mean_out[at]) / (r + mean_out[at]))
    out[at] = (1 + np.rint(draws * np.where(mean_in[at] == mean_out[at], 1.0, share))) / (1 + draws)
    return out


def copy_states(df: DataFrame, series: str, part: str, order: list[str], value: str, level: str, states: int = 9, change: float = 0.01, dealt: bool = False) -> DataFrame:
    """Most probable copy state of each point: series, part, position, state, p_state, rpc.

    The reads per copy start at the median of value / round(level) and are fitted with the dispersions for each series as a whole; a new part
    (chromosome) may start in any state. Points with null value are left out; series with fewer than 10 points get no rows.
    """
    at = order[-1]
    kinds = {c: df.schema[c].dataType.simpleString() for c in (series, part, at)}

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        values, levels, parts = rows[value].to_numpy(float, na_value=np.nan), rows[level].to_numpy(float, na_value=np.nan), rows[part].to_numpy()
        known, places, rpcs = ~np.isnan(values) & ~np.isnan(levels), [], []
        for s, e in zip(first, [*first[1:], len(rows)], strict=True):
            p = s + np.flatnonzero(known[s:e])
            y, lv = values[p], np.round(levels[p])
            ok = lv > 0
            if len(y) >= 10 and ok.any() and (r := float(np.median(y[ok] / lv[ok]))) > 0:
                places.append(p)
                rpcs.append(r)
        paths, probs, fitted = [None] * len(places), [None] * len(places), np.zeros(len(places))
        left = sorted(range(len(places)), key=lambda i: len(places[i]))
        while left:
            most = max(1, 300_000 // (4 * states * len(places[left[-1]])))
            own, left = left[-most:], left[:-most]
            series_ = Many([values[places[i]] for i in own], [parts[places[i]][1:] != parts[places[i]][:-1] for i in own], states, change)
            best = series_.fit(np.array([rpcs[i] for i in own]))
            for i, b, (path, prob) in zip(own, best, series_.decoded(best), strict=True):
                paths[i], probs[i], fitted[i] = path, prob, b[0]
        if not places:
            return pd.DataFrame()
        at_all = np.concatenate(places)
        return pd.DataFrame({c: rows[c].iloc[at_all].tolist() for c in (series, part, at)} | {"state": np.concatenate(paths), "p_state": np.concatenate(probs), "rpc": np.repeat(fitted, [len(p) for p in places])})

    cols = df.select(*dict.fromkeys([series, part, *order, value, level]))
    return map_series(cols, [series], order, run, f"{series} {kinds[series]}, {part} {kinds[part]}, {at} {kinds[at]}, state int, p_state double, rpc double", dealt)


def redecode(df: DataFrame, series: str, part: str, order: list[str], value: str, rpc: str, change: str, states: int = 9, alpha: float = 0.02) -> DataFrame:
    """Most probable path with a change probability of its own for every step (column ``change``, of the point stepped to; null is 0.01) and known parameters.

    Series whose ``rpc`` is null or not positive, or with fewer than 2 points, give no rows.
    """
    at = order[-1]
    kinds = {c: df.schema[c].dataType.simpleString() for c in (series, part, at)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=[value, rpc]).sort_values(order)
        if len(p) < 2 or float(p[rpc].iloc[0]) <= 0:
            return pd.DataFrame(columns=[series, part, at, "state"], dtype=object)
        y, r = p[value].to_numpy(float), float(p[rpc].iloc[0])
        borders = p[part].to_numpy()[1:] != p[part].to_numpy()[:-1]
        own = p[change].astype(float).fillna(0.01).to_numpy()[1:]
        path = viterbi(emissions(y, states, r, 0.05 * r, alpha, alpha), steps(len(y), states, 0.01, borders, own))
        return pd.DataFrame({series: p[series].tolist(), part: p[part].tolist(), at: p[at].tolist(), "state": path})

    cols = df.select(*dict.fromkeys([series, part, *order, value, rpc, change]))
    return spread_by(cols, [series]).groupBy(series).applyInPandas(run, f"{series} {kinds[series]}, {part} {kinds[part]}, {at} {kinds[at]}, state int")
