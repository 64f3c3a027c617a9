"""Penalised changepoint detection, one series to a group."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seriesloom.operators.costs import EDGE, LN2PI, LOG_FLOOR, SSQ_FLOOR, VAR_FLOOR, penalty
from seriesloom.operators.fits import dispersion_ml
from seriesloom.util import map_series, spread_by

Cost = Callable[[np.ndarray, int], np.ndarray]
MIN_SEGMENT = 2
#: Longest series of which the costs of all segments are kept.
SHORT = 400


class _Counts:
    """Numbers of each distinct value in any stretch of a series: a table of running numbers at every ``STRIDE``-th point, and the few points between.

    Its size is (points / STRIDE) x (distinct values), a few megabytes for long series with large values.
    """

    STRIDE = 128

    def __init__(self, whole: np.ndarray) -> None:
        self.values, self.code = np.unique(whole, return_inverse=True)
        n, d = len(whole), len(self.values)
        per = np.zeros((n // self.STRIDE + 1, d), np.int32)
        full = n // self.STRIDE * self.STRIDE
        np.add.at(per, (np.arange(full) // self.STRIDE + 1, self.code[:full]), 1)
        self.table = np.cumsum(per, axis=0, dtype=np.int32)

    def upto(self, at: np.ndarray) -> np.ndarray:
        """(places, distinct values) numbers among the points before each place."""
        block = at // self.STRIDE
        out = self.table[block].astype(np.int64)
        extra = at - block * self.STRIDE
        row = np.repeat(np.arange(len(at)), extra)
        point = np.repeat(block * self.STRIDE, extra) + (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra))
        np.add.at(out, (row, self.code[point]), 1)
        return out

    def rising(self, starts: np.ndarray, end: int, c: np.ndarray, floor: float) -> np.ndarray:
        """For each start the sum over the points up to ``end`` of sum_{j < value} log(1 + c j)."""
        out = np.empty(len(starts))
        last = self.upto(np.array([end]))
        for lo in range(0, len(starts), 256):  # bounds the working memory
            part = slice(lo, lo + 256)
            n = last - self.upto(starts[part])
            top = int(self.values[n.any(0)].max(initial=0))
            seen = self.values <= top
            steps = np.cumsum(np.log1p(np.maximum(c[part, None] * np.arange(top)[None, :], floor)), axis=1)
            sums = np.concatenate([np.zeros((len(steps), 1)), steps], axis=1)[:, self.values[seen]]
            out[part] = (n[:, seen] * sums).sum(1)
        return out


def _take(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``x[at]`` for places that exist, without a test of each."""
    return x.take(at, mode="clip")


class _Terms:
    """sum_{j < value} log(1 + c j) over the points of any stretch of a series and any c > 0, without a step for each j: Taylor polynomials in log c around fixed nodes, as running sums over the points.

    The polynomials' error is below 1e-10 of a sum (distance 1/4 at most from a node, nearest singularity at pi). Very small c take the power series in c, very large ones the series in 1 / c. Values
    below ``MOST`` only: the tables of a worker hold (values x nodes x terms) numbers.
    """

    STEP, TERMS, FIRST, LAST, MOST = 0.5, 10, math.log(1e-6), math.log(1e6), 8192
    _table = np.zeros((TERMS, 1, 1))

    @classmethod
    def table(cls, most: int) -> np.ndarray:
        """(terms, values, nodes) Taylor coefficients of the sums, for values up to ``most`` at least."""
        if cls._table.shape[1] <= most:
            size = 1024
            while size <= most:
                size *= 2
            u = np.arange(cls.FIRST, cls.LAST + cls.STEP, cls.STEP)
            each = np.zeros((cls.TERMS, size, len(u)))
            j = np.arange(1, size)[:, None]
            with np.errstate(divide="ignore"):
                q = 1 / (1 + np.exp(-(u[None, :] + np.log(j))))
            each[0, 1:] = np.log1p(j * np.exp(u)[None, :])
            poly = np.polynomial.Polynomial([0.0, 1.0])  # derivatives are polynomials in q, with q' = q - q^2
            for k in range(1, cls.TERMS):
                each[k, 1:] = poly(q) / math.factorial(k)
                poly = poly.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])
            cls._table = np.concatenate([np.zeros((cls.TERMS, 1, len(u))), np.cumsum(each, axis=1)[:, :-1]], axis=1)
        return cls._table

    def __init__(self, whole: np.ndarray) -> None:
        self.whole, self.top = whole, int(whole.max(initial=0))

    def rising(self, starts: np.ndarray, ends: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The sums of the stretches (start, end] at c > 0."""
        out = np.zeros(len(starts))
        small, large = c * self.top < 1e-2, c > math.exp(self.LAST)
        mid = np.flatnonzero(~(small | large))
        if len(mid):
            u = np.log(_take(c, mid))
            k = np.rint((u - self.FIRST) / self.STEP).astype(np.int64)
            np.maximum(k, 0, out=k)
            lo, hi = int(k.min()), int(k.max()) + 1
            g = np.zeros((self.TERMS, len(self.whole) + 1, hi - lo))
            np.cumsum(self.table(self.top)[:, self.whole, lo:hi], axis=1, out=g[:, 1:])
            g = g.reshape(self.TERMS, -1)  # each term's numbers are few enough for a core's nearest memory
            d = u - (self.FIRST + self.STEP * k)
            k -= lo
            to, since = _take(ends, mid) * (hi - lo) + k, _take(starts, mid) * (hi - lo) + k
            v = _take(g[-1], to) - _take(g[-1], since)
            for i in range(self.TERMS - 2, -1, -1):
                v *= d
                v += _take(g[i], to) - _take(g[i], since)
            out[mid] = v
        if small.any():
            v, cs = self.whole.astype(float), c[small]
            j = np.arange(max(self.top, 1), dtype=float)
            for p in range(1, 7):
                s = np.r_[0, np.cumsum(np.r_[0, np.cumsum(j**p)][self.whole])]
                out[small] -= (-cs) ** p / p * (s[ends[small]] - s[starts[small]])
        if large.any():
            v, cl = np.maximum(self.whole - 1, 0), c[large]
            j = np.arange(1, self.top + 1, dtype=float)
            for each, factor in ((v.astype(float), np.log(cl)), (np.r_[0, np.cumsum(np.log(j))][v], 1.0), (np.r_[0, np.cumsum(1 / j)][v], 1 / cl)):
                s = np.r_[0, np.cumsum(each)]
                out[large] += factor * (s[ends[large]] - s[starts[large]])
        return out

    def lowest(self, starts: np.ndarray, ends: np.ndarray, tops: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The sums at the smallest dispersion, -1 / y_max + EDGE, where y_max is ``tops[code]``."""
        used = np.zeros(len(tops), bool)
        used[code] = True
        most = tops[used].astype(np.int64)
        s = np.zeros((len(most), len(self.whole) + 1))
        parts = np.concatenate([_at_lowest(m) for m in most.tolist()])
        np.cumsum(_take(parts, np.minimum(self.whole, most[:, None]) + (np.cumsum(most + 1) - most - 1)[:, None]), axis=1, out=s[:, 1:])
        row = (np.cumsum(used) - 1)[code] * s.shape[1]
        return _take(s.ravel(), row + ends) - _take(s.ravel(), row + starts)


@lru_cache(4096)
def _at_lowest(top: int) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.log1p((-1 / top + EDGE) * np.arange(top)))]


@lru_cache(4)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, starts and lengths of all segments of n points."""
    ends, starts = np.tril_indices(n + 1, -1)
    return ends, starts, (ends - starts).astype(float)


def pair_costs(y: np.ndarray, kind: str, mbic: bool = False, alpha: float = 0.01, rpc: float = 1.0) -> np.ndarray:
    """(ends, starts) costs of all segments of y, as :func:`cost_function` has them, infinite where the end isn't behind the start; for short series."""
    n = len(y)
    ends, starts, _ = _pairs(n)
    out = np.full((n + 1, n + 1), np.inf)
    out.ravel()[ends * (n + 1) + starts] = _moment_costs(y, kind, mbic) if kind in ("nb_mm", "nb_bcmm") else cost_function(y, kind, mbic, alpha, rpc)(starts, ends)
    return out


def _moment_costs(y: np.ndarray, kind: str, mbic: bool) -> np.ndarray:
    """Costs of all segments of y in the order of :func:`_pairs` at nb_mm or nb_bcmm, by :class:`_Terms`."""
    n = len(y)
    ends, starts, l = _pairs(n)
    y = np.asarray(y, float)
    whole = y.astype(np.int64)
    stretch = lambda each: _take(s := np.concatenate([[0.0], np.cumsum(each)]), ends) - _take(s, starts)
    x, x2 = stretch(y), stretch(y * y)
    m = x / l
    ssq = (x2 / l - m * m) * (l / np.maximum(l - 1, 1e-12))
    np.copyto(ssq, SSQ_FLOOR, where=ssq <= 0)
    tops, code = np.unique(y, return_inverse=True)
    highest = np.maximum.accumulate(np.triu(np.broadcast_to(code, (n, n))), axis=1)
    code = _take(highest.ravel(), starts * n + (ends - 1))
    terms, none = _Terms(whole), x == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (ssq - m) / (m * m - (ssq / l if kind == "nb_bcmm" else 0))
        undefined = (x * x <= x2) & (x > 1) if kind == "nb_bcmm" else np.zeros(len(x), bool)  # all reads in one bin
        np.copyto(c, 0.0, where=undefined)
        low = _take(-1 / tops, code)
        edge = (c <= low) | (ssq <= m)
        np.copyto(c, low + EDGE, where=edge)
        rising = np.zeros(len(x))
        if len(at := np.flatnonzero(edge & ~none)):
            rising[at] = terms.lowest(_take(starts, at), _take(ends, at), tops, _take(code, at))
        if len(at := np.flatnonzero(~(edge | undefined | none))):
            rising[at] = terms.rising(_take(starts, at), _take(ends, at), _take(c, at))
        gamma = stretch(np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, terms.top + 1, dtype=float)))])[whole])
        out = -(x * np.log(m) - (x + l / c) * np.log1p(np.maximum(c * m, -1 + 1e-15 if kind == "nb_mm" else LOG_FLOOR)) + rising - gamma)
        np.copyto(out, np.inf, where=undefined)
        if mbic:
            out += np.log(l)
    np.copyto(out, 0.0, where=none)
    return out


def cost_function(y: np.ndarray, kind: str, mbic: bool = False, alpha: float = 0.01, rpc: float = 1.0) -> Cost:
    """``f(starts, end)``: costs of the segments (start, end] of y for an array of starts; end may be an array too, but for nb_mm and nb_bcmm.

    Kinds: normal, poisson, nb_mm (moments), nb_bcmm (bias-corrected), nb_alpha (fixed dispersion), nb_grid (means on multiples of rpc), normal_mean (changes of the mean alone, at one variance for the series, from
    the median absolute difference of neighbours), np (empirical distribution at about 4 log n quantiles of the series, dense in the tails). A segment with all its reads in one bin has no
    bias-corrected dispersion; its cost at nb_bcmm is infinite, the limit for that denominator.
    """
    y = np.asarray(y, float)
    s1, s2 = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(y * y)]
    if kind == "np":
        return _empirical_cost(y, mbic)
    noise = max(float(np.median(np.abs(np.diff(y)))) / (0.6744897501960817 * math.sqrt(2)), 1e-6) ** 2 if kind == "normal_mean" and len(y) > 1 else 1.0
    nb = kind.startswith("nb")
    whole = y.astype(np.int64) if nb else None
    levels = np.arange(int(whole.max()) if nb and len(y) else 0, dtype=float)
    gamma = np.r_[0, np.cumsum(np.r_[0, np.cumsum(np.log(levels + 1))][whole])] if nb else None
    fixed = np.r_[0, np.cumsum(np.r_[0, np.cumsum(np.log1p(np.maximum(alpha * levels, LOG_FLOOR)))][whole])] if kind in ("nb_alpha", "nb_grid") else None
    counts = _Counts(whole) if nb and fixed is None else None

    def run(starts: np.ndarray, end: int) -> np.ndarray:
        l, x = (end - starts).astype(float), s1[end] - s1[starts]
        if kind == "normal":
            out = l * (LN2PI + np.log(np.maximum((s2[end] - s2[starts] - x * x / l) / l, VAR_FLOOR)) + 1)
        elif kind == "normal_mean":
            out = np.maximum(s2[end] - s2[starts] - x * x / l, 0) / noise
        elif kind == "poisson":
            out = np.where(x == 0, 0.0, 2 * x * (np.log(l) - np.log(np.maximum(x, 1e-300))))
        else:
            m = x / l
            ssq = ((s2[end] - s2[starts]) / l - m * m) * (l / np.maximum(l - 1, 1e-12))
            ssq = np.where(ssq <= 0, SSQ_FLOOR, ssq)
            undefined = np.zeros(len(starts), bool)
            with np.errstate(divide="ignore", invalid="ignore"):
                if kind in ("nb_mm", "nb_bcmm"):
                    c = (ssq - m) / (m * m - (ssq / l if kind == "nb_bcmm" else 0))
                    undefined = (x * x <= s2[end] - s2[starts]) & (x > 1) if kind == "nb_bcmm" else undefined  # all reads in one bin
                    c = np.where(undefined, 0.0, c)
                    low = -1 / np.maximum.accumulate(np.maximum.reduceat(y[:end], starts)[::-1])[::-1]  # starts come in order
                    edge = (c <= low) | (ssq <= m)
                    c = np.where(edge, low + EDGE, c)
                else:
                    c = np.full(len(starts), alpha)
                if kind == "nb_grid":
                    near = np.clip(np.ceil(m / rpc - 0.5), 1, 50) * rpc
                    m = np.where(np.abs(near - m) < np.abs(0.5 - m), near, 0.5)
                floor = -1 + 1e-15 if kind == "nb_mm" else LOG_FLOOR
                if fixed is not None:
                    rising = fixed[end] - fixed[starts]
                else:
                    rising = counts.rising(starts, end, c, floor)
                ll = x * np.log(m) - (x + l / c) * np.log1p(np.maximum(c * m, floor)) + rising - (gamma[end] - gamma[starts])
            out = np.where(x == 0, 0.0, np.where(undefined, np.inf, -ll))
            if mbic:
                return np.where(x == 0, 0.0, out + np.log(l))
        return out + np.log(l) if mbic else out

    return run


def _empirical_cost(y: np.ndarray, mbic: bool) -> Cost:
    n = len(y)
    k = max(math.ceil(4 * math.log(max(n, 2))), 1)
    wide = math.log(max(2 * n - 1, 2))
    p = 1 / (1 + (2 * n - 1) * np.exp(-wide / k * (2 * np.arange(1, k + 1) - 1)))
    points = np.quantile(y, p) if n else np.zeros(k)
    below = np.r_[np.zeros((1, k), np.float32), np.cumsum((y[:, None] < points) + 0.5 * (y[:, None] == points), axis=0, dtype=np.float32)]

    def run(starts: np.ndarray, end: int) -> np.ndarray:
        l = (end - starts).astype(float)
        f = np.clip((below[end].astype(float) - below[starts]) / l[:, None], 0, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            h = np.where(f > 0, f * np.log(f), 0) + np.where(f < 1, (1 - f) * np.log1p(-f), 0)
        out = -2 * wide / k * l * h.sum(1)
        return out + np.log(l) if mbic else out

    return run


def merge_segments(y: np.ndarray, ends: list[int], alpha: float = 0.01) -> list[int]:
    """Ends after neighbouring segments were joined, the least different first, until all neighbours differ in mean at level ``alpha`` (two-sided normal test with their own variances; a
    segment of one point takes its neighbour's)."""
    parts = [(len(p), float(p.mean()), float(p.var(ddof=1)) if len(p) > 1 else -1.0, e) for p, e in zip(np.split(y, ends[:-1]), ends, strict=True)]

    def p_value(a: tuple, b: tuple) -> float:
        va, vb = (a[2] if a[2] >= 0 else b[2]), (b[2] if b[2] >= 0 else a[2])
        se = math.sqrt(max(va, 0) / a[0] + max(vb, 0) / b[0])
        return math.erfc(abs(a[1] - b[1]) / se / math.sqrt(2)) if se > 0 else float(a[1] == b[1])

    while len(parts) > 1:
        p = [p_value(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        i = int(np.argmax(p))
        if p[i] <= alpha:
            break
        (n, m, v, _), (k, o, u, e) = parts[i], parts[i + 1]
        both = n + k
        mean = (n * m + k * o) / both
        ss = max(v, 0) * (n - 1) + max(u, 0) * (k - 1) + n * (m - mean) ** 2 + k * (o - mean) ** 2
        parts[i : i + 2] = [(both, mean, ss / (both - 1), e)]
    return [q[3] for q in parts]


def state_cost(log_p: np.ndarray, mbic: bool = False) -> Cost:
    """Cost of a segment as minus the best state's summed log-probability; ``log_p`` has a row per point and a column per state."""
    s = np.r_[np.zeros((1, log_p.shape[1])), np.cumsum(log_p, axis=0)]
    return lambda starts, end: -(s[end] - s[starts]).max(1) + (np.log(end - starts) if mbic else 0)


def pelt(n: int, cost: Cost, beta: float, min_segment: int = MIN_SEGMENT) -> list[int]:
    """Ends of the optimal segments (the last is n): F(t) = min F(s) + C(s, t) + beta, with candidates dropped once F(s) + C(s, t) > F(t), not for an
    infinite cost, which further points may end. Without any finite way to n the points are one segment.

    Fewer than twice ``min_segment`` points are one segment; no points give none.
    """
    if n == 0:
        return []
    if n < 2 * min_segment:
        return [n]
    best = np.full(n + 1, np.inf)
    best[0] = -beta
    last = np.zeros(n + 1, int)
    open_ = np.array([0])
    for t in range(min_segment, n + 1):
        each = cost(open_, t)
        c = best[open_] + each
        k = int(np.argmin(c))
        best[t], last[t] = c[k] + beta, open_[k] if c[k] < np.inf else 0
        open_ = np.append(open_[(c <= best[t] + 1e-12) | np.isinf(each)], t - min_segment + 1)
        open_ = open_[(open_ == 0) | (open_ >= min_segment)]
    ends = []
    t = n
    while t > 0:
        ends.append(t)
        t = last[t]
    return ends[::-1]


def pelt_many(costs: np.ndarray, n: np.ndarray, beta: np.ndarray, min_segment: int = MIN_SEGMENT) -> list[list[int]]:
    """:func:`pelt` of many short series in step, from (series, ends, starts) costs."""
    b, most = len(n), int(n.max(initial=0))
    best, last = np.full((b, most + 1), np.inf), np.zeros((b, most + 1), np.int64)
    open_ = np.full((b, most + 1), np.inf)  # best where the start is open, else infinite
    best[:, 0] = open_[:, 0] = -beta
    rows = np.arange(b)
    endless = np.count_nonzero(np.isfinite(costs)) < int((n * (n + 1) // 2).sum())  # some segment has an infinite cost
    for t in range(min_segment, most + 1):
        each = costs[:, t, :t]
        c = open_[:, :t] + each
        k = c.argmin(1)
        least = c[rows, k]
        best[:, t], last[:, t] = least + beta, np.where(least < np.inf, k, 0)
        gone = c > best[:, t : t + 1] + 1e-12
        if endless:
            gone &= ~np.isinf(each)
        np.copyto(open_[:, :t], np.inf, where=gone)
        if (new := t - min_segment + 1) >= min_segment:
            open_[:, new] = best[:, new]
    out = []
    for i in range(b):
        ends, t = [], int(n[i])
        while t > 0:
            ends.append(t)
            t = int(last[i, t]) if n[i] >= 2 * min_segment else 0
        out.append(ends[::-1])
    return out


def remembered(n: int, cost: Cost, most: int = 2000) -> Cost:
    """The same cost, kept for all starts of an end once asked for; for series of up to ``most`` points that are solved several times."""
    if n > most:
        return cost
    rows: dict[int, np.ndarray] = {}

    def run(starts: np.ndarray, end: int) -> np.ndarray:
        if end not in rows:
            rows[end] = cost(np.arange(end), end)
        return rows[end][starts]

    return run


def _crops(total: Callable[[list[int], list[int]], float], low: float, high: float) -> Generator[float, list[int], dict[int, list[int]]]:
    """Asks for the optimal ends at one penalty after the other; ``total`` sums the costs of segments from their starts and ends; :func:`crops`."""
    found: dict[int, list[int]] = {}

    def solve(beta: float) -> Generator[float, list[int], tuple[int, float]]:
        ends = yield beta
        found.setdefault(len(ends) - 1, ends)
        return len(ends) - 1, total([0, *ends[:-1]], ends)

    fa = yield from solve(low)
    fb = yield from solve(high)
    todo = [(low, fa, high, fb)]
    while todo:
        a, fa, b, fb = todo.pop()
        if fa[0] > fb[0] + 1:
            mid = (fb[1] - fa[1]) / (fa[0] - fb[0])
            if a < mid < b:
                f = yield from solve(mid)
                if f[0] not in (fa[0], fb[0]):
                    todo += [(a, fa, mid, f), (mid, f, b, fb)]
    return found


def crops(n: int, cost: Cost, low: float, high: float, min_segment: int = MIN_SEGMENT) -> dict[int, list[int]]:
    """All optimal segmentations for penalties from ``low`` to ``high``, by number of changepoints: penalties are bisected where two
    neighbouring solutions differ by more than one changepoint."""
    steps = _crops(lambda s, e: float(sum(cost(np.array([a]), b)[0] for a, b in zip(s, e, strict=True))), low, high)
    beta = next(steps)
    while True:
        try:
            beta = steps.send(pelt(n, cost, beta, min_segment))
        except StopIteration as end:
            return end.value


def crops_many(costs: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[dict[int, list[int]]]:
    """:func:`crops` of many short series in step, from (series, ends, starts) costs."""
    out: list[dict[int, list[int]]] = [{} for _ in n]
    steps = {i: _crops(lambda s, e, m=costs[i]: sum(m[e, s].tolist()), float(low[i]), float(high[i])) for i in range(len(n))}
    ask = {i: next(x) for i, x in steps.items()}
    while ask:
        at = np.array(list(ask))
        answers = pelt_many(costs if len(at) == len(n) else costs[at], n[at], np.array(list(ask.values())))
        ask = {}
        for i, ends in zip(at.tolist(), answers, strict=True):
            try:
                ask[i] = steps[i].send(ends)
            except StopIteration as end:
                out[i] = end.value
    return out


def adjusted_r2(y: np.ndarray, ends: list[int]) -> float:
    """Adjusted R^2 of the weighted fit through the origin of (variance - mean) on squared mean over segments of 4 points or more."""
    at = np.array(ends) - 1
    parts = []
    e0 = a0 = b0 = 0.0
    for e, a, b in zip(ends, np.cumsum(y)[at].tolist(), np.cumsum(y * y)[at].tolist(), strict=True):  # a few segments, for which arrays cost more than they save
        if (w := e - e0) >= 4:
            m = (a - a0) / w
            parts.append((w, m * m, max(b - b0 - (a - a0) * m, 0) / (w - 1) - m))
        e0, a0, b0 = e, a, b
    if len(parts) < 3:
        return -np.inf
    square = sum(w * x * x for w, x, _ in parts)
    if not square:
        return -np.inf
    slope = sum(w * x * z for w, x, z in parts) / square
    total = sum(w * z * z for w, _, z in parts)
    r2 = 1 - sum(w * (z - slope * x) ** 2 for w, x, z in parts) / total if total else 0.0
    return 1 - (1 - r2) * len(parts) / (len(parts) - 1)


def segment_states(df: DataFrame, by: list[str], order: list[str], value: str, rpc: str, states: int = 9, alpha: float = 0.02, pen: str = "MBIC") -> DataFrame:
    """Segments of each series that are explained by one copy state each: by.., seg, first, last, n, state.

    The cost of a segment is minus the summed log-probability of its best state (negative binomial, mean state * rpc of the series). Series whose ``rpc`` is null or not
    positive, or without values, give no rows.
    """
    from seriesloom.operators.states import emissions

    at = order[-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    kind_at = df.schema[at].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=[value, rpc]).sort_values(order)
        r = float(p[rpc].iloc[0]) if len(p) else 0.0
        if r <= 0:
            return pd.DataFrame(columns=[*by, "seg", "first", "last", "n", "state"], dtype=object)
        y, pos = p[value].to_numpy(float), p[at].to_numpy()
        log_p = emissions(y, states, r, 0.05 * r, alpha, alpha)
        ends = pelt(len(y), state_cost(log_p, pen == "MBIC"), penalty(pen, max(len(y), 3), 1))
        starts = [0, *ends[:-1]]
        out = {k: [pdf[k].iloc[0]] * len(ends) for k in by}
        out |= {"seg": range(1, len(ends) + 1), "first": [pos[s] for s in starts], "last": [pos[e - 1] for e in ends], "n": [e - s for s, e in zip(starts, ends, strict=True)], "state": [int(log_p[s:e].sum(0).argmax()) for s, e in zip(starts, ends, strict=True)]}
        return pd.DataFrame(out)

    cols = df.select(*dict.fromkeys([*by, *order, value, rpc]))
    return spread_by(cols, by).groupBy(*by).applyInPandas(run, f"{fields}, seg int, first {kind_at}, last {kind_at}, n int, state int")


PARAMETERS = {"normal": 1, "poisson": 1, "normal_mean": 1, "np": 1}


def segment(df: DataFrame, by: list[str], order: list[str], value: str, kind: str = "nb_mm", pen: str = "MBIC", manual: float | None = None, alpha: float | None = None, rpc: str | float = 1.0, with_crops: bool = False, gap: int = MIN_SEGMENT, merged: float | None = None, dealt: bool = False) -> DataFrame:
    """Segments of each series: by.., seg, first, last (values of the last order column), n, level (median).

    Without ``alpha`` each series has its own dispersion, by maximum likelihood, 0.01 where it shows no extra variance. ``rpc`` may be a column that holds one value for each series; series in which it
    is null or not positive are segmented with 1. Segments have ``gap`` points or more. With ``merged`` neighbours that don't differ at that level are joined afterwards (:func:`merge_segments`).

    ``dealt``: :func:`~seriesloom.util.map_series`. Null values are left out before and the segments span them. ``with_crops`` chooses among all segmentations of the penalty range
    the one with the best :func:`adjusted_r2`. One series is one group and must fit in a task, which is what a series is.
    """
    at = order[-1]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    kind_at = df.schema[at].dataType.simpleString()

    d = PARAMETERS.get(kind, 2)

    def bounds(n: int) -> tuple[float, float]:
        return max(0.0, min(penalty("AIC", n, d), penalty("BIC", n, d))), penalty("MBIC", n, d) + 1

    def chosen(y: np.ndarray, found: dict[int, list[int]]) -> list[int]:
        return max(found.values(), key=lambda e: (adjusted_r2(y, e), -len(e)))

    def solved(ys: list[np.ndarray], more: list[dict]) -> list[list[int]]:
        """Ends of each series: short ones in step, from the costs of all their segments, long ones for themselves."""
        ends: list[list[int]] = [[] for _ in ys]
        short = [i for i, y in enumerate(ys) if 0 < len(y) <= SHORT and (not kind.startswith("nb") or 0 <= y.min() and y.max() < _Terms.MOST)]
        for i in sorted(set(range(len(ys))) - set(short)):
            y, n = ys[i], len(ys[i])
            if with_crops and n > 3:
                ends[i] = chosen(y, crops(n, remembered(n, cost_function(y, kind, **more[i])), *bounds(n)))
            else:
                ends[i] = pelt(n, cost_function(y, kind, mbic=pen == "MBIC", **more[i]), penalty(pen, max(n, 3), d, manual), gap)
        for use_crops in (True, False) if with_crops else (False,):
            own = sorted((i for i in short if (with_crops and len(ys[i]) > 3) == use_crops), key=lambda i: len(ys[i]))
            while own:
                size = len(ys[own[-1]]) + 1
                part, own = own[-max(1, 1_000_000 // size**2) :], own[: -max(1, 1_000_000 // size**2)]
                all_costs = np.full((len(part), size, size), np.inf)
                for k, i in enumerate(part):
                    n = len(ys[i])
                    all_costs[k, : n + 1, : n + 1] = pair_costs(ys[i], kind, pen == "MBIC" and not use_crops, **more[i])
                n = np.array([len(ys[i]) for i in part])
                if use_crops:
                    b = np.array([bounds(k) for k in n.tolist()])
                    for i, found in zip(part, crops_many(all_costs, n, b[:, 0], b[:, 1]), strict=True):
                        ends[i] = chosen(ys[i], found)
                else:
                    for i, e in zip(part, pelt_many(all_costs, n, np.array([penalty(pen, max(k, 3), d, manual) for k in n.tolist()]), gap), strict=True):
                        ends[i] = e
        return ends

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        values, pos = rows[value].to_numpy(float, na_value=np.nan), rows[at].to_numpy()
        places = [s + np.flatnonzero(~np.isnan(values[s:e])) for s, e in zip(first, [*first[1:], len(rows)], strict=True)]
        ys, more = [values[p] for p in places], []
        for y, p in zip(ys, places, strict=True):
            a = alpha if alpha is not None else (dispersion_ml(y) or 0.01) if kind in ("nb_alpha", "nb_grid") and len(y) else 0.01
            r = (rows[rpc].iat[p[0]] if len(p) else 1.0) if isinstance(rpc, str) else rpc
            more.append({"alpha": a, "rpc": float(r) if r is not None and r > 0 else 1.0})
        ends = solved(ys, more)
        if merged is not None:
            ends = [merge_segments(y, e, merged) if e else e for y, e in zip(ys, ends, strict=True)]
        count = [len(e) for e in ends]
        starts = [[0, *e[:-1]] if e else [] for e in ends]
        out = {k: rows[k].iloc[np.repeat(first, count)].tolist() for k in by}
        out["seg"] = [i + 1 for k in count for i in range(k)]
        out["first"] = [pos[p[s]] for p, x in zip(places, starts, strict=True) for s in x]
        out["last"] = [pos[p[e - 1]] for p, x in zip(places, ends, strict=True) for e in x]
        out["n"] = [e - s for x, z in zip(starts, ends, strict=True) for s, e in zip(x, z, strict=True)]
        out["level"] = [float(np.median(y[s:e])) for y, x, z in zip(ys, starts, ends, strict=True) for s, e in zip(x, z, strict=True)]
        return pd.DataFrame(out)

    cols = df.select(*dict.fromkeys([*by, *order, value, *([rpc] if isinstance(rpc, str) else [])]))
    return map_series(cols, by, order, run, f"{fields}, seg int, first {kind_at}, last {kind_at}, n int, level double", dealt)
