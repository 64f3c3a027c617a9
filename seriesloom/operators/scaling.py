"""From a mixture of signal levels to the scale of whole copies: mixture fit, candidate scales, choice of a solution."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.util import map_series


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log-gamma for positive x: recurrence by 6 and the asymptotic series."""
    x = np.asarray(x, float)
    out = -1 / x
    for k in range(1, 6):
        out -= 1 / (x + k)
    x = x + 6
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def tied_mixture(x: np.ndarray, components: int = 16, rounds: int = 40, starts: tuple[float, ...] = (0.75, 1.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Truncated Dirichlet-process mixture of Gaussians with means xi k, by full-batch variational steps; the best of several starting xi.

    Returns weights, means, variances and xi. Priors: stick weights with a gamma hyperprior, mean precision 0.1, precisions gamma(1, 1).
    """
    return tied_mixtures([x], components, rounds, starts)[0]


def tied_mixtures(xs: list[np.ndarray], components: int = 16, rounds: int = 40, starts: tuple[float, ...] = (0.75, 1.0)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """:func:`tied_mixture` of many series in step, those with about as many distinct values together."""
    own = [np.unique(x, return_counts=True) for x in xs]
    left = sorted(range(len(xs)), key=lambda i: len(own[i][0]))
    out: list = [None] * len(xs)
    while left:
        size = max(len(own[left[-1]][0]), 1)
        most = max(1, 60_000 // (size * components))
        part, left = left[-most:], left[:-most]
        x, times = np.zeros((len(part), size)), np.zeros((len(part), size))
        for row, i in enumerate(part):
            x[row, : len(own[i][0])], times[row, : len(own[i][0])] = own[i]
        solved = [_mixtures(x, times, components, rounds, xi) for xi in starts]
        for row, i in enumerate(part):
            best = 0
            for s in range(1, len(starts)):
                if solved[s][0][row] > solved[best][0][row]:
                    best = s
            _, w, m, v, xi = (a[row] for a in solved[best])
            out[i] = w, m, v, float(xi)
    return out


def _mixtures(x: np.ndarray, times: np.ndarray, components: int, rounds: int, start: float) -> tuple[np.ndarray, ...]:
    """Bounds, weights, means, variances and xi of (series, distinct values) with their numbers (0 beyond a series' own), from one starting xi; a series that has settled leaves the rounds."""
    k, b_all = np.arange(components, dtype=float), len(x)
    bounds, weights, means, variances, xis = np.zeros(b_all), np.zeros((b_all, components)), np.zeros((b_all, components)), np.zeros((b_all, components)), np.zeros(b_all)
    at = np.arange(b_all)
    g1, g2, a, b = np.ones((b_all, components)), np.ones((b_all, components)), np.full((b_all, components), 2.0), np.full((b_all, components), 0.5)
    w1, w2, xi, bound = np.full(b_all, float(components)), np.ones(b_all), np.full(b_all, start), np.full(b_all, -np.inf)
    both = digamma(g1 + g2)
    rest = digamma(g2) - both
    for step in range(rounds):
        prior = digamma(g1) - both
        prior[:, 1:] += np.cumsum(rest, 1)[:, :-1]
        tau = a / b
        far = x[:, :, None] - (xi[:, None] * k)[:, None, :]
        log_r = (prior + 0.5 * (digamma(a) - np.log(b)) - 0.5 * math.log(2 * math.pi))[:, None, :] - (0.5 * tau)[:, None, :] * far * far
        top = log_r.max(2, keepdims=True)
        r = np.exp(log_r - top)
        total = r.sum(2, keepdims=True)
        r *= times[:, :, None] / total
        n = r.sum(1)
        g1, g2 = 1 + n, (w1 / w2)[:, None] + n.sum(1, keepdims=True) - np.cumsum(n, 1)
        both = digamma(g1 + g2)
        rest = digamma(g2) - both
        w1, w2 = np.full(len(x), float(components)), 1 - rest[:, :-1].sum(1)
        rx = np.einsum("buk,bu->bk", r, x)
        xi = ((rx * k * tau).sum(1) + 0.1 * (k * k).sum()) / (0.1 * (k * k).sum() + (n * k * k * tau).sum(1))
        far = x[:, :, None] - (xi[:, None] * k)[:, None, :]
        a, b = 1 + 0.5 * n, 1 + 0.5 * (r * far * far).sum(1) + 0.05 * (xi[:, None] * k - k) ** 2
        before, bound = bound, ((top + np.log(total))[:, :, 0] * times).sum(1)
        done = np.abs(bound - before) < 1e-6 * np.abs(bound) if step < rounds - 1 else np.ones(len(x), bool)
        if done.any():
            v = g1[done] / (g1[done] + g2[done])
            w = v * np.concatenate([np.ones((len(v), 1)), np.cumprod(1 - v, 1)[:, :-1]], 1)
            own = at[done]
            bounds[own], weights[own], means[own], variances[own], xis[own] = bound[done], w / w.sum(1, keepdims=True), xi[done, None] * k, b[done] / a[done], xi[done]
            go = ~done
            at, x, times, g1, g2, a, b, w1, w2, xi, bound, both, rest = (q[go] for q in (at, x, times, g1, g2, a, b, w1, w2, xi, bound, both, rest))
            if not len(at):
                break
    return bounds, weights, means, variances, xis


def mixture_fit(df: DataFrame, series: str, value: str, components: int = 16, dealt: bool = False) -> DataFrame:
    """Mixture of each series: series, xi, prescale, and arrays weights, means, variances. Values are scaled so that the largest is ``components`` - 1; series
    without positive values get no row."""
    kind = df.schema[series].dataType.simpleString()

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        values = rows[value].to_numpy(float, na_value=np.nan)
        xs = [v[~np.isnan(v)] for v in np.split(values, first[1:])]
        use = [i for i, x in enumerate(xs) if len(x) and x.max() > 0]
        pre = [(components - 1) / xs[i].max() for i in use]
        fits = tied_mixtures([xs[i] * p for i, p in zip(use, pre, strict=True)], components)
        part = lambda j: [f[j].tolist() for f in fits]
        return pd.DataFrame({series: rows[series].iloc[first[use]].tolist(), "xi": [f[3] for f in fits], "prescale": pre, "weights": part(0), "means": part(1), "variances": part(2)})

    return map_series(df.select(series, value), [series], [], run, f"{series} {kind}, xi double, prescale double, weights array<double>, means array<double>, variances array<double>", dealt)


def candidate_scales(levels: DataFrame, series: str, mean: str, weight: str, least_weight: float = 0.05, least_product: float = 0.02, most: int = 9) -> DataFrame:
    """Candidate scales k / gap, k = 1 to ``most``, of each series: series, ordinal, gap, product, k, scale.

    Gaps are the distances between means that follow each other by falling weight, with the product of the two weights, and the
    means themselves with the squared weight. Levels of less than ``least_weight``, products below ``least_product`` and gaps of 0 give none.
    """
    w = Window.partitionBy(series).orderBy(F.desc(weight), mean)
    x = levels.where(F.col(weight) > least_weight).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(series)))
    step = F.struct(F.col("_i").alias("j"), F.abs(F.lead(mean).over(w) - F.col(mean)).alias("gap"), (F.col(weight) * F.lead(weight).over(w)).alias("product"))
    own = F.struct((F.col("_n") - 1 + F.col("_i")).cast("int").alias("j"), F.col(mean).alias("gap"), (F.col(weight) * F.col(weight)).alias("product"))
    g = x.withColumn("_s", step).withColumn("_o", own).select(series, F.explode(F.array("_s", "_o")).alias("g")).select(series, "g.*")
    g = g.where((F.col("gap") > 0) & (F.col("product") >= least_product))
    k = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    return k.select(series, ((F.col("j") - 1) * most + F.col("k")).cast("int").alias("ordinal"), "gap", "product", "k", (F.col("k") / F.col("gap")).alias("scale"))


def score_candidates(points: DataFrame, candidates: DataFrame, series: str, level: str, value: str, low: float, high: float, all_errors: bool = False) -> DataFrame:
    """Errors of each candidate whose mean rounded level lies in [low, high]: rounding errors of the levels (seg) and, with ``all_errors``, distances of the values (all) from the whole numbers.

    points has one row per position with its segment level and raw value. Positions and candidates meet as one row for each series, so no row is made for each position and candidate.
    """
    known = points.where(F.col(level).isNotNull() & F.col(value).isNotNull())
    at = known.groupBy(series).agg(F.collect_list(F.col(level).cast("double")).alias("_l"), F.collect_list(F.col(value).cast("double")).alias("_v"))
    carried = ["ordinal", "gap", "product", "k", "scale"]
    own = candidates.groupBy(series).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in carried])).alias("_c"))
    own = own.select(series, *[F.col(f"_c.{c}").alias(f"_{c}") for c in carried])
    made = ["ploidy", "ploidy_continuous", "n_bins", "rpc", *[f"error_seg_{k}" for k in ("l1", "l2", "sd", "median")], *[f"error_all_{k}" for k in ("l1", "l2", "sd", "median") if all_errors]]

    def errors(e: np.ndarray) -> list[np.ndarray]:
        n = e.shape[1]
        half = np.partition(e, ((n - 1) // 2, n // 2), axis=1)
        return [e.sum(1), np.sqrt((e * e).sum(1)), e.std(axis=1, ddof=1) if n > 1 else np.full(len(e), np.nan), (half[:, (n - 1) // 2] + half[:, n // 2]) / 2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, parts = [], []
            for name, lev, val, *own in zip(b[series], b["_l"], b["_v"], *[b[f"_{c}"] for c in carried], strict=True):
                c, lev, val = np.stack(own, 1), np.asarray(lev), np.asarray(val)
                y = c[:, 4:] * lev
                r = np.rint(y)
                total, n = r.sum(1), len(lev)
                keep = (total / n >= low) & (total / n <= high)
                c, y, r, total = c[keep], y[keep], r[keep], total[keep]
                if not len(c):
                    continue
                rpc = np.divide(val.sum(), total, out=np.full(len(c), np.nan), where=total != 0)
                parts.append(np.column_stack([c, total / n, y.sum(1) / n, np.full(len(c), float(n)), rpc, *errors(np.abs(y - r)), *(errors(np.abs(c[:, 4:] * val - r)) if all_errors else [])]))
                names += [name] * len(c)
            if names:
                x = np.concatenate(parts)
                yield pd.DataFrame({series: names} | {c: x[:, i] for i, c in enumerate([*carried, *made])})

    kind = points.schema[series].dataType.simpleString()
    x = at.join(own, series).mapInPandas(run, f"{series} {kind}, " + ", ".join(f"{c} double" for c in [*carried, *made]))
    whole = {"ordinal": "int", "k": "int", "n_bins": "bigint"}
    return x.select(series, *[F.col(c).cast(whole[c]).alias(c) if c in whole else F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in [*carried, *made]])


def choose(candidates: DataFrame, series: str, error: str, residual: str | None = None, tolerance: float = 0.25) -> DataFrame:
    """One solution per series. Without ``residual`` the one of least error, the first by ordinal of equals; with it the class of
    solutions whose ploidy lies within ``tolerance`` of the one of least residual, and in it the one of least error."""
    w = Window.partitionBy(series)
    x = candidates
    if residual is not None:
        first = F.first("ploidy").over(w.orderBy(F.abs(residual), "ordinal"))
        x = x.withColumn("_p", first).where(F.abs(F.col("ploidy") - F.col("_p")) <= tolerance).drop("_p")
    return x.withColumn("_rn", F.row_number().over(w.orderBy(error, "ordinal"))).where("_rn = 1").drop("_rn")
