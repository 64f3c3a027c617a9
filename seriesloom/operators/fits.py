"""Regressions per series: covariate bias, over-dispersion, robust lines, rank trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seriesloom.util import spread_by


def spline_basis(x: np.ndarray, knots: int = 5) -> np.ndarray:
    """Cubic truncated-power basis on standardised x with knots at quantiles, without a constant."""
    s = x.std() or 1.0
    z = (x - x.mean()) / s
    q = np.quantile(z, np.linspace(0, 1, knots + 2)[1:-1])
    return np.column_stack([z, z**2, z**3, *[np.maximum(z - k, 0) ** 3 for k in q]])


def smooth_factor(y: np.ndarray, base: np.ndarray, covariates: list[np.ndarray], ridge: float = 1.0, alpha: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Multiplicative effect of covariates on counts: penalised negative-binomial regression log mean = log(base) + c + s(x1) + ..; the effect is centred on a geometric mean of 1."""
    parts = [spline_basis(c) for c in covariates]
    x = np.column_stack([np.ones(len(y)), *parts])
    pen = np.r_[0, np.full(x.shape[1] - 1, ridge)]
    off, beta = np.log(np.maximum(base, 1e-9)), np.zeros(x.shape[1])
    beta[0] = math.log(max(y.mean(), 1e-9) / max(base.mean(), 1e-9))
    for _ in range(rounds):
        eta = np.clip(off + x @ beta, -30, 30)
        mu = np.exp(eta)
        w = mu / (1 + alpha * mu)
        z = eta - off + (y - mu) / mu
        new = np.linalg.solve((x.T * w) @ x + np.diag(pen + 1e-9), (x.T * w) @ z)
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        if done:
            break
    s = x[:, 1:] @ beta[1:]
    return np.exp(s - s.mean())


def correct_bias(df: DataFrame, series: str, order: list[str], value: str, level: str, covariates: list[str], least: int = 20) -> DataFrame:
    """Counts divided by the smooth effect of the covariates, rounded, never negative: series, order.., factor, corrected.

    Points with a null among value, level and covariates, and series with fewer than ``least`` such points, keep factor null and the value as it is.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(series, *order).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c: pdf[c].tolist() for c in (series, *order)})
        out["factor"], out["corrected"] = np.nan, pdf[value].to_numpy(float)
        ok = pdf[[value, level, *covariates]].notna().all(axis=1).to_numpy()
        if ok.sum() >= least and pdf.loc[ok, value].sum() > 0:
            p = pdf[ok]
            f = smooth_factor(p[value].to_numpy(float), p[level].to_numpy(float) + 1, [p[c].to_numpy(float) for c in covariates])
            out.loc[ok, "factor"] = f
            out.loc[ok, "corrected"] = np.maximum(np.round(p[value].to_numpy(float) / f), 0)
        return out

    cols = df.select(*dict.fromkeys([series, *order, value, level, *covariates]))
    return spread_by(cols, [series]).groupBy(series).applyInPandas(run, f"{kinds}, factor double, corrected double")


def dispersion_ml(y: np.ndarray, conditional: bool = False) -> float:
    """Maximum-likelihood dispersion at the mean (``conditional``: adjusted for the estimated mean), by golden section on log alpha; 0 for counts without extra variance."""
    if len(y) < 3:
        return 0.0
    m, l = y.mean(), len(y)
    if m <= 0 or y.var(ddof=1) <= m:
        return 0.0

    at = np.bincount(y.astype(np.int64))
    above = (l - np.cumsum(at))[:-1].astype(float)
    levels, x = np.arange(len(above)), y.sum()

    def value(t: float) -> float:
        a = math.exp(t)
        s = float(above @ np.log1p(a * levels) + x * math.log(m) - (x + l / a) * math.log1p(a * m))
        return s - 0.5 * math.log(l / (m * (1 + a * m))) if conditional else s

    lo, hi, g = math.log(1e-6), math.log(10.0), (math.sqrt(5) - 1) / 2
    c, d = hi - g * (hi - lo), lo + g * (hi - lo)
    fc, fd = value(c), value(d)
    for _ in range(60):
        if fc > fd:
            hi, d, fd = d, c, fc
            c = hi - g * (hi - lo)
            fc = value(c)
        else:
            lo, c, fc = c, d, fd
            d = lo + g * (hi - lo)
            fd = value(d)
    return math.exp((lo + hi) / 2)


def series_dispersion(df: DataFrame, series: str, value: str, without: float = 0.01) -> DataFrame:
    """(series, alpha): maximum-likelihood dispersion of the values of each series, ``without`` where they show no extra variance."""
    kind = df.schema[series].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({series: [pdf[series].iloc[0]], "alpha": [dispersion_ml(pdf[value].dropna().to_numpy(float)) or without]})

    return spread_by(df.select(series, value), [series]).groupBy(series).applyInPandas(run, f"{series} {kind}, alpha double")


def overdispersion(df: DataFrame, series: str, state: str, value: str, least: int = 5) -> DataFrame:
    """Dispersion of each series: mean over its positive states (of ``least`` points or more) of the maximum-likelihood dispersions, weighted by points, plain and conditional."""
    kind = df.schema[series].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna()
        groups = [g[value].to_numpy(float) for s, g in p.groupby(state) if s > 0 and len(g) >= least]
        n = sum(map(len, groups))
        a = [sum(len(g) * dispersion_ml(g, c) for g in groups) / n if n else None for c in (False, True)]
        return pd.DataFrame({series: [pdf[series].iloc[0]], "n_states": [len(groups)], "alpha": [a[0]], "alpha_conditional": [a[1]]})

    return spread_by(df.select(series, state, value), [series]).groupBy(series).applyInPandas(run, f"{series} {kind}, n_states int, alpha double, alpha_conditional double")


def bisquare_line(x: np.ndarray, y: np.ndarray, intercept: bool = True, rounds: int = 50) -> tuple[float, float, float]:
    """(intercept, slope, robust scale) by iterated bisquare weights from a least-absolute start; stands in for an MM estimate and needn't equal it."""
    design = np.column_stack([np.ones(len(x)), x]) if intercept else x[:, None]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(30):
        w = 1 / np.sqrt(np.maximum(np.abs(y - design @ beta), 1e-6))
        beta = np.linalg.lstsq(design * w[:, None], y * w, rcond=None)[0]
    scale = 0.0
    for _ in range(rounds):
        r = y - design @ beta
        scale = float(np.median(np.abs(r - np.median(r))) / 0.6745)
        if scale < 1e-12:
            break
        u = r / (4.685 * scale)
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)
        if (w > 0).sum() <= design.shape[1]:
            break
        new = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    return (float(beta[0]), float(beta[1]), scale) if intercept else (0.0, float(beta[0]), scale)


def robust_lines(df: DataFrame, series: str, x: str, y: str, least: int = 5) -> DataFrame:
    """Robust line of each series: series, n, intercept, slope, scale; null below ``least`` points or without spread in x."""
    kind = df.schema[series].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna()
        a = p[x].to_numpy(float)
        v = bisquare_line(a, p[y].to_numpy(float)) if len(p) >= least and np.ptp(a) > 0 else (None, None, None)
        return pd.DataFrame({series: [pdf[series].iloc[0]], "n": [len(p)], "intercept": [v[0]], "slope": [v[1]], "scale": [v[2]]})

    return spread_by(df.select(series, x, y), [series]).groupBy(series).applyInPandas(run, f"{series} {kind}, n int, intercept double, slope double, scale double")


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Kendall's tau-b and two-sided p of the tie-corrected normal approximation."""
    n = len(x)
    s = 0.0
    for i in range(n - 1):
        s += float((np.sign(x[i + 1 :] - x[i]) * np.sign(y[i + 1 :] - y[i])).sum())
    t, u = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    pairs = n * (n - 1) / 2
    tx, ty = (t * (t - 1)).sum() / 2, (u * (u - 1)).sum() / 2
    base = math.sqrt(max((pairs - tx) * (pairs - ty), 0.0))
    var = (n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum() - (u * (u - 1) * (2 * u + 5)).sum()) / 18
    if n > 2:
        var += (t * (t - 1) * (t - 2)).sum() * (u * (u - 1) * (u - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    var += (t * (t - 1)).sum() * (u * (u - 1)).sum() / (2 * n * (n - 1)) if n > 1 else 0.0
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    return (s / base if base else 0.0), math.erfc(abs(z) / math.sqrt(2))


def _scores(x: np.ndarray) -> tuple[float, np.ndarray]:
    """Mann-Kendall score of a series in its order, and the number of its values below less those above each one (for conditional scores)."""
    d = np.sign(x[None, :] - x[:, None])  # [i, j]: how x_j lies to x_i
    return float(np.triu(d, 1).sum()), d.sum(0)


def partial_mann_kendall(x: np.ndarray, z: np.ndarray) -> float:
    """Standardised Mann-Kendall score of x in its order without the part that the covariate z explains (conditional on z's own score); 0 where z explains all."""
    n = len(x)
    sx, rx = _scores(x)
    sz, rz = _scores(z)
    k = float(np.triu(np.sign((x[None, :] - x[:, None]) * (z[None, :] - z[:, None])), 1).sum())
    rank_x, rank_z = (n + 1 + rx) / 2, (n + 1 + rz) / 2
    cov = (k + 4 * float((rank_x * rank_z).sum()) - n * (n + 1) ** 2) / 3
    var = n * (n - 1) * (2 * n + 5) / 18
    rho = cov / var
    left = var * (1 - rho * rho)
    return (sx - rho * sz) / math.sqrt(left) if left > 1e-12 else 0.0


def partial_rank_correlation(x: np.ndarray, z: np.ndarray) -> float:
    """Spearman correlation of x with its order without the part of z; not a number where a rank has no spread or z explains all."""
    r = [np.arange(1.0, len(x) + 1), pd.Series(x).rank().to_numpy(), pd.Series(z).rank().to_numpy()]
    if min(v.std() for v in r) == 0:
        return math.nan
    c = np.corrcoef(r)
    below = (1 - c[0, 2] ** 2) * (1 - c[1, 2] ** 2)
    return float((c[0, 1] - c[0, 2] * c[1, 2]) / math.sqrt(below)) if below > 1e-12 else math.nan


def spss_skew(v: np.ndarray) -> float:
    """Bias-corrected skewness; not a number below 3 values or without spread."""
    n, s = len(v), v.std()
    return float(((v - v.mean()) ** 3).mean() / s**3 * math.sqrt(n * (n - 1)) / (n - 2)) if n > 2 and s > 0 else math.nan


#: What is made of each measure of the segments: plain, and with each segment counting as often as it has points (w).
PLAIN = {"mean": np.mean, "median": np.median, "sd": lambda v: v.std(ddof=1) if len(v) > 1 else math.nan}
REPEATED = {"wmean": np.mean, "wmedian": np.median, "wsd": PLAIN["sd"], "w1q": lambda v: np.quantile(v, 0.25), "w3q": lambda v: np.quantile(v, 0.75), "wskewness": spss_skew}
TREND = {"p": ["mean", "median", "sd", "wmean", "wmedian", "wsd"], "tau": ["mean", "median", "sd", "wmean", "wmedian", "wsd"], "tau_partial": ["mean", "median", *REPEATED], "rho_partial": [*REPEATED]}


def trend_summary(df: DataFrame, series: str, segment: list[str], covariate: str, value: str, least: int, control: str | None = None) -> DataFrame:
    """Trend of value against a covariate inside long segments, summed up per series.

    For each segment of ``least`` points or more that isn't all zero: p and tau of the Mann-Kendall test of the values in the order of the covariate (ties by position in the frame's order columns, here by value), and with ``control`` (for
    example the bias factor of each point) the partial score and the partial rank correlation without it. Per series: mean, median and sd over segments; mean, median, sd, quartiles and
    skewness with each segment counting as often as it has points; number of segments and points. Null where no segment qualifies or a measure isn't defined.
    """
    kind = df.schema[series].dataType.simpleString()
    measures = [m for m in TREND if control is not None or m in ("p", "tau")]
    fields = [f"{m}_{s}" for m in measures for s in TREND[m]]
    need = [covariate, value, *([control] if control is not None else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, g in pdf.dropna(subset=need).groupby(segment):
            if len(g) >= least and g[value].any():
                g = g.sort_values([covariate, value], kind="stable")
                y = g[value].to_numpy(float)
                tau, p = kendall(np.arange(len(y), dtype=float), y)
                z = g[control].to_numpy(float) if control is not None else None
                rows.append((len(y), p, tau, *((partial_mann_kendall(y, z), partial_rank_correlation(y, z)) if z is not None else ())))
        out = {series: [pdf[series].iloc[0]], "n_segments": [len(rows)], "n_points": [int(sum(r[0] for r in rows))]} | {f: [None] for f in fields}
        for i, m in enumerate(measures):
            v = np.array([r[i + 1] for r in rows], float)
            ok = ~np.isnan(v)
            if ok.any():
                v, rep = v[ok], np.repeat(v[ok], np.array([r[0] for r in rows])[ok])
                for s in TREND[m]:
                    x = float(PLAIN[s](v) if s in PLAIN else REPEATED[s](rep))
                    out[f"{m}_{s}"] = [None if math.isnan(x) else x]
        return pd.DataFrame(out)

    cols = df.select(*dict.fromkeys([series, *segment, *need]))
    return spread_by(cols, [series]).groupBy(series).applyInPandas(run, f"{series} {kind}, n_segments int, n_points int, " + ", ".join(f"{f} double" for f in fields))


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def nb_deviance(y: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    """Negative-binomial deviance of counts at means mu."""
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0)
    return float(2 * (first - (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu))).sum())


def bias_model(df: DataFrame, series: str, order: list[str], value: str, level: str, covariates: list[str], least: int = 20) -> DataFrame:
    """What the bias correction of each series explains: n, alpha (dispersion of the fit), deviance (of the model with the level alone, less that of the model with the covariates), p_value of that gain, dev_expl (share of the null
    deviance that the model explains), negative_elements (corrected counts below 0 before they are cut) and delta_reads (reads before less after). Null below ``least`` complete points or without reads."""
    kind = df.schema[series].dataType.simpleString()
    fields = ["alpha", "deviance", "p_value", "dev_expl", "delta_reads"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=[value, level, *covariates]).sort_values(order)
        out = {series: [pdf[series].iloc[0]], "n": [len(p)], "negative_elements": [0]} | {f: [None] for f in fields}
        y = p[value].to_numpy(float)
        if len(p) >= least and y.sum() > 0:
            off = np.log(p[level].to_numpy(float) + 1)
            extra = np.column_stack([spline_basis(p[c].to_numpy(float)) for c in covariates])
            alpha = 0.02
            for _ in range(8):  # dispersion and fit in turn
                small = nb_fit(y, np.column_stack([np.ones(len(y)), off]), np.zeros(2), alpha)
                full = nb_fit(y, np.column_stack([np.ones(len(y)), off, extra]), np.r_[0, 0, np.full(extra.shape[1], 1.0)], alpha)
                new = mean_dispersion(y, full[0])
                done, alpha = abs(new - alpha) < 1e-6, new
                if done:
                    break
            d0, d1 = nb_deviance(y, small[0], alpha), nb_deviance(y, full[0], alpha)
            null = nb_deviance(y, np.full(len(y), y.mean()), alpha)
            s = extra @ full[1][2:]
            corrected = np.round(y / np.exp(s - s.mean()))
            gain = max(d0 - d1, 0.0)
            out |= {"alpha": [alpha], "deviance": [gain], "p_value": [chi_square_tail(gain, max(full[2] - small[2], 1.0))], "dev_expl": [1 - d1 / null if null > 0 else 0.0], "negative_elements": [int((corrected < 0).sum())], "delta_reads": [float(y.sum() - np.maximum(corrected, 0).sum())]}
        return pd.DataFrame(out)

    cols = df.select(*dict.fromkeys([series, *order, value, level, *covariates]))
    return spread_by(cols, [series]).groupBy(series).applyInPandas(run, f"{series} {kind}, n int, negative_elements int, " + ", ".join(f"{f} double" for f in fields))


def nb_fit(y: np.ndarray, x: np.ndarray, ridge: np.ndarray, alpha: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, coefficients and effective degrees of freedom of a penalised negative-binomial regression with log link."""
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(max(y.mean(), 1e-9)) - (x[:, 1].mean() if x.shape[1] > 1 else 0.0)
    if x.shape[1] > 1:
        beta[1] = 1.0
    pen = np.diag(ridge + 1e-9)
    for _ in range(rounds):
        eta = np.clip(x @ beta, -30, 30)
        mu = np.exp(eta)
        w = mu / (1 + alpha * mu)
        gram = (x.T * w) @ x
        new = np.linalg.solve(gram + pen, (x.T * w) @ (eta + (y - mu) / mu))
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        if done:
            break
    return np.exp(np.clip(x @ beta, -30, 30)), beta, float(np.trace(np.linalg.solve(gram + pen, gram)))


def mean_dispersion(y: np.ndarray, mu: np.ndarray) -> float:
    """Maximum-likelihood dispersion of counts at given means, by golden section on its logarithm."""
    whole = y.astype(np.int64)
    top = int(whole.max())

    def value(t: float) -> float:
        a = math.exp(t)
        rising = np.r_[0.0, np.cumsum(np.log1p(a * np.arange(top)))][whole]
        return float((rising + y * np.log(mu) - (y + 1 / a) * np.log1p(a * mu)).sum())

    lo, hi, g = math.log(1e-6), math.log(10.0), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, d) if value(c) > value(d) else (c, hi)
    return math.exp((lo + hi) / 2)


def segment_likelihoods(df: DataFrame, series: str, segment: list[str], value: str) -> DataFrame:
    """Negative-binomial costs of each segment at the maximum-likelihood dispersion and at the conditional one: series, segment.., n, alpha, cost, alpha_conditional, cost_conditional.

    All-zero segments cost 0; segments without extra variance have dispersion 0 (Poisson).
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(series, *segment).schema)

    def minus_log(y: np.ndarray, a: float) -> float:
        m, x = y.mean(), y.sum()
        if x == 0:
            return 0.0
        gamma = sum(math.lgamma(v + 1) for v in y)
        if a <= 0:
            return float(len(y) * m - x * math.log(m) + gamma)
        above = (len(y) - np.cumsum(np.bincount(y.astype(np.int64))))[:-1].astype(float)
        return float(-(above @ np.log1p(a * np.arange(len(above))) + x * math.log(m) - (x + len(y) / a) * math.log1p(a * m) - gamma))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, g in pdf.dropna(subset=[value]).groupby(segment, sort=True):
            y = g[value].to_numpy(float)
            a, c = dispersion_ml(y), dispersion_ml(y, True)
            m = y.mean()
            extra = 0.5 * math.log(len(y) / (m * (1 + c * m))) if m > 0 and c > 0 else 0.0
            rows.append((pdf[series].iloc[0], *key, len(y), a, minus_log(y, a), c, minus_log(y, c) + extra))
        return pd.DataFrame(rows, columns=[series, *segment, "n", "alpha", "cost", "alpha_conditional", "cost_conditional"])

    cols = df.select(series, *segment, value)
    return spread_by(cols, [series]).groupBy(series).applyInPandas(run, f"{kinds}, n int, alpha double, cost double, alpha_conditional double, cost_conditional double")
