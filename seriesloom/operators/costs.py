"""Costs of segments and penalties, as column expressions over given segments.

``segment_sums`` gathers what the closed-form costs need with one aggregation; the negative-binomial ones also need the number of values above each
level, which is one more aggregation over (segment, value) pairs, so values are never gathered per segment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LN2PI = math.log(2 * math.pi)
#: Floors of variance and logarithm, and the distance from the smallest possible dispersion.
VAR_FLOOR, SSQ_FLOOR, LOG_FLOOR, EDGE = 1e-11, 1e-10, -1 + 1e-6, 1e-8


def segment_sums(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """l, x (sum), x2 (sum of squares) and y_max of each segment, over its non-null values."""
    v = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").cast("double").alias("l"), F.sum(v).alias("x"), F.sum(v * v).alias("x2"), F.max(v).alias("y_max"))


def normal_cost() -> Column:
    """l (ln 2 pi + ln var + 1) with the variance floored."""
    l, x, x2 = F.col("l"), F.col("x"), F.col("x2")
    var = F.greatest((x2 - x * x / l) / l, F.lit(VAR_FLOOR))
    return l * (LN2PI + F.log(var) + 1)


def poisson_cost() -> Column:
    """2 x (ln l - ln x); 0 for an all-zero segment."""
    return F.when(F.col("x") == 0, 0.0).otherwise(2 * F.col("x") * (F.log("l") - F.log(F.greatest("x", F.lit(1e-300)))))


def _sample_variance() -> Column:
    l, m = F.col("l"), F.col("x") / F.col("l")
    s = (F.col("x2") / l - m * m) * (l / F.nullif(l - 1, F.lit(0.0)))
    return F.when(F.coalesce(s, F.lit(0.0)) <= 0, SSQ_FLOOR).otherwise(s)


def dispersion(corrected: bool = False) -> Column:
    """Moment estimate of the dispersion, kept above its smallest possible value; ``corrected`` for bias."""
    m, s = F.col("x") / F.col("l"), _sample_variance()
    c = (s - m) / F.nullif((m * m - s / F.col("l")) if corrected else m * m, F.lit(0.0))
    low = -1 / F.nullif(F.col("y_max"), F.lit(0.0))
    return F.when((s <= m) | (c <= low), low + EDGE).otherwise(c)


def snapped_mean(rpc: Column, most: int = 50) -> Column:
    """The value of {0.5, rpc, 2 rpc, .., most rpc} nearest to the segment's mean; of equally near ones the first."""
    m = F.col("x") / F.col("l")
    k = F.least(F.greatest(F.ceil(m / rpc - 0.5), F.lit(1)), F.lit(most)) * rpc
    return F.when(F.abs(k - m) < F.abs(F.lit(0.5) - m), k).otherwise(F.lit(0.5))


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0: Stirling's series from x + 8 on, and the eight factors between."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    first = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (z - 0.5) * F.log(z) - z + 0.5 * LN2PI + series - first


def log_rising(c: Column, y: Column) -> Column:
    """sum_{j < y} log(1 + c j) in closed form, for c > -1 / (y - 1): by log-gamma values of 1 / c, and by the series in c where c y is small."""
    n1, n2, n3 = y * (y - 1) / 2, (y - 1) * y * (2 * y - 1) / 6, (y * (y - 1) / 2) * (y * (y - 1) / 2)
    small = c * n1 - c * c * n2 / 2 + c * c * c * n3 / 3
    up = log_gamma(1 / F.nullif(c, F.lit(0.0)) + y) - log_gamma(1 / F.nullif(c, F.lit(0.0))) + y * F.log(c)
    down = y * F.log(-c) + log_gamma(-1 / F.nullif(c, F.lit(0.0)) + 1) - log_gamma(-1 / F.nullif(c, F.lit(0.0)) - y + 1)
    return F.when(F.abs(c) * y < 1e-4, small).when(c > 0, up).otherwise(down)


def negative_binomial_terms(values: DataFrame, by: list[str], value: str, c: Column) -> DataFrame:
    """by.., l, x, x2, y_max, _c and _t of each segment: its sums, the dispersion ``c`` (an expression in the sums or in columns that are constant in a segment, kept as they are) and the part of the log-likelihood that
    depends on the single values. Values are counted first; everything else follows on the same partitioning. Null values are left out."""
    rest = [k for k in values.columns if k not in (*by, value)]
    n = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_y")).agg(F.count("*").cast("double").alias("_n"), *[F.first(k).alias(k) for k in rest])
    w, y = Window.partitionBy(*by), F.col("_y")
    s = n.withColumns({"l": F.sum("_n").over(w), "x": F.sum(F.col("_n") * y).over(w), "x2": F.sum(F.col("_n") * y * y).over(w), "y_max": F.max("_y").over(w)}).withColumn("_c", c)
    t = F.sum(F.when(y > 0, F.col("_n") * (log_rising(F.col("_c"), y) - log_gamma(y + 1))).otherwise(0.0)).alias("_t")
    return s.groupBy(*by).agg(*[F.first(k).alias(k) for k in ("l", "x", "x2", "y_max", "_c", *rest)], t)


def negative_binomial_cost(terms: DataFrame, mean: Column | None = None, clamp: bool = True) -> DataFrame:
    """Adds ``cost`` to :func:`negative_binomial_terms`: minus the log-likelihood of each segment at mean ``mean`` (its own by default) and its dispersion; 0 for all-zero segments."""
    m = F.col("x") / F.col("l") if mean is None else mean
    floor = (lambda v: F.greatest(v, F.lit(LOG_FLOOR))) if clamp else (lambda v: v)
    ll = F.col("x") * F.log(F.greatest(m, F.lit(1e-300))) - (F.col("x") + F.col("l") / F.col("_c")) * F.log1p(floor(F.col("_c") * m)) + F.col("_t")
    return terms.withColumn("cost", F.when(F.col("x") == 0, 0.0).otherwise(-ll))


def penalty(kind: str, n: float, parameters: int, manual: float | None = None) -> float:
    """Penalty per changepoint for n points and ``parameters`` per segment; the kinds ending in 0 don't count the changepoint itself."""
    d = parameters + (0 if kind.endswith("0") else 1)
    name = kind.rstrip("0").upper()
    if name == "NONE":
        return 0.0
    if name == "MANUAL":
        if manual is None:
            raise ValueError("a manual penalty needs a value")
        return float(manual)
    if name in ("SIC", "BIC"):
        return d * math.log(n)
    if name == "MBIC":
        return (parameters + 2) * math.log(n)
    if name == "AIC":
        return 2.0 * d
    if name in ("HANNAN-QUINN", "HQ"):
        return 2 * d * math.log(math.log(n))
    raise ValueError(f"no such penalty: {kind}")
