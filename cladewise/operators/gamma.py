"""Calibration by a gamma distribution with shape, location and scale.

The fit needs nothing of the data but sums: for a given location the best shape
and scale follow from the mean and the mean logarithm. So one aggregation gives
the likelihood of a whole grid of locations, and a few of them the maximum.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import finite
from ..plans.settled import settled
from .ranking import average_rank

#: Locations tried in one pass, passes, and how far below the least value they lie (in deviations, as powers of e).
GRID, PASSES, NEAR, FAR = 64, 6, -12.0, 6.0


class Gamma(NamedTuple):
    shape: float
    loc: float
    scale: float


def _digamma(x: float) -> tuple[float, float]:
    """Digamma and trigamma of a positive number: shifted upwards, then by their asymptotic series."""
    first = second = 0.0
    while x < 12:
        first, second, x = first - 1 / x, second + 1 / (x * x), x + 1
    y = 1 / (x * x)
    first += math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return first, second + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def shape_of(gap: float) -> float:
    """The shape a with ln a - digamma(a) = gap, gap being ln(mean) - mean(ln)."""
    a = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        first, second = _digamma(a)
        step = (math.log(a) - first - gap) / (1 / a - second)
        new = a - step if a > step else a / 2
        if abs(new - a) <= 1e-15 * a:
            break
        a = new
    return a


def _likelihood(mean: float, log_mean: float) -> tuple[float, float]:
    """Mean log-likelihood at the best shape and scale, and that shape."""
    gap = max(math.log(mean) - log_mean, 1e-12)
    a = shape_of(gap)
    return -math.lgamma(a) - a * math.log(mean / a) + (a - 1) * log_mean - a, a


def fit_gamma(df: DataFrame, value: str) -> Gamma | None:
    """Maximum-likelihood shape, location and scale of the finite values; None where they don't differ.

    Among the local maxima over locations below the least value the likeliest
    counts (the likelihood has no bound where the location comes near a least
    value and the shape is below one); without any, the likeliest of the grid.
    """
    x = df.where(finite(F.col(value))).select(F.col(value).cast("double").alias("x"))
    s = x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least")).first()
    if not s.sd or s.sd <= 1e-12 * max(abs(s.mean), 1e-300):
        return None
    at, best = np.linspace(NEAR, FAR, GRID), None
    for _ in range(PASSES):
        locs = [s.least - s.sd * math.exp(t) for t in at]
        logs = x.agg(*[F.avg(F.ln(F.col("x") - v)).alias(f"l{i}") for i, v in enumerate(locs)]).first()
        found = [_likelihood(s.mean - v, logs[i]) for i, v in enumerate(locs)]
        ll = [f[0] for f in found]
        tops = [i for i in range(1, GRID - 1) if ll[i] >= ll[i - 1] and ll[i] >= ll[i + 1]]
        i = max(tops or range(GRID), key=lambda k: ll[k])
        best = Gamma(found[i][1], locs[i], (s.mean - locs[i]) / found[i][1])
        if not tops:
            break
        at = np.linspace(at[i - 1], at[i + 1], GRID)
    return best


def lower_share(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    x = np.asarray(x, float)
    out, pos = np.zeros(len(x)), x > 0
    front = np.zeros(len(x))
    front[pos] = np.exp(a * np.log(x[pos]) - x[pos] - math.lgamma(a))
    low, high = pos & (x < a + 1), pos & (x >= a + 1)
    term = np.full(low.sum(), 1 / a)
    total, n = term.copy(), a
    while len(term) and np.any(term > total * 1e-17):
        n += 1
        term = term * x[low] / n
        total += term
    out[low] = front[low] * total
    b = x[high] + 1 - a  # modified Lentz
    c, d = np.full(len(b), 1e300), 1 / np.where(b == 0, 1e-300, b)
    h, k = d.copy(), 0
    while len(b):
        k += 1
        top, b = -k * (k - a), b + 2
        d, c = top * d + b, b + top / c
        d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
        h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-16) or k > 100_000:
            break
    out[high] = 1 - front[high] * h
    return out


def quantiles(law: Gamma, q: np.ndarray) -> np.ndarray:
    """Values below which shares ``q`` (between 0 and 1) of the law lie: Newton steps that stay in a bracket."""
    a, q = law.shape, np.asarray(q, float)
    low, high = np.zeros(len(q)), np.full(len(q), a + 40 * math.sqrt(a) + 60)
    while np.any(short := lower_share(a, high) < q):
        high = np.where(short, 2 * high, high)
    x = np.clip(np.exp((np.log(q) + math.lgamma(a + 1)) / a), 1e-300, a) if len(q) else q
    for _ in range(200):
        share = lower_share(a, x)
        low, high = np.where(share < q, x, low), np.where(share >= q, x, high)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = (share - q) / np.exp((a - 1) * np.log(x) - x - math.lgamma(a))
        new = x - step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        if np.all(np.abs(new - x) <= 1e-14 * np.abs(x)):
            x = new
            break
        x = new
    return law.loc + law.scale * x


def gamma_map(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Maps y on a gamma law fitted to x: its value at (avg_rank(y) - 0.5) / n, and never below y.

    Only rows in which both are finite count; the others keep their y. Where x
    doesn't vary, the law is that one value.
    """
    df = settled(df.withColumn("_fit", finite(F.col(x)) & finite(F.col(y))))
    fit = df.where("_fit")
    law, n = fit_gamma(fit, x), fit.count()
    if not n:
        return df.withColumn(out, F.col(y)).drop("_fit")
    if law is None:
        value = F.lit(fit.first()[x])
    else:
        q = F.pandas_udf(lambda s: pd.Series(quantiles(law, s.to_numpy())), DoubleType())
        value = q((F.col("_r") - 0.5) / n)
    mapped = average_rank(fit, y, out="_r").withColumn(out, F.greatest(F.col(y), value))
    return mapped.select(*df.columns, out).unionByName(df.where("not _fit").withColumn(out, F.col(y))).drop("_fit")
