"""Probabilities of the Kolmogorov and chi-squared statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evq import config


def kolmogorov_prob(z: Column) -> Column:
    """P(statistic > z) of the Kolmogorov distribution, as a pure expression."""
    u = F.abs(z)
    safe = F.greatest(u, F.lit(0.2))
    inverse_square = 1.0 / (safe * safe)
    theta = sum((F.exp(c * inverse_square) for c in config.KOLMOGOROV_C), F.lit(0.0))
    terms = F.bround(3.0 / safe)
    square = u * u

    def term(j: int) -> Column:
        value = F.exp(-2.0 * j * j * square)
        return value if j == 1 else F.when(terms >= j, value).otherwise(0.0)

    series = term(1) - term(2) + term(3) - term(4)
    return (
        F.when(u < 0.2, 1.0)
        .when(u < 0.755, 1.0 - config.KOLMOGOROV_W * theta / safe)
        .when(u < 6.8116, 2.0 * series)
        .when(u.isNotNull(), 0.0)
    )


#: Steps of an expansion of the chi-squared probability at most.
STEPS = 100_000


def chi2_prob(chi2: Column, ndf: Column) -> Column:
    """P(chi-squared > chi2) with ``ndf`` degrees of freedom; meant for one row per pair of histograms.

    The one value Spark has no expression for (it lacks the incomplete gamma
    function), hence an Arrow-batched function. It is defined here so that it is
    shipped by value and workers need not have this package.
    """

    steps = STEPS

    def probability(chi2: pd.Series, ndf: pd.Series) -> pd.Series:
        """Regularised upper incomplete gamma: power series below a + 1, continued fraction above; all rows at once.
        What has not converged after ``STEPS`` steps is null."""
        x, a = 0.5 * chi2.to_numpy(dtype=float), 0.5 * ndf.to_numpy(dtype=float)
        result = np.full(len(x), np.nan)
        result[(x == 0) & (a > 0)] = 1.0
        result[np.isinf(x) & (x > 0) & (a > 0)] = 0.0
        usable = (x > 0) & (a > 0) & np.isfinite(x) & np.isfinite(a)
        log_gamma = np.array([math.lgamma(v) if v > 0 else np.nan for v in a])
        front = np.exp(a * np.log(np.where(usable, x, 1.0)) - x - log_gamma)
        rows = np.flatnonzero(usable & (x < a + 1.0))
        total = 1.0 / a[rows]
        term, n = total.copy(), a[rows].copy()
        for _ in range(steps):
            if not len(rows):
                break
            n += 1.0
            term *= x[rows] / n
            total += term
            done = np.abs(term) <= np.abs(total) * 1e-16
            result[rows[done]] = 1.0 - front[rows[done]] * total[done]
            rows, total, term, n = rows[~done], total[~done], term[~done], n[~done]
        rows = np.flatnonzero(usable & (x >= a + 1.0))
        tiny = 1e-300
        b = x[rows] + 1.0 - a[rows]
        c, d = np.full(len(rows), 1.0 / tiny), 1.0 / b
        fraction = d.copy()
        for i in range(1, steps + 1):
            if not len(rows):
                break
            numerator = -i * (i - a[rows])
            b += 2.0
            d = numerator * d + b
            d = 1.0 / np.where(d == 0, tiny, d)
            c = b + numerator / c
            c = np.where(c == 0, tiny, c)
            step = c * d
            fraction *= step
            done = np.abs(step - 1.0) <= 1e-15
            result[rows[done]] = front[rows[done]] * fraction[done]
            rows, b, c, d, fraction = rows[~done], b[~done], c[~done], d[~done], fraction[~done]
        return pd.Series(result)

    value = F.pandas_udf(probability, DoubleType())(chi2.cast("double"), ndf.cast("double"))
    return F.when(chi2.isNotNull() & (ndf > 0), value)
