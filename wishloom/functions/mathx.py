"""Numeric expressions Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: shift by eight, then the Stirling series."""
    x = x.cast("double")
    z = x + 8.0
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    # 1/12z - 1/360z^3 + 1/1260z^5 - 1/1680z^7 + 1/1188z^9
    r = 1.0 / (z * z)
    series = (1 / 12.0 - r * (1 / 360.0 - r * (1 / 1260.0 - r * (1 / 1680.0 - r / 1188.0)))) / z
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction until it stands still."""
    a, b, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log_gamma_of = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma_of(p + q) - log_gamma_of(p) - log_gamma_of(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    m = 0
    live = np.ones(len(y), bool)
    while live.any():
        m += 1
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = np.where(live, out * d * c, out)
        live &= np.abs(d * c - 1) > 1e-15
    inside = np.where(y <= 0, 0.0, front * out)
    return np.clip(np.where(swap, 1 - inside, inside), 0.0, 1.0)


@F.pandas_udf(DoubleType())
def binomial_at_most(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k) for X ~ Binomial(n, p)."""
    within = np.clip(k, 0, np.maximum(n - 1, 0))
    inner = incomplete_beta(np.maximum(n - within, 1), within + 1, 1 - p)
    return pd.Series(np.where(k >= n, 1.0, np.where(k < 0, 0.0, inner)))


def order_statistic_rank(n: np.ndarray, k: np.ndarray, q: float) -> np.ndarray:
    """Least c for which the k-th smallest of n draws from n values has rank c or less with chance q or more.

    That chance is P(Binomial(n, c / n) >= k).
    """
    low, high = np.zeros(len(n), np.int64), np.asarray(n, np.int64).copy()
    while (high - low > 1).any():
        middle = (low + high) // 2
        inside = (middle > low) & (middle < high)
        reached = incomplete_beta(k, n - k + 1, np.clip(middle / n, 1e-300, 1 - 1e-16)) >= q
        high = np.where(inside & reached, middle, high)
        low = np.where(inside & ~reached, middle, low)
    return high
