"""Tail probabilities that Spark has no function for; they are only taken of aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated forwards until no value moves."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    out = d.copy()
    for m in range(1, 400):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = np.where(np.abs(c) < TINY, TINY, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b) for a, b above 0."""
    x = np.clip(x, 0.0, 1.0)
    log = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        out = np.where(low, front * _fraction(a, b, np.where(low, x, 0.5)) / a, 1 - front * _fraction(b, a, np.where(low, 0.5, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) for d1 and d2 degrees of freedom; null where one is null or not above 0."""

    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        v, a, b = (s.to_numpy("float64") for s in (f, d1, d2))
        ok = (v >= 0) & (a > 0) & (b > 0)
        out = np.full(len(v), np.nan)
        out[ok] = incomplete_beta(b[ok] / 2, a[ok] / 2, b[ok] / (b[ok] + a[ok] * v[ok]))
        return pd.Series(out)

    return F.nullif(F.pandas_udf(tail, "double")(f.cast("double"), d1.cast("double"), d2.cast("double")), F.lit(float("nan")))


def normal(z: Column) -> Column:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # The coefficients of that formula.
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)
