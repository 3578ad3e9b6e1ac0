"""Tails of the t, chi-square (1 degree) and normal distributions, vectorised with numpy.

The regularised incomplete beta function comes from its continued fraction
(modified Lentz), which every textbook of numerical methods gives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LOG_GAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    out = d.copy()
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + numerator / np.where(np.abs(c) < _TINY, _TINY, c)
            out *= c * d
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_LOG_GAMMA(a + b) - _LOG_GAMMA(a) - _LOG_GAMMA(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    direct = front * _fraction(a, b, np.where(low, inner, 0.5)) / a
    other = 1 - front * _fraction(b, a, np.where(low, 0.5, 1 - inner)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, direct, other)))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p, df) -> np.ndarray:
    """The p-quantile of T, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    tail = 2 * np.minimum(p, 1 - p)
    low, high = np.zeros_like(p), np.full_like(p, 1e6)
    for _ in range(100):
        mid = (low + high) / 2
        more = t_two_sided(mid, df) > tail
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return np.where(p >= 0.5, high, -high)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where t is null or there is no degree of freedom."""
    none = t.isna() | df.isna() | (df < 1)
    return pd.Series(np.where(none, np.nan, t_two_sided(t.mask(none, 0.0), df.mask(none, 1.0))))


@F.pandas_udf(DoubleType())
def t_interval_half(sem: pd.Series, df: pd.Series) -> pd.Series:
    """Half the width of the 95 % interval of a mean."""
    return pd.Series(np.where(sem.isna() | (df < 1), np.nan, sem.fillna(0) * t_quantile(0.975, np.maximum(df.fillna(1), 1))))


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with 1 degree of freedom."""
    return pd.Series(np.where(x.isna(), np.nan, _ERFC(np.sqrt(np.maximum(x.fillna(0), 0) / 2))))
