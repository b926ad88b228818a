"""Scalar functions of the statistics, as Columns and as numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def choose(n: Column, k: int) -> Column:
    """n over k as a double, 0 where n < k; a product, so it cannot overflow."""
    out = F.lit(1.0)
    for m in range(k):
        out = out * (n - m) / (m + 1)
    return F.when(n >= k, out).otherwise(0.0)


def choose_np(n, k: int):
    out = np.ones_like(np.asarray(n, float))
    for m in range(k):
        out = out * (n - m) / (m + 1)
    return np.where(np.asarray(n) >= k, out, 0.0)


def ratio(decay: float) -> float:
    """w = 1 - exp(-decay): the factor by which each further partner or tie counts less."""
    return -math.expm1(-decay)


def weight(s: Column, decay: float) -> Column:
    """exp(decay) (1 - w**s); 0 at 0 and 1 at 1."""
    return F.lit(math.exp(decay)) * (1 - F.pow(F.lit(ratio(decay)), s.cast("double")))


def weight_np(s, decay: float):
    return math.exp(decay) * (1 - ratio(decay) ** np.asarray(s, float))


def power(s: Column, decay: float) -> Column:
    return F.pow(F.lit(ratio(decay)), s.cast("double"))


def log1pexp(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
