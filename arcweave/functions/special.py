"""Distribution functions that numpy lacks."""

from __future__ import annotations

import math

TINY = 2.2250738585072014e-308


def two_sided_p(z: float) -> float:
    """Normal two-sided p-value; never 0 for a finite z."""
    if math.isnan(z):
        return math.nan
    if math.isinf(z):
        return 0.0
    return max(math.erfc(abs(z) / math.sqrt(2)), TINY)


def gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: float) -> float:
    low, high = 0.0, max(1.0, df)
    while gamma_p(df / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(df / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for m in range(500):
        for even in (True, False):
            if m == 0 and even:
                num = 1.0
            elif even:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def f_sf(x: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))
