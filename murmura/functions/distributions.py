"""Tail probabilities of the t and F distributions, by the published continued fraction of the incomplete beta function."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return 1.0 if t == 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_upper(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def kolmogorov_upper(x: float) -> float:
    """The limiting distribution's tail, by its series."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def studentized_range_upper(q: float, groups: int, df: float) -> float:
    """P(Q > q) of the studentized range of ``groups`` means, by numerical integration over the scale and the lowest mean."""
    import numpy as np

    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([1 - normal_upper(x) for x in z.tolist()])

    def of_range(w: float) -> float:
        # all others lie within w above the lowest
        inside = np.interp(z + w, z, cdf, right=1.0) - cdf
        return groups * float(np.trapezoid(phi * inside ** (groups - 1), z))

    if df > 5000:
        return 1 - of_range(q)
    # the scale s: df s**2 is chi-squared; weights in logarithms
    spread = 1 / math.sqrt(2 * df)
    s = np.linspace(max(1e-3, 1 - 9 * spread), 1 + 9 * spread + 2 / df, 401)
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float(np.trapezoid(np.exp(log) * np.array([of_range(q * x) for x in s.tolist()]), s))))


def normal_quantile(p: float) -> float:
    """The inverse of the normal distribution function, by bisection."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_upper(-middle) < p else (low, middle)
    return (low + high) / 2
