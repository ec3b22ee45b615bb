"""Tail probabilities for the handful of rows a test statistic leaves (numpy / stdlib only)."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n <= 2 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    t = r * math.sqrt((n - 2) / ((1.0 - r) * (1.0 + r)))
    return student_two_sided(t, n - 2)


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution (regularised upper incomplete gamma)."""
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    log_front = -z + a * math.log(z) - math.lgamma(a)
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        for _ in range(10_000):
            n += 1.0
            term *= z / n
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = z + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log_front) * h


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value."""
    x = math.sqrt(n) * d
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


# Response surface of the unit-root t statistic with a constant
# (MacKinnon 1994 for the p-value, MacKinnon 2010 for the critical values).
ADF_TAU_MIN, ADF_TAU_STAR, ADF_TAU_MAX = -18.83, -1.61, 2.74
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_CRITICAL = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}


def adf_p_value(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL_P if stat <= ADF_TAU_STAR else ADF_LARGE_P
    return normal_cdf(sum(c * stat**i for i, c in enumerate(coef)))


def adf_critical(level: str, nobs: int) -> float:
    return sum(c / nobs**i for i, c in enumerate(ADF_CRITICAL[level]))
