"""Upper tail probabilities of test statistics: one scalar per column, computed where the result is."""

from __future__ import annotations

import math

TINY = 1e-300
STEPS = 500


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    total = d
    for m in range(1, STEPS):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = c if abs(c) > TINY else TINY
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for k in range(1, 100_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    total = d
    for k in range(1, 100_000):
        top = -k * (k - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + top / c
        c = c if abs(c) > TINY else TINY
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def chi2_tail(statistic: float, dof: int) -> float:
    return 1.0 if dof <= 0 else gamma_tail(dof / 2, statistic / 2)


def f_tail(statistic: float, dof_between: int, dof_within: int) -> float:
    if statistic <= 0:
        return 1.0
    return beta_share(dof_within / 2, dof_between / 2, dof_within / (dof_within + dof_between * statistic))


def t_two_sided(statistic: float, dof: int) -> float:
    return beta_share(dof / 2, 0.5, dof / (dof + statistic * statistic))
