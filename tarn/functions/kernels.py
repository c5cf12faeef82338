"""NumPy kernels for what no query expresses: special functions and small matrices."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of all tables with the same margins that are at most as likely as this one; ones within rounding count as equal.

    Tables are counted outwards from the likeliest one, by the ratios of neighbours, as far as 40 deviations; what is
    beyond doesn't show in a double. So large margins cost the root of their size.
    """
    r1, c1, n = a + b, a + c, a + b + c + d
    low, high = max(0, r1 + c1 - n), min(r1, c1)
    mode = min(max((r1 + 1) * (c1 + 1) // (n + 2), low), high)
    reach = 50 + int(40 * math.sqrt(r1 * c1 / max(n, 1) * (n - r1) / max(n, 1) * (n - c1) / max(n - 1, 1)))
    first, last = max(low, mode - reach), min(high, mode + reach)
    if not first <= a <= last:
        return 0.0
    k = np.arange(first, last, dtype=np.float64)
    step = np.log((c1 - k) * (r1 - k)) - np.log((k + 1) * (n - c1 - r1 + k + 1))
    below, above = -np.cumsum(step[: mode - first][::-1])[::-1], np.cumsum(step[mode - first :])
    p = np.exp(np.concatenate((below, [0.0], above)))
    # This table's own likelihood is one of these, so that it always counts itself.
    return float(min(1.0, p[p <= p[a - first] * (1 + 1e-10)].sum() / p.sum()))


def coral(beta: np.ndarray, source_cov: np.ndarray, target_cov: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Coefficients carried from one covariance to another, so that the score keeps its spread."""

    def power(m: np.ndarray, k: float) -> np.ndarray:
        w, v = np.linalg.eigh((m + m.T) / 2)
        return (v * np.maximum(w, floor) ** k) @ v.T

    return power(target_cov, -0.5) @ power(source_cov, 0.5) @ beta
