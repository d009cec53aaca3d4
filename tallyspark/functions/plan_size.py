"""Planning formulas as column expressions, so they apply per stratum of any size."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import Col, c


def normal_quantile(confidence: float = 0.95) -> float:
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_upper(x: float, df: int) -> float:
    """Upper tail of a chi-square, by the regularised incomplete gamma series."""
    if x <= 0:
        return 1.0
    a, half = df / 2, x / 2
    term = total = 1 / a
    n = a
    while abs(term) > 1e-17 * abs(total) and n < a + 10_000:
        n += 1
        term *= half / n
        total += term
    lower = total * math.exp(-half + a * math.log(half) - math.lgamma(a))
    if lower < 0.999:
        return max(0.0, 1 - lower)
    # far tail: continued fraction keeps the small probability accurate
    b = half + 1 - a
    tiny = 1e-300
    cc, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        cc = b + an / cc or tiny
        h *= d * cc
        if abs(d * cc - 1) < 1e-15:
            break
    return math.exp(-half + a * math.log(half) - math.lgamma(a)) * h


def required_units(loss_sd: Col, half_width: Col, inflation: Col, retention: Col,
                   confidence: float = 0.95) -> list[Column]:
    """Units for a paired mean-loss interval of a given half width, before and after design losses."""
    z = F.lit(normal_quantile(confidence))
    raw = F.pow(z * c(loss_sd) / c(half_width), F.lit(2.0))
    complete = F.greatest(F.lit(2), F.ceil(c(inflation) * raw))
    return [F.greatest(F.lit(2), F.ceil(raw)).cast("long").alias("independent_units"),
            complete.cast("long").alias("complete_units"),
            F.ceil(complete / c(retention)).cast("long").alias("candidate_units")]


def wilson_half_width(p: Col, n: Col, confidence: float = 0.95) -> Column:
    z2 = normal_quantile(confidence) ** 2
    pp, nn = c(p), c(n).cast("double")
    return F.sqrt(F.lit(z2)) * F.sqrt(pp * (F.lit(1.0) - pp) / nn + F.lit(z2) / (nn * nn * 4.0)) \
        / (F.lit(1.0) + F.lit(z2) / nn)


def wilson_minimal_units(p: Col, half_width: Col, confidence: float = 0.95) -> Column:
    """Smallest n whose Wilson half width at p does not exceed the target.

    The bound is a quadratic in n, so the smallest n is its positive root rounded up.
    """
    z2 = normal_quantile(confidence) ** 2
    h2 = c(half_width) * c(half_width)
    linear = F.lit(2 * z2) * h2 - F.lit(z2) * c(p) * (F.lit(1.0) - c(p))
    constant = (h2 - F.lit(0.25)) * F.lit(z2 * z2)
    root = (-linear + F.sqrt(linear * linear - F.lit(4.0) * h2 * constant)) / (F.lit(2.0) * h2)
    return F.greatest(F.lit(1), F.ceil(root)).cast("long")


def all_found_lower_bound(n: Col, alpha: float = 0.05) -> Column:
    """Exact lower limit of a proportion when all n of n were found."""
    return F.when(c(n) > 0, F.pow(F.lit(alpha / 2), F.lit(1.0) / c(n)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1), key=abs)
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(tiny, 1 + step * d, key=abs)
            c = max(tiny, 1 + step / c, key=abs)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection of the incomplete beta function."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(d1 / 2, d2 / 2, mid) < p else (low, mid)
    x = (low + high) / 2
    return d2 * x / (d1 * (1 - x))
