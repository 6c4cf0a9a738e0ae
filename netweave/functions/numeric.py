"""Numeric expressions that behave the same under ANSI mode."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(c: Column) -> Column:
    """NaN to null, so that it cannot slip through comparisons or ``greatest``."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def coerce_double(c: Column, is_text: bool = True) -> Column:
    """Number or null.  Text such as ``1d`` is not a number, although the JVM parses it."""
    if not is_text:
        return finite_or_null(c.cast("double"))
    suffixed = F.trim(c).rlike(r"[0-9.][dDfF]$")
    return finite_or_null(F.when(suffixed, F.lit(None)).otherwise(c.try_cast("double")))


def clean_infinite(c: Column, value: float = 0.0) -> Column:
    """Null, NaN and both infinities become ``value``."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(value)).otherwise(c)


def clip(c: Column, low, high) -> Column:
    """Limit to [low, high]; null stays null, a null bound does not bind."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def log1p_clipped(c: Column, floor: bool = True) -> Column:
    """``log1p`` of a long-tailed column; negative input counts as zero when ``floor``."""
    return F.log1p(F.greatest(c, F.lit(0.0)) if floor else c)


def smoothed_ratio(top: Column, bottom: Column, offset: float) -> Column:
    """``top / (bottom + offset)``, null instead of an error on a zero divisor."""
    return F.try_divide(top, bottom + F.lit(offset))


# The rational approximations of the inverse normal distribution
# published as algorithm AS 241 (Wichura, 1988), lowest order first.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _rational(x: np.ndarray, pair) -> np.ndarray:
    top, bottom = (np.polynomial.polynomial.polyval(x, c) for c in pair)
    return top / bottom


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile of ``p`` in (0, 1), good to about 1e-16."""
    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    outer = np.where(tail <= 5.0, _rational(tail - 1.6, MIDDLE), _rational(tail - 5.0, TAIL))
    return np.where(np.abs(q) <= 0.425, q * _rational(0.180625 - q * q, CENTRAL), np.sign(q) * outer)


def hurwitz_zeta(s: Column, q: Column, terms: int = 12) -> Column:
    """Sum of (q+k)^-s over k >= 0 for s > 1, by Euler-Maclaurin after ``terms`` terms."""
    s, q = s.cast("double"), q.cast("double")
    head = F.lit(0.0)
    for k in range(terms):
        head = head + F.pow(q + F.lit(float(k)), -s)
    a = q + F.lit(float(terms))
    tail = F.pow(a, F.lit(1.0) - s) / (s - F.lit(1.0)) + F.lit(0.5) * F.pow(a, -s)
    # Bernoulli numbers over factorials, B2/2!, B4/4!, B6/6!, B8/8!.
    step = s * F.pow(a, -s - F.lit(1.0))
    for j, weight in enumerate((1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)):
        tail = tail + F.lit(weight) * step
        rise = F.lit(2.0 * j + 1.0)
        step = step * (s + rise) * (s + rise + F.lit(1.0)) / (a * a)
    return head + tail
