"""The normal distribution on data columns, as plain expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of erf and erfc (Cody 1969), numerators and denominators by falling power.
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
     6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
_NEAR_ZERO, _NEAR = 0.46875, 4.0
# First approximation of the normal quantile (Acklam 2003), by falling power.
_QUANTILE_MIDDLE = (
    (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239),
    (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0),
)
_QUANTILE_TAIL = (
    (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0),
)
_TAIL = 0.02425


def polynomial(coefficients: Sequence, x: Column) -> Column:
    """Value of the polynomial with these coefficients (numbers or columns), by falling power."""
    first, *rest = [c if isinstance(c, Column) else F.lit(float(c)) for c in coefficients]
    return reduce(lambda value, c: value * x + c, rest, first)


def _ratio(pair: tuple, x: Column) -> Column:
    return polynomial(pair[0], x) / polynomial(pair[1], x)


def log_normal_cdf(z: Column) -> Column:
    """ln of the normal distribution function, to double precision also far in either tail.

    With y = |z| / sqrt 2, erfc(y) = exp(-y²) r(y) with a rational r, so the lower tail is -y² + ln r and needs no power
    that could vanish. Give a plain column: the expression names its argument many times.
    """
    x = -z / math.sqrt(2)
    y = F.abs(x)
    inverse = 1 / (y * y)
    far = (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(_FAR, inverse)) / y
    r = F.when(y <= _NEAR, _ratio(_ERFC, y)).otherwise(far)
    middle = F.log(0.5 * (1 - x * _ratio(_ERF, x * x)))
    return F.when(y <= _NEAR_ZERO, middle).when(x > 0, F.log(0.5 * r) - y * y).otherwise(F.log1p(-0.5 * r * F.exp(-y * y)))


def first_normal_quantile(p: Column) -> Column:
    """Normal quantile of 0 < p < 1 to about nine digits; one :func:`refined_quantile` gives the rest."""
    middle = p - 0.5
    square = middle * middle
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log1p(-p))
    return (
        F.when(p < _TAIL, _ratio(_QUANTILE_TAIL, low)).when(p > 1 - _TAIL, -_ratio(_QUANTILE_TAIL, high))
        .otherwise(middle * _ratio(_QUANTILE_MIDDLE, square))
    )


def refined_quantile(x: Column, p: Column) -> Column:
    """One step of Halley's method from the approximation ``x`` of the quantile of ``p``; columns, not expressions.

    Above the middle the upper tails are compared, which keeps all digits of a ``p`` close to 1.
    """
    off = F.when(p <= 0.5, F.exp(log_normal_cdf(x)) - p).otherwise((1 - p) - F.exp(log_normal_cdf(-x)))
    step = off * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
    return x - step / (1 + x * step / 2)
