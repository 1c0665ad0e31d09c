"""Special functions missing from Spark SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational approximations (Mathematics of Computation 23, 1969), highest order last. For |z| up to
# NEAR: erf(z) = z A(z^2) / B(z^2); up to FAR: erfc(z) = exp(-z^2) C(z) / D(z); beyond: exp(-z^2) / z (1 / sqrt(pi) - P(1/z^2) / (z^2 Q(1/z^2))).
ERF_A = (3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560, 1.85777706184603153e-1)
ERF_B = (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0)
ERFC_C = (
    1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2,
    6.61191906371416295e1, 8.88314979438837594, 5.64188496988670089e-1, 2.15311535474403846e-8,
)
ERFC_D = (
    1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3,
    5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0,
)
TAIL_P = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2)
TAIL_Q = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725, 2.56852019228982242, 1.0)
NEAR, FAR = 0.46875, 4.0


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def erfc(z: Column, non_negative: bool = False) -> Column:
    """Complementary error function to double precision, as one codegen-friendly expression."""
    a = z if non_negative else F.abs(z)
    square = a * a
    inverse = F.lit(1.0) / F.greatest(square, F.lit(1.0))
    near = F.lit(1.0) - a * _polynomial(square, ERF_A) / _polynomial(square, ERF_B)
    middle = F.exp(-square) * _polynomial(a, ERFC_C) / _polynomial(a, ERFC_D)
    far = F.exp(-square) / F.greatest(a, F.lit(1.0)) * (F.lit(math.pi**-0.5) - inverse * _polynomial(inverse, TAIL_P) / _polynomial(inverse, TAIL_Q))
    tail = F.when(a <= NEAR, near).when(a <= FAR, middle).otherwise(far)
    return tail if non_negative else F.when(z >= 0, tail).otherwise(F.lit(2.0) - tail)


def relative_erfc(value: Column, maximum: Column) -> Column:
    """erfc(value / maximum) with an empty or zero maximum read as 'smallest possible scale'."""
    scale = F.greatest(F.coalesce(maximum, F.lit(0.0)), F.lit(1e-300))
    return erfc(F.least(value / scale, F.lit(30.0)), non_negative=True)
