"""Normal distribution as column expressions, so that nothing leaves the JVM, and as SQL that says the same."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Chebyshev fit to the complementary error function, relative error under 1.2e-7 everywhere, constant term first.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Rational fits to the quantile, relative error under 1.2e-9: numerator and denominator in the middle, then in the tails, highest power first.
_MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_MIDDLE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_SPLIT = 0.02425
#: Fixed value: the Euler-Mascheroni constant.
_EULER = 0.5772156649015329


def _horner(coefficients: tuple, x):
    """A polynomial, highest power first, of a column or of SQL text."""
    out = coefficients[0]
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})" if isinstance(x, str) else out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + z / 2)
    tail = t * F.exp(-z * z + _horner(_ERFC[::-1], t)) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + {z} / 2))"
    tail = f"{t} * exp(-{z} * {z} + {_horner(_ERFC[::-1], t)}) / 2"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def upper_quantile(tail: Column) -> Column:
    """The value that is exceeded with probability tail, from 0 to 0.5."""
    q, far = 0.5 - tail, F.sqrt(-2 * F.log(tail))
    r = q * q
    return F.when(tail < _SPLIT, -_horner(_TAIL, far) / _horner(_TAIL_BELOW, far)).otherwise(_horner(_MIDDLE, r) * q / _horner(_MIDDLE_BELOW, r))


def upper_quantile_sql(tail: str) -> str:
    q, far = f"(0.5 - {tail})", f"sqrt(-2 * ln({tail}))"
    r = f"({q} * {q})"
    return f"CASE WHEN {tail} < {_SPLIT} THEN -({_horner(_TAIL, far)}) / {_horner(_TAIL_BELOW, far)} ELSE {_horner(_MIDDLE, r)} * {q} / {_horner(_MIDDLE_BELOW, r)} END"


def benchmark(spread: Column, trials: Column) -> Column:
    """The ratio that the best of so many unskilled trials is expected to show; spread: their standard deviation."""
    n = F.greatest(trials, F.lit(2))
    return F.when(trials < 2, 0.0).otherwise(spread * ((1 - _EULER) * upper_quantile(1 / n) + _EULER * upper_quantile(1 / (n * math.e))))


def benchmark_sql(spread: str, trials: str) -> str:
    n = f"greatest({trials}, 2)"
    return f"CASE WHEN {trials} < 2 THEN 0.0 ELSE {spread} * ({1 - _EULER!r} * ({upper_quantile_sql(f'(1.0 / {n})')}) + {_EULER!r} * ({upper_quantile_sql(f'(1.0 / ({n} * {math.e!r}))')})) END"


def deflated_benchmark(spread: float, trials: int) -> float:
    """The same for two numbers."""
    if trials < 2:
        return 0.0
    inv = NormalDist().inv_cdf
    return spread * ((1 - _EULER) * inv(1 - 1 / trials) + _EULER * inv(1 - 1 / (trials * math.e)))
