"""Student's t distribution as column expressions: tail, density and quantile.

The tail is the integral of the density over [t, infinity), taken by exp-sinh quadrature: with x = t + e^(pi/2 sinh s)
the integrand falls off doubly exponentially at both ends, for the algebraic tails of few degrees of freedom as for the
normal-like ones of many, so a fixed set of nodes serves all. The density is evaluated through log1p and the gamma
ratio through an asymptotic series after a shift, so nothing cancels: both hold from 1 to 10^10 degrees of freedom and
beyond. The quantile is found by Newton steps from the normal one, which lies below it: the tail is convex
there, so the steps approach from one side.

Meant for the handful of rows a test summary has.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP, _NODES = 0.04, 240  # s from -4.8 to 4.8
_SHIFT = 100  # the gamma ratio is taken at this many degrees of freedom more
#: Coefficients of Gamma(z + 1/2) / Gamma(z) / sqrt(z) in powers of 1/z.
_RATIO_SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144)
_NEWTON_STEPS = 40


def _nodes() -> tuple[list[float], list[float]]:
    """Distances from the lower end and weights."""
    at, weight = [], []
    for i in range(-_NODES // 2, _NODES // 2 + 1):
        s = i * _STEP
        x = math.exp(math.pi / 2 * math.sinh(s))
        at.append(x)
        weight.append(_STEP * math.pi / 2 * math.cosh(s) * x)
    return at, weight


def normal_quantile(level: float) -> float:
    """The value that a normal variable stays within, on both sides, with the given probability."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def _gamma_ratio(z: Column) -> Column:
    """Gamma(z + 1/2) / Gamma(z)."""
    far = z + _SHIFT / 2
    series = reduce(lambda acc, c: acc / far + F.lit(c), reversed(_RATIO_SERIES), F.lit(0.0))
    steps = F.sequence(F.lit(0), F.lit(_SHIFT // 2 - 1))
    down = F.aggregate(steps, F.lit(1.0), lambda acc, j: acc * ((z + j) / (z + j + 0.5)))
    return F.sqrt(far) * series * down


def _height(df: Column) -> Column:
    """The density at 0."""
    return _gamma_ratio(df / 2) / F.sqrt(df * F.lit(math.pi))


def _shape(x: Column, df: Column) -> Column:
    """The density divided by that at 0."""
    return F.exp(-(df + 1) / 2 * F.log1p(x * x / df))


def _upper(t: Column, df: Column) -> Column:
    """Area under ``_shape`` from t >= 0 on."""
    at, weight = _nodes()
    nodes = F.arrays_zip(F.array(*[F.lit(x) for x in at]).alias("x"), F.array(*[F.lit(w) for w in weight]).alias("w"))
    return F.aggregate(nodes, F.lit(0.0), lambda acc, n: acc + n["w"] * _shape(t + n["x"], df))


def _usable(t: Column, df: Column) -> Column:
    return t.isNotNull() & ~F.isnan(t) & df.isNotNull() & ~F.isnan(df) & (df >= 1)


def two_sided_p(t: Column, df: Column) -> Column:
    """Probability of a value at least as far from 0; missing below one degree of freedom."""
    t, df = F.abs(t.cast("double")), df.cast("double")
    p = F.when(t == float("inf"), 0.0).otherwise(F.least(F.lit(1.0), 2 * _height(df) * _upper(t, df)))
    return F.when(_usable(t, df), p)


def two_sided_quantile(df: Column, level: float = 0.95) -> Column:
    """The value that a variable stays within, on both sides, with the given probability."""
    df = df.cast("double")
    height, tail = _height(df), (1 - level) / 2
    # everything the steps need of the row is carried, so it is computed once
    start = F.struct(F.lit(normal_quantile(level)).alias("t"), height.alias("height"), df.alias("df"))

    def closer(at: Column, _: Column) -> Column:
        t, own, h = at["t"], at["df"], at["height"]
        step = (h * _upper(t, own) - tail) / (h * _shape(t, own))
        return F.struct((t + step).alias("t"), h.alias("height"), own.alias("df"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON_STEPS)), start, closer)
    return F.when(df.isNotNull() & ~F.isnan(df) & (df >= 1), found["t"])
