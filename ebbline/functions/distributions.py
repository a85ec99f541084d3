"""Tail probabilities for test statistics.

All are Spark expressions (series and continued fractions folded with ``aggregate``), so they stay
in the plan and need no Python worker. They are meant for result rows: one row per test.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 80
#: Degrees of freedom up to which the chi-square tail is summed; from _LARGE_DOF on a second degree
#: of freedom of an F variable counts as infinite.
_EXACT_DOF, _LARGE_DOF = 200_000, 1e8


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Name intermediate values, so that a long formula does not repeat their expressions."""
    bound = F.array(F.struct(*[c.alias(name) for name, c in values.items()]))
    return F.transform(bound, body)[0]


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    return _let({"x": x}, lambda v: _erfc(v["x"]))


def _erfc(x: Column) -> Column:
    steps = F.sequence(F.lit(1), F.lit(_TERMS))
    # Near zero: erf(x) = 2/sqrt(pi) * exp(-x^2) * sum of x*(2x^2)^n / (1*3*..*(2n+1)).
    series = F.aggregate(
        steps,
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    # Far out: exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + ...))), from the inside outwards.
    fraction = F.aggregate(
        F.reverse(steps), x, lambda acc, n: x + (n / F.lit(2.0)) / acc
    )
    far = F.exp(-x * x) / (math.sqrt(math.pi) * fraction)
    return F.when(x < 2.5, near).otherwise(far)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi2_tail(statistic: Column, dof: Column) -> Column:
    """P(X > statistic) for a chi-square X with a whole number of degrees of freedom.

    Even dof is a finite Poisson sum; odd dof is ``erfc`` plus the same sum at half steps.
    """
    return _let({"h": statistic / 2, "dof": dof}, lambda v: _chi2_tail(v["h"], v["dof"]))


def _chi2_tail(h: Column, dof: Column) -> Column:
    odd = dof % 2 == 1
    shift = F.when(odd, 0.5).otherwise(0.0)
    # Terms are carried as logarithms: exp(-h) alone would underflow for many degrees of freedom.
    first = -h + F.when(odd, F.log(2 * F.sqrt(h / math.pi))).otherwise(0.0)
    terms = F.floor(F.least(dof, F.lit(_EXACT_DOF)) / 2).cast("int")
    finite = F.aggregate(
        F.sequence(F.lit(1), F.greatest(terms, F.lit(1))),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] + F.log(h / (j + shift))).alias("term"),
            (acc["total"] + F.exp(acc["term"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    finite = F.when(h > 0, finite).otherwise(F.when(odd, 0.0).otherwise(1.0))
    # Beyond that the cube root of statistic / dof is normal to more digits than are shown.
    spread = 2 / (9 * dof)
    z = (F.pow(2 * h / dof, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    upper = erfc(F.abs(z) / math.sqrt(2.0)) / 2
    far = F.when(z > 0, upper).otherwise(1 - upper)
    total = F.when(odd, erfc(F.sqrt(h))).otherwise(0.0) + F.when(terms >= 1, finite).otherwise(0.0)
    return F.when(dof > _EXACT_DOF, far).when(dof >= 1, F.least(total, F.lit(1.0)))


def _log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for ``z > 0``: Stirling's series ten steps further up."""
    far = z + 10
    inverse = 1 / far
    stirling = (
        (far - 0.5) * F.log(far)
        - far
        + 0.5 * math.log(2 * math.pi)
        + inverse / 12
        - F.pow(inverse, 3) / 360
        + F.pow(inverse, 5) / 1260
        - F.pow(inverse, 7) / 1680
    )
    for step in range(10):
        stirling = stirling - F.log(z + step)
    return stirling


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta for ``x`` below the mean of the distribution.

    The continued fraction 1/(1 + d1/(1 + d2/(1 + ...))) is folded from the inside outwards.
    """

    def fold(acc, step):
        m = F.floor(step / 2)
        even = m * (b - m)
        odd = -(a + m) * (a + b + m)
        top = F.when(step % 2 == 0, even).otherwise(odd) * x
        return 1 + top / ((a + step - 1) * (a + step)) / acc

    fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(4 * _TERMS))), F.lit(1.0), fold)
    front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log1p(-x)
    return F.exp(front) / (a * fraction)


def f_tail(statistic: Column, dof1: Column, dof2: Column) -> Column:
    """P(X > statistic) for an F variable with the given degrees of freedom."""
    x = dof2 / (dof2 + dof1 * statistic)
    a, b = dof2 / 2, dof1 / 2
    swap = x > (a + 1) / (a + b + 2)
    part = _let(
        {
            "x": F.when(swap, 1 - x).otherwise(x),
            "a": F.when(swap, b).otherwise(a),
            "b": F.when(swap, a).otherwise(b),
        },
        lambda v: _beta_fraction(v["x"], v["a"], v["b"]),
    )
    inside = (statistic > 0) & (dof1 >= 1) & (dof2 >= 1)
    limit = chi2_tail(statistic * dof1, dof1)
    exact = F.when(swap, 1 - part).otherwise(part)
    return F.when(statistic == 0, 1.0).when(inside, F.when(dof2 >= _LARGE_DOF, limit).otherwise(exact))
