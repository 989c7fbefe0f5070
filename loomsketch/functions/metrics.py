"""Set metrics over n shared codes of sketches of x and y codes, and what follows from them.

Where a metric is undefined (two empty sketches) it is null. A metric of 0 has distance 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

JACCARD, CONTAINMENT = 0, 1


def chance_overlap(n: Column, x: Column, y: Column, length: int, reduced: int) -> Column:
    """How many of the shared codes chance alone explains; 0 where neither sketch has codes of its own."""
    p = 4.0 ** -(length - reduced)
    px, py = (1 - F.pow(F.lit(1 - p), (z - n).cast("double")) for z in (x, y))
    below = px + py - 2 * px * py
    return F.when(below > 0, px * py * (x + y - 2 * n) / F.when(below > 0, below)).otherwise(F.lit(0.0))


def denominator(n: Column, x: Column, y: Column, metric: int) -> Column:
    return F.least(x, y) if metric == CONTAINMENT else x + y - n


def set_metric(n: Column, x: Column, y: Column, metric: int, rs: Column | None = None) -> Column:
    below = denominator(n, x, y, metric)
    above = n.cast("double") if rs is None else n - rs
    return F.when(below > 0, above / F.when(below > 0, below))


def distance(m: Column, metric: int, length: int, cap: bool = True) -> Column:
    """Mash distance of a Jaccard index, AAF distance of a containment."""
    inside = 1 / m if metric == CONTAINMENT else 1 / (2 * m) + 0.5
    d = F.when(m > 0, F.log(F.when(m > 0, inside)) / length)
    return F.when(m == 0, F.lit(1.0)).otherwise(F.least(d, F.lit(1.0))) if cap else d


def least_jaccard(most: float, length: int) -> float:
    """The Jaccard index at which the Mash distance is `most`; 0 where every pair is as near as that."""
    return 1 / (2 * math.exp(most * length) - 1) if most < 1 else 0.0


def deviation(m: Column, below: Column) -> Column:
    return F.when((m >= 0) & (m <= 1) & (below > 0), F.sqrt(m * (1 - m) / F.when(below > 0, below)))


# Coefficients of the published Chebyshev fit to erfc, lowest power first; its relative error is below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution for z of 0 or more, for which Spark has no function."""
    x = z * math.sqrt(0.5)
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = F.lit(c) + t * power
    return t * F.exp(power - x * x) / 2


def p_value(m: Column, sd: Column) -> Column:
    """Null for a metric of 0, 0 for a metric of 1."""
    return F.when(sd > 0, upper_tail(F.when(sd > 0, m / F.when(sd > 0, sd)))).when(m == 1, F.lit(0.0))
