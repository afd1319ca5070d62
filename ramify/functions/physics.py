"""Branch diameters, angles and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rng

#: The names of the five properties and their defaults.
DEFAULTS = {"k": 3, "epsilon": 10.0, "randmarg": 3.0, "sigma": 5, "stochparams": True}


def with_defaults(**columns: Column) -> dict[str, Column]:
    """The five properties as columns, with the defaults where a column is missing or null."""
    return {k: F.coalesce(columns[k], F.lit(v)) if k in columns else F.lit(v) for k, v in DEFAULTS.items()}


def first_daughter(d0: Column, k: Column, sigma: Column, stochastic: Column, z: Column) -> Column:
    """Diameter of the first daughter, near the optimum (z: a standard normal draw)."""
    best = d0 / F.pow(F.lit(2.0), F.lit(1.0) / k)
    d1 = F.when(stochastic, F.abs(best + best / sigma * z)).otherwise(best)
    return F.when(d1 >= d0, best).otherwise(d1)


def second_daughter(d0: Column, d1: Column, k: Column) -> Column:
    """Diameter of the second daughter, by the power law."""
    return F.pow(F.pow(d0, k) - F.pow(d1, k), F.lit(1.0) / k)


def daughters(d0: Column, k: Column, sigma: Column, stochastic: Column, z: Column) -> tuple[Column, Column]:
    """Diameters of the two daughters: d1 near the optimum (z: a standard normal draw), d2 by the power law."""
    d1 = first_daughter(d0, k, sigma, stochastic, z)
    return d1, second_daughter(d0, d1, k)


def angles(d1: Column, d2: Column) -> tuple[Column, Column]:
    """Branching angles in degrees; cosines are kept within [-1, 1]."""
    a = d2 / d1
    s = F.lit(1.0) + a * a * a
    root, full, four = F.pow(s, F.lit(2.0 / 3)), F.pow(s, F.lit(4.0 / 3)), F.pow(a, F.lit(4.0))
    inside = lambda c: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
    return inside((full + 1.0 - four) / (root * 2.0)), inside((full + four - 1.0) / (a * a * 2.0 * root))


def length(d0: Column, epsilon: Column, margin: Column, u: Column) -> Column:
    """Uniform about d0 * epsilon; may be negative for thin branches."""
    return rng.between(u, d0 * epsilon - margin, d0 * epsilon + margin)


def share(co: Column, parts: int) -> Column:
    """An equal part of a length; parts is one digit."""
    if not 1 <= parts <= 9:
        raise ValueError("parts must be 1 to 9")
    return co / F.lit(float(parts))


def tail(v: Column) -> Column:
    """What is left of |v| in writing when its first digit is skipped."""
    v = F.abs(v)
    return F.when(v < 1, v).otherwise(v - F.floor(v / F.pow(F.lit(10.0), F.floor(F.log10(v)))) * F.pow(F.lit(10.0), F.floor(F.log10(v))))
