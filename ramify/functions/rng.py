"""Counter-based random draws: a draw is a function of its key, whatever the partitioning.

u = (first 48 bits of md5("seed|network|path|draw")) / 2**48. The same text in Python gives the same number.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = float(1 << 48)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform(seed, network, path, draw) -> Column:
    """Uniform on [0, 1)."""
    return keyed(F.concat_ws("|", *[_col(x).cast("string") for x in (seed, network, path, draw)]))


def keyed(key: Column) -> Column:
    """The draw whose key is this text."""
    key = F.md5(key)
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(_UNIT)


def between(u: Column, low, high) -> Column:
    return _col(low) + u * (_col(high) - _col(low))


def integer(u: Column, low: int, high: int) -> Column:
    """Uniform whole number in [low, high]."""
    return (F.floor(u * F.lit(float(high - low + 1))) + F.lit(low)).cast("int")


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def uniform_py(seed, network, path, draw: str) -> float:
    """The same draw in Python."""
    return int(hashlib.md5(f"{seed}|{network}|{path}|{draw}".encode()).hexdigest()[:12], 16) / _UNIT


def normal_py(u1: float, u2: float) -> float:
    return math.sqrt(-2.0 * math.log(1.0 - u1)) * math.cos(2.0 * math.pi * u2)


def uniform_sql(*key: str) -> str:
    """The same draw in DuckDB's SQL; key: SQL expressions of text."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 12)) AS BIGINT) / {_UNIT})"


def normal_sql(u1: str, u2: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * math.pi!r} * {u2}))"
