"""Vectors as triples of columns, rotations in degrees unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def magnitude(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def normalise(v: Vector, scale: Column | float = 1.0) -> Vector:
    """v brought to length `scale`; the zero vector stays."""
    m, s = magnitude(v), scale if isinstance(scale, Column) else F.lit(scale)
    return tuple(F.when(m == 0, c).otherwise(c * s / m) for c in v)


def roll(angle: Column, v: Vector) -> Vector:
    """About x; radians."""
    c, s = F.cos(angle), F.sin(angle)
    return v[0], c * v[1] - s * v[2], s * v[1] + c * v[2]


def pitch(angle: Column, v: Vector) -> Vector:
    """About y; radians."""
    c, s = F.cos(angle), F.sin(angle)
    return c * v[0] + s * v[2], v[1], c * v[2] - s * v[0]


def yaw(angle_degrees: Column, v: Vector) -> Vector:
    """About z; degrees."""
    a = F.radians(angle_degrees)
    c, s = F.cos(a), F.sin(a)
    return c * v[0] - s * v[1], s * v[0] + c * v[1], v[2]


def rotate(pitch_angle: Column, roll_angle: Column, yaw_angle: Column, v: Vector) -> Vector:
    """Roll, then pitch (radians both), then yaw (degrees)."""
    return yaw(yaw_angle, pitch(pitch_angle, roll(roll_angle, v)))


def distance(a: Vector, b: Vector) -> Column:
    return magnitude((a[0] - b[0], a[1] - b[1], a[2] - b[2]))


def radial(origin: Vector, place: Vector, shell: Column | float = 80.0, core: bool = False) -> Column:
    """Whether place lies within the shell about origin (core: beyond it); the shell itself is neither."""
    d, s = distance(origin, place), shell if isinstance(shell, Column) else F.lit(shell)
    return d > s if core else d < s


def sign_not_zero(v: Column) -> Column:
    """1.0 for v >= 0, else -1.0."""
    return F.when(v >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def step_direction(v: Vector, length: Column, alpha: Column, beta: Column) -> Vector:
    """The turtle's step: the place vector at the step's length, rolled by alpha and pitched by beta (degrees)."""
    return pitch(F.radians(beta), roll(F.radians(alpha), normalise(v, length)))
