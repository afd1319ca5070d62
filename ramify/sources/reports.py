"""Text and plot views of coordinate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan


def coordinate_text(x: Column, y: Column, z: Column) -> Column:
    """(x, y, z) with two decimals, or <gap>."""
    return F.when(F.isnan(x), F.lit("<gap>")).otherwise(F.format_string("(%.2f, %.2f, %.2f)", x, y, z))


def plot_segments(points: DataFrame, widths: bool = True, block: int = scan.SIZE) -> DataFrame:
    """Consecutive points of a network as lines x0..z1 with a line width (half the diameter, or 1)."""
    rows = scan.ahead(points, ["network_id"], "seq", ["x", "y", "z"], "__ahead", block)
    joined = rows.select("network_id", "seq", *[F.col(c).alias(f"{c}0") for c in "xyz"], *[F.col(f"__ahead.{c}").alias(f"{c}1") for c in "xyz"], (F.col("diam") * 0.5 if widths else F.lit(1.0)).alias("width"))
    return joined.filter(F.col("x1").isNotNull() & ~F.isnan("x0") & ~F.isnan("x1"))


#: Fixed value: the pattern of a stack's file name.
NAME = "Lnet_i%d_%d.tiff"


def output_name(n: Column, index: Column) -> Column:
    """The file name of a network's stack."""
    return F.format_string(NAME, n, index)


def progress(index: Column, n: Column) -> Column:
    """One line of progress per network."""
    return F.format_string("network %d with %d levels", index, n)
