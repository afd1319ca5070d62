"""Sparse volumes as bricks of 4 x 4 x 4 voxels: 64 bits each, in the order of a Morton code, in files by cell.

A cell is a cube of SIDE voxels and a folder of the table, so a box is read from the folders of the cells that it touches.
Folders are as many as cells and files at most PARTS a folder, whatever the number of networks; in a file networks are in order.
Bit (z mod 4) + 4 (x mod 4) + 16 (y mod 4) of a brick is a voxel.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .voxel import bit_rows

SIDE = 64
#: Cells of a box that are named one by one; of larger ones the range of their codes is read.
CELLS = 4096
#: Parts of a cell's networks that tasks write, as a file each at most.
PARTS = 64
#: Steps and masks that put two empty places behind each of 21 bits.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _shift(c: Column, k: int) -> Column:
    return F.call_function("shiftleft", c, F.lit(k))


def _spread(c: Column) -> Column:
    c = c.cast("long")
    for step, mask in _SPREAD:
        c = c.bitwiseOR(_shift(c, step)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column) -> Column:
    """The bits of three whole numbers (0 to 2^21 - 1) by turns, x's lowest first."""
    return _spread(x).bitwiseOR(_shift(_spread(y), 1)).bitwiseOR(_shift(_spread(z), 2))


def morton_py(x: int, y: int, z: int) -> int:
    return sum((v >> k & 1) << (3 * k + i) for i, v in enumerate((x, y, z)) for k in range(21))


def _together(c: Column) -> Column:
    """Every third bit of a code, from its lowest on."""
    c = c.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (step, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0x1FFFFF]):
        c = c.bitwiseOR(F.call_function("shiftright", c, F.lit(step))).bitwiseAND(F.lit(mask))
    return c


def bricks(lines: DataFrame) -> DataFrame:
    """network_id, brick (code) and bits of lines along z (network_id, x, y, word, bits), as voxel.lines gives them."""
    # Rows, not lambdas: these are generated code.
    part = F.call_function("shiftrightunsigned", F.col("bits"), F.col("k") * 4).bitwiseAND(F.lit(15))
    fours = lines.select("network_id", "x", "y", "word", "bits", F.explode(F.array(*[F.lit(k) for k in range(16)])).alias("k"))
    fours = fours.withColumn("four", part).filter("four != 0")
    four = lambda c: F.floor(c / 4)
    code = morton(four(F.col("x")), four(F.col("y")), F.col("word") * 16 + F.col("k"))
    bits = F.call_function("shiftleft", F.col("four"), (F.pmod("x", F.lit(4)) * 4 + F.pmod("y", F.lit(4)) * 16).cast("int"))
    return fours.select("network_id", code.alias("brick"), bits.alias("bits")).groupBy("network_id", "brick").agg(F.bit_or("bits").alias("bits"))


def voxels(found: DataFrame) -> DataFrame:
    """network_id, x, y, z of bricks."""
    low = {"x": _together(F.col("brick")), "y": _together(F.call_function("shiftright", F.col("brick"), F.lit(1))), "z": _together(F.call_function("shiftright", F.col("brick"), F.lit(2)))}
    rows = bit_rows(found.select("network_id", *[(v * 4).alias(c) for c, v in low.items()], "bits"))
    k = F.col("k")
    return rows.select("network_id", (F.col("x") + F.floor(k / 4) % 4).alias("x"), (F.col("y") + F.floor(k / 16)).alias("y"), (F.col("z") + k % 4).alias("z"))


def _levels(side: int) -> int:
    if side < 4 or side & (side - 1):
        raise ValueError("a cell's side is a power of two, 4 or more")
    return side.bit_length() - 3


def write_bricks(found: DataFrame, path: str, side: int = SIDE, mode: str = "overwrite") -> None:
    """Bricks as Parquet, in a folder for each cell, in each file by network and code. They are dealt by cell and part of the
    networks: for ranges Spark would make all bricks once more, to find the limits."""
    cell = F.call_function("shiftright", F.col("brick"), F.lit(3 * _levels(side)))
    part = F.pmod(F.xxhash64("network_id"), F.lit(PARTS))
    rows = found.withColumn("cell", cell).repartition("cell", part).sortWithinPartitions("cell", "network_id", "brick")
    rows.write.mode(mode).partitionBy("cell").parquet(path)


def read_box(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int], side: int = SIDE, networks: list[int] | None = None) -> DataFrame:
    """Bricks of the written table that a box (low and high included) touches; only files of its cells are read,
    and of these, where networks are named, the row groups that can hold them."""
    rows = spark.read.schema("network_id long, brick long, bits long, cell long").parquet(path)
    if networks is not None:
        rows = rows.filter(F.col("network_id").isin(networks))
    spans = [range(a // side, b // side + 1) for a, b in zip(low, high)]
    if all(len(s) for s in spans):
        corner = [morton_py(*(s[k] for s in spans)) for k in (0, -1)]
        some = len(spans[0]) * len(spans[1]) * len(spans[2]) <= CELLS
        rows = rows.filter(F.col("cell").isin([morton_py(*c) for c in itertools.product(*spans)]) if some else F.col("cell").between(*corner))
        # A code grows with each of its coordinates, so a box's bricks lie between those of its corners.
        near = [morton_py(*(v // 4 for v in at)) for at in (low, high)]
        return rows.filter(F.col("brick").between(*near)).select("network_id", "brick", "bits")
    return rows.filter(F.lit(False)).select("network_id", "brick", "bits")


def box(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int], side: int = SIDE, networks: list[int] | None = None) -> DataFrame:
    """network_id, x, y, z of the written voxels in a box."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high):
        inside = inside & F.col(c).between(a, b)
    return voxels(read_box(spark, path, low, high, side, networks)).filter(inside)
