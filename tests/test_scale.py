"""Long sequences, many origins, far dilation, bricks and the frontier: against plain loops, and how work is dealt."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.operators import bricks, image, paths, scan, spatial, voxel
from ramify.plans import grammar
from ramify.sources import reports

# --- the frontier


@pytest.mark.parametrize("levels", [[14, 14], [6, 7, 8] * 333, [9]])
def test_frontier_is_dealt(spark, levels):
    params = spark.createDataFrame([(i, 1, n, 20.0) for i, n in enumerate(levels)], "network_id long, seed long, n int, d0 double")
    found = grammar.stems(params)
    cores = spark.sparkContext.defaultParallelism
    rows = found.groupBy("level", F.spark_partition_id().alias("task")).count().collect()
    for level in {r["level"] for r in rows}:
        sizes = [r["count"] for r in rows if r["level"] == level]
        if sum(sizes) > grammar.FEW:
            assert len(sizes) >= cores and max(sizes) <= 2 * sum(sizes) / cores
    assert sum(r["count"] for r in rows) == sum(2 ** (n - 2) - 1 for n in levels)
    tree = grammar.tree(params)
    same = found.select("network_id", "level", "path")
    assert tree.exceptAll(same).count() == 0 and same.exceptAll(tree).count() == 0


def test_tree_of_small_networks(spark):
    params = spark.createDataFrame([(1, 2, 20.0), (2, 3, 20.0), (3, 5, -1.0), (4, 4, 1.0)], "network_id long, n int, d0 double")
    assert sorted(map(tuple, grammar.tree(params).collect())) == [(2, 0, ""), (4, 0, ""), (4, 1, "1"), (4, 1, "2")]


# --- long sequences


def walk(n, seed=1, gaps=0.01):
    draw = random.Random(seed)
    return [(1, 3 * k + draw.randint(0, 2), None if draw.random() < gaps else float(draw.randint(0, 30)), float(k % 7)) for k in range(n)]


def polyline(spark, rows):
    nan = F.lit(float("nan"))
    frame = spark.createDataFrame(rows, "network_id long, seq long, x double, z double")
    return frame.select("network_id", "seq", F.coalesce("x", nan).alias("x"), F.lit(0.0).alias("y"), "z", F.lit(1.0).alias("diam"))


def plain_runs(rows):
    out, run, last = [], 0, max(r[1] for r in rows)
    for _, seq, x, z in sorted(rows):
        if x is None:
            run += seq < last
        else:
            out.append((seq, run))
    return [r for r in out if r[1] < run]


@pytest.mark.parametrize("block", [5, 64, 1 << 16])
@pytest.mark.parametrize("rows", [walk(700), walk(700, 2, 0.5), [(1, 5, None, 0.0)], [(1, 5, 1.0, 0.0), (1, 9, None, 0.0)], [(1, 5, 1.0, 0.0), (1, 9, None, 0.0), (1, 10, 1.0, 0.0)]])
def test_gap_segments_in_blocks(spark, rows, block):
    got = paths.gap_segments(polyline(spark, rows), block).select("seq", "run").collect()
    assert sorted(map(tuple, got)) == plain_runs(rows)


def test_windows_in_blocks(spark):
    rows = [(1, k, float(k), 0.0) for k in range(1, 500)] + [(1, 1000, None, 0.0), (1, 1001, 1.0, 0.0)]
    runs = paths.gap_segments(polyline(spark, rows))
    few, many = (sorted(map(tuple, paths.windows(runs, block=b).collect())) for b in (7, 1 << 16))
    assert few == many and len(few) == 6 * 99


def test_long_polyline_uses_all_tasks(spark):
    n = 1_500_000
    at = spark.range(n).select(F.lit(1).cast("long").alias("network_id"), F.col("id").alias("seq"), F.when(F.col("id") % 1000 == 999, F.lit(float("nan"))).otherwise((F.col("id") % 97).cast("double")).alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 1.0).alias("z"), F.lit(1.0).alias("diam"))
    runs = paths.gap_segments(at, 1 << 14)
    # Numbers this regular take so few bytes that Spark would gather them in one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = runs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(t["count"] for t in tasks) == 999 * (n // 1000 - 1) and len(tasks) >= spark.sparkContext.defaultParallelism
    assert max(t["count"] for t in tasks) < 0.5 * n


def test_next_rows_in_blocks(spark):
    rows = [(i % 3 if i % 5 else None, i * 2, float(i), float(-i)) for i in range(200)]
    frame = polyline(spark, rows)
    few, many = (sorted(map(tuple, reports.plot_segments(frame, block=b).collect()), key=repr) for b in (3, 1 << 16))
    assert few == many and len(few) == 200 - 4
    got = scan.running(frame, ["network_id"], "seq", {"upto": F.lit(1)}, {"n": F.lit(1)}, {"end": F.col("z")}, 7).collect()
    for r in got:
        own = sorted((s, z) for i, s, _, z in rows if i == r["network_id"])
        assert (r["upto"], r["n"], r["end"]) == (sum(s <= r["seq"] for s, _ in own), len(own), own[-1][1])


# --- many origins


@pytest.mark.parametrize("per_cell", [3, 1 << 16])
def test_places_within_shells(spark, per_cell):
    draw = random.Random(5)
    spot = lambda: tuple(round(draw.uniform(-9, 9), 3) for _ in range(3))
    places = [(i, *spot()) for i in range(300)] + [(1000 + i, 1.0, 1.0, 1.0) for i in range(200)] + [(2000, None, 0.0, 0.0), (2001, float("nan"), 0.0, 0.0)]
    origins = [(i, *spot()) for i in range(40)] + [(100, 1.0, 1.0, 1.0), (101, 4.0, 1.0, 1.0), (102, None, 1.0, 1.0)]
    left = spark.createDataFrame(places, "id long, x double, y double, z double")
    right = spark.createDataFrame(origins, "o long, ox double, oy double, oz double")
    real = lambda rows: [r for r in rows if all(v is not None and v == v for v in r[1:])]
    far = {(p[0], o[0]): math.dist(p[1:], o[1:]) for p in real(places) for o in real(origins)}
    pairs = spatial.within(left, right, 3.0, per_cell=per_cell)
    assert sorted((r["id"], r["o"]) for r in pairs.collect()) == sorted(k for k, d in far.items() if d < 3.0)
    rim = spatial.within(left, right, 3.0, 1.5, per_cell)
    assert sorted((r["id"], r["o"]) for r in rim.collect()) == sorted(k for k, d in far.items() if 1.5 < d < 3.0)
    assert "NestedLoop" not in pairs._sc._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")


# --- dilation


@pytest.mark.parametrize("thresh, shape", [(1, (3, 4, 5)), (2, (5, 5, 5)), (4, (70, 6, 5)), (10, (130, 9, 8)), (70, (150, 3, 2))])
def test_dilation(spark, thresh, shape):
    draw = np.random.default_rng(thresh)
    volume = (draw.random(shape) < 0.01).astype(float)
    volume[0, 0, 0], volume[-1, -1, -1] = 1, 0
    rows = [(7, *map(int, i), float(volume[i])) for i in np.ndindex(*shape)]
    got = image.wrap(spark.createDataFrame(rows, "volume_id long, z int, y int, x int, value double"), thresh, "dilate").collect()
    ones = np.argwhere(volume == 1)
    want = volume.copy()
    for i in np.ndindex(*shape):
        if volume[i] == 0 and (((ones - i) ** 2).sum(axis=1) < thresh * thresh).any():
            want[i] = 127
    assert len(got) == volume.size and all(want[r["z"], r["y"], r["x"]] == r["value"] for r in got)


# --- bricks


def test_bricks_and_boxes(spark, tmp_path):
    draw = random.Random(3)
    voxels = sorted({(n, draw.randint(0, 99), draw.randint(0, 70), draw.randint(0, 130)) for n in (1, 2) for _ in range(3000)})
    frame = spark.createDataFrame(voxels, "network_id long, x long, y long, z long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("z") % 64).cast("int"))
    lines = frame.groupBy("network_id", "x", "y", F.floor(F.col("z") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    assert {r["network_id"]: r["n"] for r in voxel.counts(lines).collect()} == {n: sum(v[0] == n for v in voxels) for n in (1, 2)}
    assert sorted(map(tuple, voxel.line_voxels(lines).collect())) == voxels
    found = bricks.bricks(lines)
    assert sorted(map(tuple, bricks.voxels(found).collect())) == voxels
    path = str(tmp_path / "bricks")
    bricks.write_bricks(found, path, 32)
    low, high = (10, 33, 60), (40, 62, 64)
    want = [v for v in voxels if all(a <= c <= b for a, c, b in zip(low, v[1:], high))]
    assert want and sorted(map(tuple, bricks.box(spark, path, low, high, 32).collect())) == want
    assert sorted(map(tuple, bricks.box(spark, path, low, high, 32, [2]).collect())) == [v for v in want if v[0] == 2]
    assert bricks.box(spark, path, (5, 5, 5), (4, 9, 9), 32).count() == 0

    def files(rows):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        return scan.metrics().apply("numFiles").value()

    cells = len({tuple(c // 32 for c in (x, y, z)) for x in (low[0], high[0]) for y in (low[1], high[1]) for z in (low[2], high[2])})
    assert files(bricks.read_box(spark, path, low, high, 32)) <= 2 * cells < files(spark.read.parquet(path))
    assert files(bricks.read_box(spark, path, low, high, 32, [1])) <= cells


def test_bricks_by_ranges_of_cells(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(1, x, 5, 0, 1 << 9) for x in range(0, 200, 3)], "network_id long, x long, y long, word long, bits long")
    path = str(tmp_path / "bricks")
    bricks.write_bricks(bricks.bricks(lines), path, 4)
    monkeypatch.setattr(bricks, "CELLS", 2)
    assert sorted(r["x"] for r in bricks.box(spark, path, (10, 0, 0), (100, 9, 9), 4).collect()) == list(range(12, 101, 3))


def test_morton_codes(spark):
    rows = [(0, 0, 0), (1, 2, 3), ((1 << 21) - 1, 0, 5), (12345, 99999, 777)]
    frame = spark.createDataFrame(rows, "x long, y long, z long").select("x", "y", "z", bricks.morton(F.col("x"), F.col("y"), F.col("z")).alias("m"))
    for r in frame.collect():
        assert r["m"] == bricks.morton_py(r["x"], r["y"], r["z"])


# --- curves and resizing


def test_curves_of_any_size(spark):
    draw = random.Random(8)
    runs = {n: [tuple(draw.uniform(-5, 5) for _ in range(4)) for _ in range(n)] for n in range(1, 12)}
    rows = [(n, 0, 0, i, *p) for n, points in runs.items() for i, p in enumerate(points)]
    got = paths.bezier(spark.createDataFrame(rows, "network_id long, run long, window long, pos int, x double, y double, z double, diam double")).collect()
    assert len(got) == 110
    for r in got:
        points, t, m = runs[r["network_id"]], r["step"] / 9, r["network_id"] - 1
        for c, name in enumerate(paths.POINT):
            assert r[name] == pytest.approx(sum(math.comb(m, i) * (1 - t) ** (m - i) * t**i * p[c] for i, p in enumerate(points)), abs=1e-9)
    assert paths.bezier(spark.createDataFrame(rows, "network_id long, run long, window long, pos int, x double, y double, z double, diam double"), size=6).count() == 10


def neighbours(values, m):
    """One axis of an area resize that is not by overlap."""
    n, out = len(values), []
    for d in range(m):
        s = d * n // m
        part = (d + 1) - (s + 1) * m / n
        part = 0.0 if part <= 0 or s >= n - 1 else part - math.floor(part)
        out.append((1 - part) * values[s] + part * values[min(s + 1, n - 1)])
    return np.array(out)


@pytest.mark.parametrize("target", [(6, 8, 8), (4, 8, 3), (9, 5, 5), (5, 10, 2)])
def test_enlarging(spark, target):
    source = (4, 5, 5)
    volume = np.random.default_rng(2).random(source) * 0.12
    rows = [(1, *map(int, i), float(volume[i])) for i in np.ndindex(*source)]
    got = image.resize_area(spark.createDataFrame(rows, "volume_id long, z int, y int, x int, value double"), source, target).collect()
    high = lambda v: np.where(v > 0.1, 1.0, v)
    plane = volume
    if target[1:] != source[1:]:
        plane = np.apply_along_axis(neighbours, 1, np.apply_along_axis(neighbours, 2, volume, target[2]), target[1])
    want = np.apply_along_axis(neighbours, 0, high(plane), target[0]) if target[0] != 4 else high(plane)
    assert len(got) == np.prod(target)
    for r in got:
        assert r["value"] == pytest.approx(high(want)[r["z"], r["y"], r["x"]], abs=1e-9)
