"""Draws, physics and vectors by hand."""

import math

import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ramify.functions import physics, rng, vector


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_uniform_is_the_same_in_python(spark):
    rows = spark.range(200).select("id", rng.uniform(F.lit(3), F.col("id"), F.lit("12"), "d0a").alias("u")).collect()
    assert all(r["u"] == rng.uniform_py(3, r["id"], "12", "d0a") for r in rows)


def test_draws_do_not_depend_on_partitions(spark):
    draw = lambda n: spark.range(500).repartition(n).select("id", rng.uniform(F.lit(1), F.col("id"), F.lit(""), "x").alias("u"))
    assert sorted(draw(1).collect()) == sorted(draw(7).collect())


def test_distributions(spark):
    u = lambda n: rng.uniform(F.lit(5), F.col("id"), F.lit(""), n)
    z, n = rng.normal(u("a"), u("b")), rng.integer(u("c"), 6, 14)
    r = spark.range(20000).select(z.alias("z"), n.alias("n")).agg(F.mean("z"), F.stddev("z"), F.min("n"), F.max("n"), F.mean("n")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03 and (r[2], r[3]) == (6, 14) and abs(r[4] - 10) < 0.1


def test_even_bifurcation(spark):
    d1, d2 = physics.daughters(F.lit(20.0), F.lit(3.0), F.lit(5.0), F.lit(False), F.lit(0.0))
    th1, th2 = physics.angles(d1, d2)
    got = spark.range(1).select(d1.alias("a"), d2.alias("b"), th1.alias("c"), th2.alias("d")).first()
    assert got["a"] == pytest.approx(20 / 2 ** (1 / 3)) and got["b"] == pytest.approx(got["a"])
    assert got["c"] == pytest.approx(37.4673, abs=1e-3) and got["d"] == pytest.approx(got["c"])


@settings(max_examples=25, deadline=None)
@given(st.floats(0.5, 50), st.floats(-3, 3))
def test_power_law_holds(d0, z):
    b = plain.bifurcation_py(d0, 3, 5.0, True, z)
    assert b["d1"] ** 3 + b["d2"] ** 3 == pytest.approx(d0**3) and 0 <= b["th1"] <= 180 and 0 <= b["th2"] <= 180


@pytest.mark.parametrize("v, want", [(12.3, 2.3), (0.3, 0.3), (7.5, 0.5), (123.0, 23.0)])
def test_tail(spark, v, want):
    assert value(spark, physics.tail(F.lit(-v))) == pytest.approx(want)


def test_rotations(spark):
    one = lambda v: tuple(F.lit(float(c)) for c in v)
    quarter = F.lit(math.pi / 2)
    cases = [(vector.roll(quarter, one((0, 0, 1))), (0, -1, 0)), (vector.pitch(quarter, one((0, 0, 1))), (1, 0, 0)), (vector.yaw(F.lit(90.0), one((1, 0, 0))), (0, 1, 0))]
    for got, want in cases:
        assert [value(spark, c) for c in got] == pytest.approx(want, abs=1e-12)
    assert [value(spark, c) for c in vector.normalise(one((0, 0, 0)), 5.0)] == [0, 0, 0]


def test_shell_itself_is_neither(spark):
    here, there = tuple(F.lit(0.0) for _ in range(3)), (F.lit(80.0), F.lit(0.0), F.lit(0.0))
    assert value(spark, vector.radial(here, there)) is False and value(spark, vector.radial(here, there, core=True)) is False
    assert value(spark, vector.sign_not_zero(F.lit(0))) == 1.0


def test_defaults_and_shares(spark):
    given_ = physics.with_defaults(k=F.lit(None).cast("int"))
    assert value(spark, given_["k"]) == 3 and value(spark, given_["epsilon"]) == 10.0
    with pytest.raises(ValueError):
        physics.share(F.lit(1.0), 12)
