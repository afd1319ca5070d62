"""Branching networks from parameters: a level-by-level frontier of stems, and the same trees as text.

A stem is five steps with turns between them; at its end a tree branches in two. The frontier carries
the state at each open branch's start (place, angles, diameter), so a level is a handful of projections
and one explode, whatever the number of networks. Every draw is keyed by network and path.

compat=True keeps what a text interpreter does with negative operands: their minus sign turns once more
by what is left of the number behind its first digit.
"""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics, rng
from ..functions.vector import step_direction
from ..lineage import checkpointed

START = (0.1, 0.1, 1.0)
#: Signs of the four turns inside a stem: angle 1, 2, 1, 2.
TURNS = {True: (1, -1, -1, 1), False: (-1, 1, 1, -1)}
PARAMS = ("network_id", "seed", "n", "d0", "k", "epsilon", "randmarg", "sigma", "stochparams")


#: The draws of one branch, in the order of the column u.
DRAWS = ("rule", "rho", "taper", "sa", "sb", "g0", "g1", "g2", "h0", "h1", "c0", "c1", "c2", "c3", "c4", "fa", "fb", "t1", "t2", "u1", "u2")


def _draws() -> Column:
    names = F.array(*[F.lit(n) for n in DRAWS])
    return F.transform(names, lambda name: rng.uniform(F.col("seed"), F.col("network_id"), F.col("path"), name))


def _draw(name: str) -> Column:
    return F.col("u")[DRAWS.index(name)]


def _normal(name: str) -> Column:
    return rng.normal(_draw(name + "a"), _draw(name + "b"))


def _extra(v: Column, compat: bool) -> Column:
    """The further turn of a negative operand."""
    return F.when(v < 0, physics.tail(v)).otherwise(F.lit(0.0)) if compat else F.lit(0.0)


def roots(params: DataFrame) -> DataFrame:
    """One open branch per network; networks without a positive diameter have none."""
    given = physics.with_defaults(**{c: F.col(c) for c in physics.DEFAULTS if c in params.columns})
    given = {c: v.cast("boolean" if c == "stochparams" else "double") for c, v in given.items()}
    start = dict(zip("xyz", START)) | {"alpha": 0.0, "beta": 0.0}
    rows = params.filter("d0 > 0").withColumns(given).select(*PARAMS, F.lit("").alias("path"), F.col("n").alias("left"), F.col("d0").alias("d"))
    return rows.withColumns({c: F.lit(v) for c, v in start.items()} | {"diam": F.col("d0")})


@functools.cache
def _growth(compat: bool, gateway) -> tuple[dict[str, Column], ...]:
    """Columns of a stem, each group of those before it: draws, fork, turns and widths, steps, and the state at its end.

    Columns name what they are made of and belong to no frame, so a level's are the next one's too, as long as Python
    talks to the same JVM (gateway).
    """
    d1, d2 = physics.daughters(F.col("d"), F.col("k"), F.col("sigma"), F.col("stochparams"), _normal("s"))
    th1, th2 = physics.angles(F.col("s1"), F.col("s2"))
    grown = F.array_sort(F.array(*[rng.between(_draw(f"g{i}"), 1.0, 1.5) for i in range(3)]))
    waned = F.sort_array(F.array(*[rng.between(_draw(f"h{i}"), 1.0, 1.5) for i in range(2)]), asc=False)
    factors = F.when(_draw("taper") < 0.1, F.concat(grown, waned)).otherwise(F.array(*[F.lit(1.0)] * 5))
    steps = []
    for i in range(5):
        wide = F.col("widths")[i]
        go = physics.share(physics.length(wide, F.col("epsilon"), F.col("randmarg"), _draw(f"c{i}")), 5)
        turn = F.col("turn1" if i % 2 == 0 else "turn2") if i < 4 else F.lit(0.0)
        side = F.when(_draw("rule") < 0.5, F.lit(float(TURNS[True][i % 4]))).otherwise(F.lit(float(TURNS[False][i % 4])))
        steps.append(F.struct(wide.alias("wide"), go.alias("go"), (side * turn - _extra(turn, compat)).alias("turn")))
    point = lambda x, y, z, d: F.struct(x.alias("x"), y.alias("y"), z.alias("z"), d.alias("diam"))

    def moved(s: Column, e: Column) -> Column:
        m = step_direction((s["x"], s["y"], s["z"]), e["go"], s["alpha"], F.col("beta"))
        x, y, z, diam = s["x"] + m[0], s["y"] + m[1], s["z"] + m[2], F.when(e["wide"] > 0, e["wide"]).otherwise(s["diam"])
        alpha = s["alpha"] - _extra(e["go"], compat) + e["turn"]
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), alpha.alias("alpha"), diam.alias("diam"), F.concat(s["p"], F.array(point(x, y, z, diam))).alias("p"))

    first = F.array(point(*(F.col(c) for c in ("x", "y", "z", "diam"))))
    start = F.struct(*(F.col(c) for c in ("x", "y", "z", "alpha", "diam")), first.alias("p"))
    return (
        {"u": _draws()},
        {"s1": d1, "s2": d2, "rho": rng.integer(_draw("rho"), -1, 1)},
        {"turn1": th1 * F.col("rho"), "turn2": th2 * F.abs("rho"), "widths": F.transform(factors, lambda f: f * F.col("d"))},
        {"steps": F.array(*steps)},
        {"end": F.aggregate("steps", start, moved)},
    )


def grow(frontier: DataFrame, compat: bool = True) -> DataFrame:
    """The open branches with their stem's points (p, the first being where the branch opens) and the state behind it.

    The five steps are a fold over an array: each step moves along the place that the one before reached.
    """
    now = frontier
    for columns in _growth(compat, frontier.sparkSession.sparkContext._gateway):
        now = now.withColumns(columns)
    return now.select(*PARAMS, "path", "left", "d", "u", "beta", *[F.col("end")[c].alias(c) for c in ("x", "y", "z", "alpha", "diam", "p")])


@functools.cache
def _fork(compat: bool, gateway) -> tuple[dict[str, Column], ...]:
    """Columns of a fork: its diameters and tilts, its angles, and the states in which its two branches open."""
    d1, d2 = physics.daughters(F.col("d"), F.col("k"), F.col("sigma"), F.col("stochparams"), _normal("f"))
    tilt = {f"tilt{i}": rng.between(_draw(f"t{i}"), 22.5, 27.5) * rng.integer(_draw(f"u{i}"), -1, 1) for i in (1, 2)}
    th1, th2 = physics.angles(F.col("f1"), F.col("f2"))
    sides = [
        F.struct(F.lit(str(i)).alias("step"), F.col(f"f{i}").alias("d"), (F.col("alpha") + F.col(f"th{i}") * (1 if i == 1 else -1) - _extra(F.col(f"tilt{i}"), compat)).alias("alpha"), (F.col("beta") + F.col(f"tilt{i}")).alias("beta"))
        for i in (1, 2)
    ]
    return {"f1": d1, "f2": d2} | tilt, {"th1": th1, "th2": th2}, {"sides": F.array(*sides)}


def forked(grown: DataFrame, compat: bool = True) -> DataFrame:
    """Stems with sides: the states in which their two branches open."""
    now = grown
    for columns in _fork(compat, grown.sparkSession.sparkContext._gateway):
        now = now.withColumns(columns)
    return now.select(*PARAMS, "path", "left", "d", "x", "y", "z", "diam", "p", "sides")


def opened(stems: DataFrame) -> DataFrame:
    """The two open branches behind each stem."""
    now = stems.withColumn("side", F.explode("sides"))
    return now.select(*PARAMS, F.concat("path", "side.step").alias("path"), (F.col("left") - 1).alias("left"), F.col("side.d").alias("d"), "x", "y", "z", F.col("side.alpha").alias("alpha"), F.col("side.beta").alias("beta"), "diam")


#: Open branches up to which a level may sit in any number of tasks, and those that a task gets where there are many.
FEW, PER_TASK = 16, 4096


def open_branches(params: DataFrame) -> list[int]:
    """How many open branches with a stem the networks have together at each level; a row for each kind of n is collected."""
    kinds = [(r["n"], r["count"]) for r in params.filter("d0 > 0 and n >= 3").groupBy("n").count().collect()]
    return [sum(number << level for n, number in kinds if n - 2 > level) for level in range(max((n - 2 for n, _ in kinds), default=0))]


def path_number(path: Column) -> Column:
    """A path's place among those of its length: its steps 1 and 2 as binary digits."""
    return F.coalesce(F.conv(F.translate(path, "12", "01"), 2, 10).cast("long"), F.lit(0).cast("long"))


def dealt(frontier: DataFrame, tasks: int) -> DataFrame:
    """Open branches over this many tasks; a network's lie in as many as it has branches, or in all, evenly."""
    place = F.pmod(F.xxhash64("network_id") % F.lit(1 << 32) + path_number(F.col("path")), F.lit(tasks))
    return frontier.repartitionById(tasks, place.cast("int"))


def stems(params: DataFrame, depth: int | None = None, compat: bool = True) -> DataFrame:
    """network_id, path, level, left, d and p (six points) of every stem: windows of the network's polyline.

    The number of levels is the largest n of params; depth, where given, must be that or more. A level is computed once
    and kept, so a plan never holds two. How many branches a level has is known beforehand: the frontier is dealt anew
    where it has outgrown its tasks, which are at least as many as run at once.
    """
    spark = params.sparkSession
    number = open_branches(params)
    if depth is not None and depth < len(number) + 2:
        raise ValueError(f"networks of {len(number) + 2} levels are deeper than {depth}")
    frontier, found, tasks = roots(params).filter("left >= 3"), [], 0
    for level, branches in enumerate(number or [0]):
        want = min(branches, max(spark.sparkContext.defaultParallelism, branches // PER_TASK))
        if branches > FEW and tasks < want:
            tasks = want
            frontier = dealt(frontier, tasks)
        grown = checkpointed(forked(grow(frontier, compat), compat))
        found.append(grown.select("network_id", "path", F.lit(level).alias("level"), "left", "d", "p"))
        frontier = opened(grown).filter("left >= 3")
    return reduce(DataFrame.unionByName, found)


def tree(params: DataFrame) -> DataFrame:
    """network_id, level and path of every stem, without its geometry: a network of n levels has 2^level at each level up
    to n - 3."""
    levels = params.filter("d0 > 0 and n >= 3").select("network_id", F.explode(F.sequence(F.lit(0), F.col("n") - 3)).alias("level"))
    most = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1
    places = levels.select("network_id", "level", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("place"))
    steps = F.translate(F.lpad(F.bin("place"), F.col("level"), F.lit("0")), "01", "12")
    return places.select("network_id", "level", F.when(F.col("level") == 0, F.lit("")).otherwise(steps).alias("path"))


def stem_windows(found: DataFrame) -> DataFrame:
    """Stems as windows: network_id, run (the path), window 0, pos and the point."""
    rows = found.select("network_id", F.col("path").alias("run"), F.lit(0).cast("long").alias("window"), F.posexplode("p").alias("pos", "at"))
    return rows.select("network_id", "run", "window", "pos", "at.x", "at.y", "at.z", "at.diam")
