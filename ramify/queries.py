"""Every operator applied to the whole driver tables, and the same in SQL.

Inputs are made from the tables by plain projections: diameters and vectors from lineitem, polylines with
gaps from events, short segments from lineitem, volumes from part, parameters from supplier.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import physics, rng, vector
from .lineage import scratch
from .operators import bricks, image, paths, spatial, voxel
from .operators.turtle import turtle
from .plans import grammar, network, texts
from .sources import params, reports, tiff
from .sources import volumes as volumes_of

TISSUE = (64, 64, 32)
LINE = ("l_orderkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs --------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*LINE, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_tax") * 10.0 + 1.0).alias("z"), (F.col("l_quantity") * 7.0).alias("angle"))


_VECTORS = "SELECT l_orderkey, l_linenumber, l_quantity x, l_extendedprice / 1000.0::DOUBLE y, l_tax * 10.0::DOUBLE + 1.0::DOUBLE z, l_quantity * 7.0::DOUBLE angle FROM lineitem"


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters with a key for their draws."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*LINE, F.col("l_quantity").alias("d0"), F.lit(7).alias("seed"), F.col("l_orderkey").alias("network_id"), F.col("l_linenumber").cast("string").alias("path"))


def _u(name: str) -> str:
    return rng.uniform_sql("'7'", "CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)", f"'{name}'")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline per user; errors are gaps."""
    rows = table(spark, sf_dir, "events")
    gap = F.col("event_type") == "error"
    at = lambda c: F.when(gap, F.lit(float("nan"))).otherwise(c.cast("double"))
    return rows.select(F.col("user_id").alias("network_id"), F.col("event_id").alias("seq"), at(F.floor(F.col("value"))).alias("x"), at(F.col("event_id") % 7).alias("y"), at(F.col("event_id") % 5).alias("z"), at(F.col("event_id") % 3 + 1).alias("diam"))


_POINTS = """points AS (SELECT user_id network_id, event_id seq, event_type = 'error' gap, floor(value)::DOUBLE x, (event_id % 7)::DOUBLE y,
 (event_id % 5)::DOUBLE z, (event_id % 3 + 1)::DOUBLE diam FROM events)"""
_RUNS = _POINTS + """, marked AS (SELECT *, sum(gap::INT) OVER (PARTITION BY network_id ORDER BY seq)::BIGINT run, max(seq) OVER (PARTITION BY network_id) last FROM points),
 closed AS (SELECT *, max(CASE WHEN gap AND seq < last THEN run END) OVER (PARTITION BY network_id) upto FROM marked),
 runs AS (SELECT network_id, seq, x, y, z, diam, run FROM closed WHERE NOT gap AND run < upto)"""
_FIRST = _RUNS + ", firsts AS (SELECT network_id, run, min(seq) seq, x, y, z, diam FROM runs GROUP BY network_id, run, x, y, z, diam)"
_WINDOWS = _FIRST + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY network_id, run ORDER BY seq) - 1 i, count(*) OVER (PARTITION BY network_id, run) n FROM firsts),
 windows AS (SELECT network_id, run, w AS win, CAST(i - 5 * w AS INT) pos, x, y, z, diam FROM (SELECT *, unnest(list_distinct([i // 5, CASE WHEN i % 5 = 0 THEN i // 5 - 1 ELSE i // 5 END])) w FROM ranked)
 WHERE w >= 0 AND w < (n - 1) // 5)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.windows(paths.distinct_first(paths.gap_segments(polylines(spark, sf_dir))))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short segment of whole coordinates per line item; the supplier is the network."""
    rows = table(spark, sf_dir, "lineitem")
    start = {"x": F.col("l_partkey") % 64, "y": F.col("l_orderkey") % 64, "z": F.col("l_suppkey") % 32}
    move = {"x": F.col("l_quantity").cast("long") % 7 - 3, "y": F.col("l_partkey") % 5 - 2, "z": F.col("l_orderkey") % 3 - 1}
    out = rows.select(*LINE, F.col("l_suppkey").alias("network_id"), *[start[c].alias(f"{c}0") for c in "xyz"], *[(start[c] + move[c]).alias(f"{c}1") for c in "xyz"], (F.lit(1.0) + F.col("l_quantity").cast("long") % 4).alias("diam"))
    return out.withColumn("r", F.floor(F.col("diam") * 0.5).cast("int"))


_SEGMENTS = """base AS (SELECT l_orderkey, l_linenumber, l_suppkey network_id, l_partkey % 64 x0, l_orderkey % 64 y0, l_suppkey % 32 z0,
 l_quantity::BIGINT % 7 - 3 dx, l_partkey % 5 - 2 dy, l_orderkey % 3 - 1 dz, CAST(floor((1 + l_quantity::BIGINT % 4) * 0.5) AS INT) r FROM lineitem),
 axes AS (SELECT *, abs(dx) ax, abs(dy) ay, abs(dz) az, sign(dx) sx, sign(dy) sy, sign(dz) sz FROM base)"""
_LE = "(({b} * (2 * i - 1) + {a}) // (2 * {a}))"
_LT = "(CASE WHEN {b} > 0 THEN ({b} * (2 * i - 1) - 1 + {a}) // (2 * {a}) ELSE 0 END)"


def _walk_sql() -> str:
    le, lt = (lambda a, b: _LE.format(a=a, b=b)), (lambda a, b: _LT.format(a=a, b=b))
    moved = {"x": ("i", le("ax", "ay"), le("ax", "az")), "y": (lt("ay", "ax"), "i", lt("ay", "az")), "z": (lt("az", "ax"), le("az", "ay"), "i")}
    parts = [
        f"SELECT l_orderkey, l_linenumber, network_id, r, CAST(x0 + sx * {mx} AS BIGINT) vx, CAST(y0 + sy * {my} AS BIGINT) vy, CAST(z0 + sz * {mz} AS BIGINT) vz, {k} axis FROM (SELECT *, unnest(range(1, a{c} + 1)) i FROM axes)"
        for k, (c, (mx, my, mz)) in enumerate(moved.items())
    ]
    return _SEGMENTS + ", walk AS (" + " UNION ALL ".join(parts) + ")"


def _stamp_sql() -> str:
    t0, t1, t2 = TISSUE
    return _walk_sql() + f""", disc AS (SELECT a.r r, p.i i, q.j j FROM (SELECT unnest(range(0, 3))::INT r) a, (SELECT unnest(range(-2, 3)) i) p, (SELECT unnest(range(-2, 3)) j) q WHERE i * i + j * j <= a.r * a.r),
 laid AS (SELECT network_id, vx + (CASE axis WHEN 0 THEN 0 ELSE i END) x, vy + (CASE axis WHEN 0 THEN i WHEN 1 THEN 0 ELSE j END) y, vz + (CASE axis WHEN 2 THEN 0 ELSE j END) z FROM walk JOIN disc USING (r)
 WHERE (CASE axis WHEN 0 THEN vx BETWEEN 0 AND {t0 - 1} WHEN 1 THEN vy BETWEEN 0 AND {t1 - 1} ELSE vz BETWEEN 0 AND {t2 - 1} END)),
 marks AS (SELECT network_id, x - 1 x, y - 1 y, z - 1 z FROM laid WHERE x BETWEEN 0 AND {t0 - 1} AND y BETWEEN 0 AND {t1 - 1} AND z BETWEEN 0 AND {t2 - 1}),
 voxels AS (SELECT DISTINCT network_id, x, y, z FROM marks WHERE x BETWEEN 1 AND {t0 - 2} AND y BETWEEN 1 AND {t1 - 2} AND z BETWEEN 1 AND {t2 - 2})"""


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of 4 x 5 x 5 places per hundred parts; values are prices."""
    rows = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 100
    return rows.select((F.floor(F.col("p_partkey") / 100)).alias("volume_id"), F.floor(k / 25).cast("int").alias("z"), F.floor(k % 25 / 5).cast("int").alias("y"), (k % 5).cast("int").alias("x"), F.col("p_retailprice").alias("value"))


_VOLUMES = "vol AS (SELECT p_partkey // 100 volume_id, CAST((p_partkey % 100) // 25 AS INT) z, CAST((p_partkey % 25) // 5 AS INT) y, CAST(p_partkey % 5 AS INT) x, p_retailprice AS value FROM part)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with 1 for large part sizes, in volumes that hold both values."""
    binary = sizes(spark, sf_dir)
    both = binary.groupBy("volume_id").agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a = 0 and b = 1").select("volume_id")
    return binary.join(both, "volume_id")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all volumes with 1 for large part sizes."""
    rows = table(spark, sf_dir, "part")
    size = rows.select("p_partkey", (F.col("p_size") > 45).cast("double").alias("value"))
    places = volumes(spark, sf_dir).drop("value").withColumn("p_partkey", F.col("volume_id") * 100 + F.col("z") * 25 + F.col("y") * 5 + F.col("x"))
    return places.join(size, "p_partkey").drop("p_partkey")


_MASKS = """bin AS (SELECT p_partkey // 100 volume_id, CAST((p_partkey % 100) // 25 AS INT) z, CAST((p_partkey % 25) // 5 AS INT) y, CAST(p_partkey % 5 AS INT) x, (p_size > 45)::INT::DOUBLE AS value FROM part),
 mask AS (SELECT * FROM bin WHERE volume_id IN (SELECT volume_id FROM bin GROUP BY 1 HAVING min(value) = 0 AND max(value) = 1))"""


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of 6 to 8 levels per supplier."""
    rows = table(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("network_id"), F.lit(11).cast("long").alias("seed"), (F.col("s_suppkey") % 3 + 6).cast("int").alias("n"), (F.col("s_suppkey") % 11 + 15).cast("double").alias("d0"))


# --- queries -------------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_R9 = lambda c, n=9: F.round(c, n)


@query(f"SELECT l_orderkey, l_linenumber, CAST({_u('a')} * 281474976710656.0 AS BIGINT) u, CAST(floor({_u('b')} * 9.0) + 6 AS INT) n, round({rng.normal_sql(_u('c'), _u('d'))}, 9) z FROM lineitem")
def params_draws(spark, sf_dir):
    """Keyed uniform, whole and normal draws."""
    draw = lambda n: rng.uniform(F.col("seed"), F.col("network_id"), F.col("path"), n)
    return draws(spark, sf_dir).select(*LINE, (draw("a") * F.lit(float(1 << 48))).cast("long").alias("u"), rng.integer(draw("b"), 6, 14).alias("n"), _R9(rng.normal(draw("c"), draw("d"))).alias("z"))


def _draw_params_sql() -> str:
    u = lambda n: rng.uniform_sql("'0'", "CAST(c_custkey AS VARCHAR)", "'params'", f"'{n}'")
    return f"""SELECT c_custkey network_id, 0::BIGINT seed, CAST(floor({u('n')} * 9.0) + 6 AS INT) n, round(20.0 + 5.0 * {rng.normal_sql(u('d0a'), u('d0b'))}, 9) d0, 3 k,
 round(4.0 + {u('epsilon')} * 6.0, 9) epsilon, round(2.0 + {u('randmarg')} * 2.0, 9) randmarg, 5 sigma, true stochparams FROM customer"""


@query(_draw_params_sql())
def parameter_rows(spark, sf_dir):
    """Parameter rows drawn for every customer."""
    rows = params.drawn(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("network_id")))
    return rows.withColumns({c: _R9(F.col(c)) for c in ("d0", "epsilon", "randmarg")})


@query("SELECT s_suppkey network_id, 3.0::DOUBLE k, 10.0::DOUBLE epsilon, 3.0::DOUBLE randmarg, 5.0::DOUBLE sigma, true stochparams FROM supplier")
def property_defaults(spark, sf_dir):
    """Defaults where no property is given."""
    given = physics.with_defaults()
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("network_id"), *[v.cast("boolean" if c == "stochparams" else "double").alias(c) for c, v in given.items()])


_BIF = f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity d0, l_quantity / pow(2.0, 1.0::DOUBLE / 3.0::DOUBLE) best, {rng.normal_sql(_u('sa'), _u('sb'))} z FROM lineitem),
 e AS (SELECT *, CASE WHEN abs(best + best / 5.0::DOUBLE * z) >= d0 THEN best ELSE abs(best + best / 5.0::DOUBLE * z) END d1 FROM d),
 f AS (SELECT *, pow(pow(d0, 3.0) - pow(d1, 3.0), 1.0::DOUBLE / 3.0::DOUBLE) d2 FROM e), g AS (SELECT *, d2 / d1 a FROM f), h AS (SELECT *, 1.0::DOUBLE + a * a * a s FROM g)
 SELECT l_orderkey, l_linenumber, round(d1, 7) d1, round(d2, 7) d2, round(degrees(acos(greatest(-1.0, least(1.0, (pow(s, 4.0::DOUBLE / 3) + 1 - pow(a, 4.0)) / (2 * pow(s, 2.0::DOUBLE / 3)))))), 5) th1,
 round(degrees(acos(greatest(-1.0, least(1.0, (pow(s, 4.0::DOUBLE / 3) + pow(a, 4.0) - 1) / (2 * a * a * pow(s, 2.0::DOUBLE / 3)))))), 5) th2 FROM h"""


@query(_BIF)
def bifurcation(spark, sf_dir):
    """Daughter diameters and angles."""
    draw = lambda n: rng.uniform(F.col("seed"), F.col("network_id"), F.col("path"), n)
    d1, d2 = physics.daughters(F.col("d0"), F.lit(3.0), F.lit(5.0), F.lit(True), rng.normal(draw("sa"), draw("sb")))
    rows = draws(spark, sf_dir).select(*LINE, "d0", d1.alias("d1")).withColumn("d2", F.pow(F.pow("d0", F.lit(3.0)) - F.pow("d1", F.lit(3.0)), F.lit(1.0 / 3.0)))
    th1, th2 = physics.angles(F.col("d1"), F.col("d2"))
    return rows.select(*LINE, _R9(F.col("d1"), 7).alias("d1"), _R9(F.col("d2"), 7).alias("d2"), _R9(th1, 5).alias("th1"), _R9(th2, 5).alias("th2"))


@query(f"SELECT l_orderkey, l_linenumber, round(l_quantity * 10.0::DOUBLE - 3.0::DOUBLE + {_u('co')} * 6.0::DOUBLE, 9) co, round((l_quantity * 10.0::DOUBLE - 3.0::DOUBLE + {_u('co')} * 6.0::DOUBLE) / 5.0::DOUBLE, 9) part FROM lineitem")
def length_law(spark, sf_dir):
    """Branch lengths and their fifth."""
    u = rng.uniform(F.col("seed"), F.col("network_id"), F.col("path"), "co")
    co = physics.length(F.col("d0"), F.lit(10.0), F.lit(3.0), u)
    return draws(spark, sf_dir).select(*LINE, _R9(co).alias("co"), _R9(physics.share(co, 5)).alias("part"))


_ROT = """SELECT l_orderkey, l_linenumber, round(cos(radians(angle)) * x2 - sin(radians(angle)) * y1, 7) rx, round(sin(radians(angle)) * x2 + cos(radians(angle)) * y1, 7) ry, round(z2, 7) rz FROM (
 SELECT *, cos(b) * x + sin(b) * z1 x2, cos(b) * z1 - sin(b) * x z2 FROM (SELECT *, cos(a) * y - sin(a) * z y1, sin(a) * y + cos(a) * z z1 FROM (SELECT *, radians(angle + 10.0) a, radians(angle - 20.0) b FROM (""" + _VECTORS + "))))"


@query(_ROT)
def rotate(spark, sf_dir):
    """Roll, pitch and yaw."""
    r = vector.rotate(F.radians(F.col("angle") - 20.0), F.radians(F.col("angle") + 10.0), F.col("angle"), (F.col("x"), F.col("y"), F.col("z")))
    return vectors(spark, sf_dir).select(*LINE, *[_R9(c, 7).alias(n) for c, n in zip(r, ("rx", "ry", "rz"))])


@query(f"SELECT l_orderkey, l_linenumber, round(sqrt(x * x + y * y + z * z), 7) m, round(x * 5.0::DOUBLE / sqrt(x * x + y * y + z * z), 9) nx, round(y * 5.0::DOUBLE / sqrt(x * x + y * y + z * z), 9) ny, round(z * 5.0::DOUBLE / sqrt(x * x + y * y + z * z), 9) nz FROM ({_VECTORS})")
def normalise(spark, sf_dir):
    """Magnitude and vectors of length 5."""
    v = (F.col("x"), F.col("y"), F.col("z"))
    return vectors(spark, sf_dir).select(*LINE, _R9(vector.magnitude(v), 7).alias("m"), *[_R9(c).alias(n) for c, n in zip(vector.normalise(v, 5.0), ("nx", "ny", "nz"))])


@query(f"SELECT l_orderkey, l_linenumber, sqrt((20.0 - x) * (20.0 - x) + (30.0 - y) * (30.0 - y) + (1.0 - z) * (1.0 - z)) > 25.0 beyond FROM ({_VECTORS}) WHERE sqrt((20.0 - x) * (20.0 - x) + (30.0 - y) * (30.0 - y) + (1.0 - z) * (1.0 - z)) < 40.0")
def raddist_filter(spark, sf_dir):
    """Places within a shell, and whether they are beyond its core."""
    origin, place = tuple(F.lit(v) for v in (20.0, 30.0, 1.0)), (F.col("x"), F.col("y"), F.col("z"))
    return vectors(spark, sf_dir).filter(vector.radial(origin, place, 40.0)).select(*LINE, vector.radial(origin, place, 25.0, core=True).alias("beyond"))


#: Origins, a place for each supplier, and how far from them line items are looked for.
_ORIGINS = "SELECT s_suppkey, s_suppkey % 50 + 0.5::DOUBLE ox, s_suppkey * 7 % 100 + 0.5::DOUBLE oy, 1.25::DOUBLE oz FROM supplier"
_SHELL, _CORE = 2.0, 1.0


@query(f"SELECT l_orderkey, l_linenumber, s_suppkey, far > {_CORE}::DOUBLE beyond FROM (SELECT *, sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y) + (oz - z) * (oz - z)) far FROM ({_VECTORS}), ({_ORIGINS})) WHERE far < {_SHELL}::DOUBLE")
def raddist_origins(spark, sf_dir):
    """Places within the shells of many origins, and whether they are beyond the core."""
    half = F.lit(0.5)
    key = F.col("s_suppkey")
    origins = table(spark, sf_dir, "supplier").select(key, (key % 50 + half).cast("double").alias("ox"), (key * 7 % 100 + half).cast("double").alias("oy"), F.lit(1.25).alias("oz"))
    pairs = spatial.within(vectors(spark, sf_dir).select(*LINE, "x", "y", "z"), origins, _SHELL)
    return pairs.select(*LINE, "s_suppkey", (F.col("distance") > _CORE).alias("beyond"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END s, CASE WHEN " + rng.uniform_sql("'7'", "CAST(c_custkey AS VARCHAR)", "''", "'coin'") + " < 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END coin FROM customer")
def posneg(spark, sf_dir):
    """Signs without zero, and fair signs."""
    coin = rng.uniform(F.lit(7), F.col("c_custkey"), F.lit(""), "coin")
    return table(spark, sf_dir, "customer").select("c_custkey", vector.sign_not_zero(F.col("c_acctbal")).alias("s"), F.when(coin < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("coin"))


@query("SELECT s_suppkey network_id, 0.1::DOUBLE x, 0.1::DOUBLE y, 1.0::DOUBLE z, 0.0::DOUBLE alpha, 0.0::DOUBLE beta, (s_suppkey % 11 + 15)::DOUBLE diam FROM supplier")
def start_row(spark, sf_dir):
    """Where the networks start."""
    return grammar.roots(parameters(spark, sf_dir)).select("network_id", "x", "y", "z", "alpha", "beta", "diam")


@query(f"WITH {_RUNS} SELECT * FROM runs")
def gap_segments(spark, sf_dir):
    """Runs of points between gaps."""
    return paths.gap_segments(polylines(spark, sf_dir))


@query(f"WITH {_FIRST} SELECT * FROM firsts")
def distinct_first(spark, sf_dir):
    """Points of runs without repeats."""
    return paths.distinct_first(paths.gap_segments(polylines(spark, sf_dir)))


@query(f"WITH {_WINDOWS} SELECT * FROM windows")
def windows_6_5(spark, sf_dir):
    """Windows of six points that share an end."""
    return _windows(spark, sf_dir).withColumnRenamed("window", "win")


_ADJ = """SELECT network_id, run, win, pos, x x0, y y0, z z0, lx x1, ly y1, lz z1, (diam + ld) / 2 diam, CAST(floor((diam + ld) / 2 * 0.5) AS INT) r FROM (SELECT *, lead(x) OVER w lx, lead(y) OVER w ly, lead(z) OVER w lz,
 lead(diam) OVER w ld FROM windows WINDOW w AS (PARTITION BY network_id, run, win ORDER BY pos)) WHERE lx IS NOT NULL"""


@query(f"WITH {_WINDOWS} {_ADJ}")
def adjacency(spark, sf_dir):
    """Neighbours in a window as segments."""
    return paths.adjacency(_windows(spark, sf_dir)).withColumnRenamed("window", "win")


def _bezier_sql() -> str:
    t = "(s / 9.0::DOUBLE)"
    term = lambda c: " + ".join(f"{k}.0::DOUBLE * pow(1.0::DOUBLE - {t}, {5 - i}.0) * pow({t}, {i}.0) * max(CASE WHEN pos = {i} THEN {c} END)" for i, k in enumerate((1, 5, 10, 10, 5, 1)))
    return f"WITH {_WINDOWS} SELECT network_id, run, win, s AS step, {', '.join(f'round({term(c)}, 7) {c}' for c in paths.POINT)} FROM windows, (SELECT unnest(range(0, 10))::INT s) GROUP BY network_id, run, win, s"


@query(_bezier_sql())
def bezier_points(spark, sf_dir):
    """Ten points of each window's curve."""
    rows = paths.bezier(_windows(spark, sf_dir), size=6).withColumnRenamed("window", "win")
    return rows.withColumns({c: _R9(F.col(c), 7) for c in paths.POINT})


def _bezier_runs_sql() -> str:
    t = "(s / 9.0::DOUBLE)"
    basis = f"round(gamma(n) / (gamma(i + 1) * gamma(n - i))) * pow(1.0::DOUBLE - {t}, n - 1 - i) * pow({t}, i)"
    return f"WITH {_WINDOWS}, spots AS (SELECT *, unnest(range(0, 10))::INT s FROM ranked WHERE n > 2) SELECT network_id, run, s AS step, CAST(any_value(n) AS INT) n, {', '.join(f'round(sum({basis} * {c}), 5) {c}' for c in paths.POINT)} FROM spots GROUP BY network_id, run, s"


@query(_bezier_runs_sql())
def bezier_runs(spark, sf_dir):
    """Ten points of the curve of each run of three points or more, whatever their number."""
    runs = paths.distinct_first(paths.gap_segments(polylines(spark, sf_dir))).withColumnRenamed("seq", "pos")
    sizes = runs.groupBy("network_id", "run").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 2")
    rows = paths.bezier(runs.join(sizes, ["network_id", "run"]), ("network_id", "run", "n"))
    return rows.select("network_id", "run", "step", "n", *[_R9(F.col(c), 5).alias(c) for c in paths.POINT])


_BOUNDS = "lim AS (SELECT network_id, " + ", ".join(f"{f}({c}) * 1.1::DOUBLE {c}_{e}" for c in "xyz" for f, e in (("min", "lo"), ("max", "hi"))) + " FROM points WHERE NOT gap GROUP BY network_id)"


@query(f"WITH {_POINTS}, {_BOUNDS} SELECT network_id, {', '.join(f'round({c}_{e}, 9) {c}_{e}' for c in 'xyz' for e in ('lo', 'hi'))} FROM lim")
def bounds(spark, sf_dir):
    """Bounds of each polyline with its margin."""
    out = voxel.bounds(polylines(spark, sf_dir))
    return out.filter(F.col("x_lo").isNotNull()).select("network_id", *[_R9(F.col(c)).alias(c) for c in out.columns if c != "network_id"])


_SPOT = lambda c, t: f"CAST(floor(CASE WHEN {c}_hi = {c}_lo THEN NULL ELSE {t}.0::DOUBLE * ({c} - {c}_lo) / ({c}_hi - {c}_lo) END) AS BIGINT) {c}"


@query(f"WITH {_POINTS}, {_BOUNDS} SELECT network_id, seq, {', '.join(_SPOT(c, t) for c, t in zip('xyz', TISSUE))}, diam FROM points JOIN lim USING (network_id) WHERE NOT gap")
def discretise(spark, sf_dir):
    """Points in whole coordinates."""
    points = polylines(spark, sf_dir)
    return voxel.discretise(points.filter(~F.isnan("x")), voxel.bounds(points), TISSUE).select("network_id", "seq", "x", "y", "z", "diam")


@query(f"WITH {_walk_sql()} SELECT l_orderkey, l_linenumber, vx, vy, vz, axis FROM walk")
def line_walk(spark, sf_dir):
    """The places that each segment's walk visits."""
    return voxel.line_walk(segments(spark, sf_dir)).select(*LINE, "vx", "vy", "vz", "axis")


@query("SELECT r, i, j FROM (SELECT DISTINCT CAST(p_size AS INT) r FROM part), (SELECT CAST(unnest(range(-50, 51)) AS INT) i), (SELECT CAST(unnest(range(-50, 51)) AS INT) j) WHERE i * i + j * j <= r * r")
def disc_stencil(spark, sf_dir):
    """Discs of all part sizes as radii."""
    return voxel.disc_stencil(table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("r")))


@query(f"WITH {_stamp_sql()} SELECT network_id, x, y, z FROM voxels")
def voxelize(spark, sf_dir):
    """Voxels of all segments by network."""
    return voxel.voxelize(segments(spark, sf_dir), TISSUE)


@query(f"WITH {_stamp_sql()} SELECT network_id, count(*) n FROM voxels GROUP BY network_id")
def voxel_counts(spark, sf_dir):
    """Number of foreground voxels by network."""
    return voxel.counts(voxel.lines(segments(spark, sf_dir), TISSUE))


@query(f"WITH {_VOLUMES} SELECT volume_id x, z y, y z FROM vol WHERE volume_id BETWEEN 1 AND 62 AND z BETWEEN 1 AND 62 AND y BETWEEN 1 AND 30")
def boundary(spark, sf_dir):
    """Places off the six faces."""
    rows = volumes(spark, sf_dir).select(F.col("volume_id").alias("x"), F.col("z").alias("y"), F.col("y").alias("z"))
    return voxel.clear_boundary(rows, TISSUE)


@query(f"WITH {_VOLUMES}, lim AS (SELECT volume_id, min(value) lo, max(value) hi FROM vol GROUP BY 1) SELECT volume_id, z, y, x, round(CASE WHEN hi = lo THEN -1 ELSE (value - lo) / (hi - lo) END, 9) AS value FROM vol JOIN lim USING (volume_id)")
def norm_minmax(spark, sf_dir):
    """Volumes scaled to 0..1; -1 stands for not a number."""
    out = image.norm_minmax(volumes(spark, sf_dir))
    return out.withColumn("value", F.when(F.isnan("value"), F.lit(-1.0)).otherwise(_R9(F.col("value"))))


_NOISE = rng.uniform_sql("'3'", "CAST(volume_id AS VARCHAR)", "concat_ws(',', CAST(y AS VARCHAR), CAST(x AS VARCHAR))", "'noise'")


@query(f"WITH {_VOLUMES} SELECT volume_id, z, y, x, CASE WHEN {_NOISE} < 0.8 THEN value WHEN {_NOISE} < 0.9 THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM vol")
def salt_pepper(spark, sf_dir):
    """Noise on a fifth of the columns."""
    return image.salt_pepper(volumes(spark, sf_dir), 0.8, 3)


_AROUND = """near AS (SELECT m.volume_id, m.z z0, m.y y0, m.x x0, m.z + dz z, m.y + dy y, m.x + dx x FROM mask m, (SELECT CAST(unnest(range(-2, 3)) AS INT) dz), (SELECT CAST(unnest(range(-2, 3)) AS INT) dy), (SELECT CAST(unnest(range(-2, 3)) AS INT) dx)
 WHERE m.value = 1 AND dz * dz + dy * dy + dx * dx < 4)"""


@query(f"WITH {_MASKS}, {_AROUND}, hit AS (SELECT volume_id, z, y, x FROM (SELECT n.*, row_number() OVER (PARTITION BY n.volume_id ORDER BY z0, y0, x0, n.z, n.y, n.x) k FROM near n JOIN mask USING (volume_id, z, y, x)) WHERE k = 1) SELECT volume_id, z, y, x, CASE WHEN h.z IS NULL THEN value ELSE 127.0::DOUBLE END AS value FROM mask LEFT JOIN (SELECT volume_id, z, y, x, z AS zz FROM hit) h USING (volume_id, z, y, x)".replace("h.z IS NULL", "h.zz IS NULL"))
def wrap_observed(spark, sf_dir):
    """The first voxel around the ones."""
    return image.wrap(masks(spark, sf_dir), 2)


@query(f"WITH {_MASKS}, {_AROUND}, all_near AS (SELECT DISTINCT volume_id, z, y, x, 1 AS hit FROM near) SELECT volume_id, z, y, x, CASE WHEN value = 0 AND hit = 1 THEN 127.0::DOUBLE ELSE value END AS value FROM mask LEFT JOIN all_near USING (volume_id, z, y, x)")
def wrap_dilate(spark, sf_dir):
    """All voxels around the ones."""
    return image.wrap(masks(spark, sf_dir), 2, "dilate")


_FURTHER = _AROUND.replace("range(-2, 3)", "range(-3, 4)").replace("< 4)", "< 9)")


@query(f"WITH {_MASKS}, {_FURTHER}, all_near AS (SELECT DISTINCT volume_id, z, y, x, 1 AS hit FROM near) SELECT volume_id, z, y, x, CASE WHEN value = 0 AND hit = 1 THEN 127.0::DOUBLE ELSE value END AS value FROM mask LEFT JOIN all_near USING (volume_id, z, y, x)")
def wrap_dilate_3(spark, sf_dir):
    """All voxels closer than 3 to the ones."""
    return image.wrap(masks(spark, sf_dir), 3, "dilate")


@query(f"WITH {_VOLUMES}, t AS (SELECT CAST(a AS INT) a, CAST(b AS INT) b, CAST(c AS INT) c FROM (SELECT unnest(range(0, 6)) a), (SELECT unnest(range(0, 3)) b), (SELECT unnest(range(0, 8)) c)) SELECT volume_id, a z, b y, c x, value FROM t JOIN vol ON vol.z = (a * 4) // 6 AND vol.y = (b * 5) // 3 AND vol.x = (c * 5) // 8")
def resize_nearest(spark, sf_dir):
    """Volumes resized by nearest neighbour."""
    return image.resize_nearest(volumes(spark, sf_dir), (4, 5, 5), (6, 3, 8)).select("volume_id", "z", "y", "x", "value")


def _area_sql() -> str:
    def shrink(source: str, c: str, n: int, m: int, then: str) -> str:
        others = ", ".join(k for k in ("volume_id", "z", "y", "x") if k != c)
        s = f"({n}.0::DOUBLE / {m}.0::DOUBLE)"
        w = f"(least((d + 1) * {s}, {c} + 1.0) - greatest(d * {s}, {c}::DOUBLE))"
        v = f"sum(value * {w}) / sum({w})"
        return f"SELECT {others}, d AS {c}, {then.format(v=v)} AS value FROM {source}, (SELECT CAST(unnest(range(0, {m})) AS INT) d) WHERE {w} > 1e-9 GROUP BY {others}, d"

    high = "CASE WHEN {v} > 0.1 THEN 1.0::DOUBLE ELSE {v} END"
    return f"WITH {_MASKS}, s1 AS ({shrink('bin', 'x', 5, 3, '{v}')}), s2 AS ({shrink('s1', 'y', 5, 2, high)}), s3 AS ({shrink('s2', 'z', 4, 3, high)}) SELECT volume_id, z, y, x, round(value, 9) AS value FROM s3"


@query(_area_sql())
def resize_area(spark, sf_dir):
    """Masks shrunk by overlap."""
    return image.resize_area(sizes(spark, sf_dir), (4, 5, 5), (3, 2, 3)).withColumn("value", _R9(F.col("value")))


def _enlarge_sql() -> str:
    def grow(source: str, c: str, n: int, m: int, then: str) -> str:
        others = ", ".join(k for k in ("volume_id", "z", "y", "x") if k != c)
        near = f"(SELECT d, s, CASE WHEN s >= {n - 1} OR f <= 0 THEN 0.0::DOUBLE ELSE f - floor(f) END f FROM (SELECT d, s, d + 1 - (s + 1) * {m}.0::DOUBLE / {n}.0::DOUBLE f FROM (SELECT CAST(d AS INT) d, CAST(d * {n} // {m} AS INT) s FROM (SELECT unnest(range(0, {m})) d))))"
        v = f"sum(value * CASE WHEN {c} = s THEN 1.0::DOUBLE - f ELSE f END)"
        return f"SELECT {others}, d AS {c}, {then.format(v=v)} AS value FROM {source} JOIN {near} ON {c} = s OR {c} = s + 1 GROUP BY {others}, d"

    high = "CASE WHEN {v} > 0.1 THEN 1.0::DOUBLE ELSE {v} END"
    return f"WITH {_MASKS}, s1 AS ({grow('bin', 'x', 5, 8, '{v}')}), s2 AS ({grow('s1', 'y', 5, 8, high)}), s3 AS ({grow('s2', 'z', 4, 6, high)}) SELECT volume_id, z, y, x, round(value, 9) AS value FROM s3"


@query(_enlarge_sql())
def resize_enlarge(spark, sf_dir):
    """Masks enlarged by neighbours."""
    return image.resize_area(sizes(spark, sf_dir), (4, 5, 5), (6, 8, 8)).withColumn("value", _R9(F.col("value")))


@query(f"WITH {_MASKS} SELECT volume_id, z, y, x, CAST(CASE WHEN value = 1 THEN -1 ELSE 0 END AS TINYINT) AS value FROM bin")
def int8_wrap(spark, sf_dir):
    """Masks as signed bytes."""
    return sizes(spark, sf_dir).withColumn("value", image.int8_wrap(F.col("value")))


@query(f'WITH {_VOLUMES} SELECT volume_id, z page, y "column", x "row", value FROM vol')
def transpose(spark, sf_dir):
    """Volumes as pages."""
    return image.transpose(volumes(spark, sf_dir))


@query(f"WITH {_POINTS} SELECT network_id, seq, CASE WHEN gap THEN '<gap>' ELSE printf('(%.2f, %.2f, %.2f)', x, y, z) END AS text FROM points")
def text_dump(spark, sf_dir):
    """Coordinates as text."""
    return polylines(spark, sf_dir).select("network_id", "seq", reports.coordinate_text(F.col("x"), F.col("y"), F.col("z")).alias("text"))


@query(f"WITH {_POINTS} SELECT network_id, seq, x x0, y y0, z z0, lx x1, ly y1, lz z1, diam * 0.5::DOUBLE width FROM (SELECT *, lead(x) OVER w lx, lead(y) OVER w ly, lead(z) OVER w lz, lead(gap) OVER w lgap FROM points WINDOW w AS (PARTITION BY network_id ORDER BY seq)) WHERE NOT gap AND NOT lgap")
def plot_segments(spark, sf_dir):
    """Lines to draw."""
    return reports.plot_segments(polylines(spark, sf_dir))


@query("SELECT s_suppkey network_id, CAST(pow(2, s_suppkey % 3 + 4) - 1 AS BIGINT) stems, CAST(5 * (pow(2, s_suppkey % 3 + 4) - 1) AS BIGINT) steps FROM supplier")
def grammar_sizes(spark, sf_dir):
    """Stems and steps of every network's tree."""
    found = grammar.tree(parameters(spark, sf_dir))
    stems = F.count(F.lit(1))
    return found.groupBy("network_id").agg(stems.alias("stems"), (stems * 5).alias("steps"))


@query("SELECT s_suppkey network_id, CAST(1 + 5 * (pow(2, m - 2) - 1) + 5 * pow(2, m - 2) + pow(2, m - 1) + pow(2, m) + 4 * (pow(2, m) - 1) AS BIGINT) n_rows, CAST(2 * (pow(2, m) - 1) AS BIGINT) gaps FROM (SELECT s_suppkey, s_suppkey % 3 + 6 m FROM supplier)")
def turtle_sizes(spark, sf_dir):
    """State rows and gaps of every network's text."""
    rows = turtle(texts.programs(parameters(spark, sf_dir)))
    return rows.groupBy("network_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_gap").cast("long")).alias("gaps"))


@query("SELECT s_suppkey network_id, CAST(6 * (pow(2, s_suppkey % 3 + 4) - 1) AS BIGINT) points FROM supplier")
def program_windows(spark, sf_dir):
    """Points in windows of every network's text."""
    found = network.program_windows(texts.programs(parameters(spark, sf_dir)))
    return found.groupBy("network_id").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {_POINTS}, kept AS (SELECT network_id, seq, x, y, z, diam FROM points WHERE NOT gap) SELECT * FROM kept UNION ALL SELECT network_id, max(seq) + 1, 0.1::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE, 5.0::DOUBLE FROM kept GROUP BY network_id")
def generate_points(spark, sf_dir):
    """A point put behind every polyline."""
    points = polylines(spark, sf_dir).filter(~F.isnan("x"))
    more = points.select("network_id").distinct().select("network_id", F.lit(0).cast("long").alias("seq"), *[F.lit(v).alias(c) for c, v in zip(paths.POINT, (0.1, 0.1, 1.0, 5.0))])
    return paths.generate_points(points, more, gap=False)


@query("SELECT s_suppkey network_id, printf('Lnet_i%d_%d.tiff', s_suppkey % 3 + 6, s_suppkey) AS name, printf('network %d with %d levels', s_suppkey, s_suppkey % 3 + 6) AS line FROM supplier")
def output_names(spark, sf_dir):
    """File names and progress lines of every network."""
    rows = parameters(spark, sf_dir)
    return rows.select("network_id", reports.output_name(F.col("n"), F.col("network_id")).alias("name"), reports.progress(F.col("network_id"), F.col("n")).alias("line"))


@query(f"WITH {_FIRST} SELECT * FROM firsts WHERE run = 0")
def find_vessel(spark, sf_dir):
    """The first run of every polyline."""
    return paths.run_of(paths.distinct_first(paths.gap_segments(polylines(spark, sf_dir))), 0)


def _points(rows: DataFrame, digits: int = 4) -> DataFrame:
    return rows.select("network_id", "run", F.col("window").alias("win"), "pos", *[_R9(F.col(c), digits).alias(c) for c in paths.POINT])


@query(f"{oracles.nodes(3)} {oracles.stem_points()}")
def grammar_nodes(spark, sf_dir):
    """Stems of every network's tree, point by point."""
    return _points(grammar.stem_windows(grammar.stems(parameters(spark, sf_dir))))


def drawn_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of 6 to 14 levels per nation, its parameters drawn as for whole runs."""
    rows = params.drawn(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("network_id")), 5)
    return rows.withColumn("n", (F.col("network_id") % 9 + 6).cast("int"))


def _drawn_sql() -> str:
    u = lambda n: rng.uniform_sql("'5'", "CAST(n_nationkey AS VARCHAR)", "'params'", f"'{n}'")
    return f"""SELECT CAST(n_nationkey AS BIGINT) network_id, 5 seed, CAST(n_nationkey % 9 + 6 AS INT) n, 20.0 + 5.0 * {rng.normal_sql(u('d0a'), u('d0b'))} d,
 4.0::DOUBLE + {u('epsilon')} * 6.0::DOUBLE ep, 2.0::DOUBLE + {u('randmarg')} * 2.0::DOUBLE mg FROM nation"""


@query(f"{oracles.nodes(3, _drawn_sql())} {oracles.stem_points()}")
def drawn_nodes(spark, sf_dir):
    """Stems of trees of 6 to 14 levels with drawn diameters, lengths and margins."""
    return _points(grammar.stem_windows(grammar.stems(drawn_networks(spark, sf_dir))))


def _states(rows: DataFrame, digits: int) -> DataFrame:
    """State rows with rounded numbers; -1 stands for a gap's."""
    names = [c for c in rows.columns if c not in ("network_id", "seq", "is_gap")]
    return rows.select("network_id", "seq", "is_gap", *[F.when(F.col("is_gap"), F.lit(-1.0)).otherwise(_R9(F.col(c), digits)).alias(c) for c in names])


@query(f"{oracles.nodes()} {oracles.state_rows()}")
def turtle_rows(spark, sf_dir):
    """State rows of every network's text."""
    return _states(turtle(texts.programs(parameters(spark, sf_dir))), 4)


@query(oracles.commands())
def turtle_commands(spark, sf_dir):
    """State rows of a text that every user's events spell: all commands, nested brackets, negative operands."""
    e = F.col("event_id")
    tenth = lambda c: F.format_string("%.1f", c / F.lit(10.0))
    long, wide, angle = tenth(e % 90 + 10), tenth(e % 40 + 10), F.format_string("%.1f", (e % 180) + F.lit(0.5))
    says = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    step, turn = says("f(", long, ",", wide, ")"), lambda sign: says(sign, "(", angle, ")")
    pieces = [
        step, turn("+"), turn("-"), turn("/"), says("[", turn("+"), step, "]"),
        says("[", step, "[", turn("/"), "f(", long, ")]", turn("-"), step, "]"), F.lit("D"), says("f(-", long, ",", wide, ")"),
    ]
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get(F.array(*pieces), (e % 8).cast("int")).alias("piece"))
    texts = rows.groupBy(F.col("user_id").alias("network_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "piece"))).alias("p"))
    texts = texts.select("network_id", F.array_join(F.col("p.piece"), "").alias("program"), F.lit(5.0).alias("d0"))
    return _states(turtle(texts), 5)


@query(oracles.rule_texts())
def rule_texts(spark, sf_dir):
    """Every rule's text of one level (S and B: of two as well) as its letters and its numbers in order."""
    rows, number = parameters(spark, sf_dir), r"-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"
    parts = []
    for name in ("F", "S", "S2", "D", "G", "A", "B", "B2", "R", "I"):
        found = texts.programs(rows.withColumn("n", F.lit(int(name[1:] or 1))), name[0])
        shape, values = F.regexp_replace("program", number, "#"), F.regexp_extract_all("program", F.lit(number), F.lit(0))
        parts.append(found.select("network_id", F.lit(name).alias("rule"), shape.alias("shape"), F.posexplode(values).alias("k", "v")))
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.select("network_id", "rule", "shape", "k", _R9(F.col("v").cast("double"), 5).alias("value"))


@query(f"{oracles.nodes(3)} SELECT network_id, pos, x, y, z, diam FROM ({oracles.stem_points()})")
def text_windows(spark, sf_dir):
    """Windows of every network's text, by the interpreter: the points of its stems."""
    return _points(network.program_windows(texts.programs(parameters(spark, sf_dir)))).drop("run", "win")


@query(f"{oracles.voxels(TISSUE)} SELECT * FROM voxels")
def network_voxels(spark, sf_dir):
    """Voxels of every network, from its parameters."""
    return network.network_voxels(parameters(spark, sf_dir), TISSUE)


#: A box of the tissue.
_LOW, _HIGH = (10, 12, 5), (40, 45, 20)


@query(f"{oracles.voxels(TISSUE)} SELECT * FROM voxels WHERE " + " AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", _LOW, _HIGH)))
def brick_box(spark, sf_dir):
    """Voxels of every network in a box, read from written bricks."""
    path = scratch(spark, "bricks")
    bricks.write_bricks(bricks.bricks(network.network_lines(parameters(spark, sf_dir), TISSUE)), path, 32)
    return bricks.box(spark, path, _LOW, _HIGH, 32)


@query(f"{oracles.voxels(TISSUE)} SELECT network_id, CAST(z AS INT) z, CAST(y AS INT) y, CAST(x AS INT) x FROM voxels")
def network_stacks(spark, sf_dir):
    """Voxels of every network's text as stacks of pages, read from the pages again."""
    stacks = volumes_of.tiff_stacks(network.program_voxels(parameters(spark, sf_dir), "F", TISSUE), TISSUE)
    # A page's rows are x and its columns y; 0 is the least value of a volume, which a voxel has.
    pages = volumes_of.planes(stacks.select(F.col("network_id").cast("string").alias("path"), "content"), only=0.0)
    return pages.select(F.col("volume_id").cast("long").alias("network_id"), "z", F.col("x").alias("y"), F.col("y").alias("x"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The folder that the networks' stacks are written to."""
    path, rows = scratch(spark, "stacks"), parameters(spark, sf_dir)
    tiff.write_stacks(network.network_voxels(rows, TISSUE), rows, path, TISSUE)
    return path


def _network():
    """The network in a stack's name."""
    return F.substring_index(F.substring_index("volume_id", "_", -1), ".", 1).cast("long")


@query(f"{oracles.voxels(TISSUE)} SELECT network_id, count(*) dark, {TISSUE[0] * TISSUE[1] * TISSUE[2]} - count(*) light, CAST(sum(x + {TISSUE[0]} * (y + {TISSUE[1]} * z)) AS BIGINT) places FROM voxels GROUP BY network_id")
def load_volume(spark, sf_dir):
    """Volumes read from files: how many places are 0 and 255 of each, and where the dark ones are."""
    places = volumes_of.load_volume(spark, _written(spark, sf_dir))
    place = F.col("y") + TISSUE[0] * (F.col("x") + TISSUE[1] * F.col("z"))
    found = places.groupBy("volume_id").agg(
        F.sum((F.col("value") == 0).cast("long")).alias("dark"), F.sum((F.col("value") == 255).cast("long")).alias("light"), F.sum(F.when(F.col("value") == 0, place)).alias("places")
    )
    return found.select(_network().alias("network_id"), "dark", "light", "places")


@query(f"{oracles.voxels(TISSUE)} SELECT network_id, CAST(z AS INT) z, CAST(y AS INT) y, CAST(x AS INT) x FROM voxels")
def stack_files(spark, sf_dir):
    """Voxels of every network, written as files and read from these by ranges of pages."""
    found = tiff.read_stacks(spark, _written(spark, sf_dir), pages=8, only=-1)
    return found.select(_network().alias("network_id"), "z", F.col("x").alias("y"), F.col("y").alias("x"))


@query(f"WITH {_POINTS}, kept AS (SELECT * FROM points WHERE NOT gap), last AS (SELECT network_id, max(seq) + 1 AS behind FROM kept GROUP BY network_id) SELECT network_id, seq, false AS is_gap, x, y, z, diam FROM kept UNION ALL SELECT network_id, behind + k, k = 2, CASE WHEN k = 2 THEN -1.0 ELSE k + 0.5 END::DOUBLE, CASE WHEN k = 2 THEN -1.0 ELSE k + 0.5 END::DOUBLE, CASE WHEN k = 2 THEN -1.0 ELSE k + 0.5 END::DOUBLE, CASE WHEN k = 2 THEN -1.0 ELSE 2.0 END::DOUBLE FROM last, (SELECT unnest([0, 1, 2]) k)")
def generate_points_gap(spark, sf_dir):
    """Two points and a gap put behind every polyline; -1 stands for a gap's numbers."""
    points = polylines(spark, sf_dir).filter(~F.isnan("x"))
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(2)]))
    more = points.select("network_id").distinct().select("network_id", k.alias("seq"))
    more = more.select("network_id", "seq", *[(F.col("seq") + 0.5).cast("double").alias(c) for c in "xyz"], F.lit(2.0).alias("diam"))
    gap = paths.is_gap()
    return paths.generate_points(points, more).select("network_id", "seq", gap.alias("is_gap"), *[F.when(gap, F.lit(-1.0)).otherwise(F.col(c)).alias(c) for c in paths.POINT])


_WHOLE = f"{oracles.voxels(voxel.TISSUE, _drawn_sql())} SELECT network_id, count(*) AS voxels, {', '.join(f'{f}({c}) {c}_{e}' for c in 'xyz' for e, f in (('lo', 'min'), ('hi', 'max')))} FROM voxels GROUP BY network_id"


@query(_WHOLE)
def whole_run(spark, sf_dir):
    """Networks of 6 to 14 levels in a tissue of 512 x 512 x 140, as whole runs have them: voxels and their bounds."""
    found = network.network_lines(drawn_networks(spark, sf_dir))
    z = F.transform(voxel.set_bits(F.col("bits")), lambda k: F.col("word") * 64 + k)
    limits = [f(c).alias(f"{n}_{e}") for n in "xyz" for e, f, c in (("lo", F.min, F.array_min(z) if n == "z" else F.col(n)), ("hi", F.max, F.array_max(z) if n == "z" else F.col(n)))]
    return found.groupBy("network_id").agg(F.sum(F.bit_count("bits")).cast("long").alias("voxels"), *limits)


@query()
def grammar_programs(spark, sf_dir):
    """Every network's tree as text."""
    return texts.programs(parameters(spark, sf_dir))


@query(oracles.rule_i())
def other_grammars(spark, sf_dir):
    """State rows of the texts, of four levels, of the rule that opens a fork of rules with an open bracket."""
    rows = parameters(spark, sf_dir).withColumn("n", F.lit(4))
    return _states(turtle(texts.programs(rows, "I")), 4)
