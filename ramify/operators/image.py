"""Volume operators over (volume_id, z, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng


def norm_minmax(volume: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Values brought to 0..1 per volume; NaN where a volume is constant or holds a NaN. limits: its least and largest value
    (volume_id, __lo, __hi), where they are known from elsewhere."""
    if limits is None:
        limits = volume.groupBy("volume_id").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    scaled = F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    spoiled = F.isnan("__hi") | F.isnan("__lo")
    return volume.join(limits, "volume_id").withColumn("value", F.when(spoiled | scaled.isNull(), F.lit(float("nan"))).otherwise(scaled)).select(*volume.columns)


def to_uint8(value: Column) -> Column:
    """255 times a value of 0..1, cut to a whole number."""
    return F.floor(value * 255.0).cast("int")


def salt_pepper(volume: DataFrame, snr: float, seed: int = 0) -> DataFrame:
    """255 or 0 in equal parts of 1 - snr of the (y, x) columns, the same on every plane z."""
    u = rng.uniform(F.lit(seed), F.col("volume_id"), F.concat_ws(",", F.col("y").cast("string"), F.col("x").cast("string")), "noise")
    noisy = F.when(u < snr, F.col("value")).when(u < snr + (1.0 - snr) / 2, F.lit(255.0)).otherwise(F.lit(0.0))
    return volume.withColumn("value", noisy)


def _ball(thresh: int) -> Column:
    """Offsets (j, i) in a plane that are closer than thresh (strictly), each with h: how far the ball goes along z there."""
    span = F.array(*[F.lit(k) for k in range(1 - thresh, thresh)])
    left = lambda j, i: F.lit(thresh * thresh - 1) - j * j - i * i
    pairs = F.flatten(F.transform(span, lambda j: F.transform(span, lambda i: F.struct(j.alias("j"), i.alias("i"), left(j, i).alias("left")))))
    return F.transform(F.filter(pairs, lambda p: p["left"] >= 0), lambda p: F.struct(p["j"].alias("j"), p["i"].alias("i"), F.floor(F.sqrt(p["left"].cast("double"))).cast("int").alias("h")))


def dilated(ones: DataFrame, thresh: int) -> DataFrame:
    """volume_id, y, x, word and bits (bit k: z = 64 * word + k) of all places closer than thresh to one of ones
    (volume_id, z, y, x).

    Ones are gathered as words along z. A word is widened along z bit by bit, all of its places at once, with the words
    beside it; its widths go to the lines around it that have these reaches. So a word makes a row, or a few, for each line
    of the ball, whatever it holds.
    """
    sides = -(-(thresh - 1) // 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("z"), F.lit(64)).cast("int"))
    words = ones.groupBy("volume_id", "y", "x", F.floor(F.col("z") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    zero = F.lit(0).cast("long")
    up = lambda c, k: F.call_function("shiftleft", c, F.lit(k))
    down = lambda c, k: F.call_function("shiftrightunsigned", c, F.lit(k))
    size = 2 * sides + 1

    def wider(w: Column) -> Column:
        at = [F.get(w, F.lit(k)) for k in range(size)]
        parts = []
        for k, c in enumerate(at):
            c = c.bitwiseOR(up(c, 1)).bitwiseOR(down(c, 1))
            c = c.bitwiseOR(down(at[k - 1], 63)) if k else c
            parts.append(c.bitwiseOR(up(at[k + 1], 63)) if k + 1 < size else c)
        return F.array(*parts)

    first = F.array(F.array(*[F.col("bits") if k == sides else zero for k in range(size)]))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(thresh - 1)), first, lambda a, _: F.concat(a, F.array(wider(F.element_at(a, -1))))) if thresh > 1 else first
    around = words.withColumn("grown", grown).withColumn("o", F.explode(_ball(thresh)))
    around = around.select("volume_id", (F.col("y") + F.col("o.j")).alias("y"), (F.col("x") + F.col("o.i")).alias("x"), "word", F.posexplode(F.get("grown", F.col("o.h"))).alias("k", "bits"))
    return around.filter("bits != 0").groupBy("volume_id", "y", "x", (F.col("word") + F.col("k") - sides).alias("word")).agg(F.bit_or("bits").alias("bits"))


def wrap(volume: DataFrame, thresh: int = 0, mode: str = "observed") -> DataFrame:
    """127 around the ones of a binary volume.

    "observed": only the first voxel that a scan by z, y, x reaches is written. "dilate": every voxel within
    thresh of a one that isn't one itself. The volume's values must be 0 and 1, both present.
    """
    if mode not in ("observed", "dilate"):
        raise ValueError("mode is observed or dilate")
    kinds = volume.groupBy("volume_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max((~F.col("value").isin(0.0, 1.0)).cast("int")).alias("odd"))
    binary = (F.col("lo") == 0) & (F.col("hi") == 1) & (F.col("odd") == 0)
    kinds = kinds.select("volume_id", F.when(binary, F.lit(True)).otherwise(F.raise_error(F.lit("the volume is not binary"))).alias("__ok"))
    checked = volume.join(kinds, "volume_id").filter("__ok").drop("__ok")
    if thresh < 1:
        return checked
    ones, where = checked.filter("value = 1"), ["volume_id", "z", "y", "x"]
    if mode == "observed":
        # The scan ends at its first one: of the places around that alone, the first inside the volume.
        first = ones.groupBy("volume_id").agg(F.min(F.struct("z", "y", "x")).alias("at"))
        around = first.withColumn("o", F.explode(_ball(thresh))).withColumn("k", F.explode(F.sequence(-F.col("o.h"), F.col("o.h"))))
        around = around.select("volume_id", (F.col("at.z") + F.col("k")).alias("z"), (F.col("at.y") + F.col("o.j")).alias("y"), (F.col("at.x") + F.col("o.i")).alias("x"))
        hit = around.join(checked.select(*where), where).groupBy("volume_id").agg(F.min(F.struct("z", "y", "x")).alias("h"))
        hit = hit.select("volume_id", "h.z", "h.y", "h.x", F.lit(127.0).alias("__to"))
        return checked.join(hit, where, "left").withColumn("value", F.coalesce("__to", "value")).select(*volume.columns)
    near = dilated(ones, thresh)
    placed = checked.withColumn("word", F.floor(F.col("z") / 64)).join(near, ["volume_id", "y", "x", "word"], "left")
    reached = F.call_function("getbit", F.coalesce("bits", F.lit(0).cast("long")), F.pmod(F.col("z"), F.lit(64)).cast("int")) == 1
    return placed.withColumn("value", F.when((F.col("value") == 0) & reached, F.lit(127.0)).otherwise(F.col("value"))).select(*volume.columns)


def resize_nearest(volume: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """Nearest-neighbour resize of (z, y, x): each target place takes floor(place * source / target)."""
    out = volume
    for c, n, m in zip("zyx", source, target):
        # The places that take from here: those with floor(d * n / m) = c.
        first = F.ceil(F.col(c) * F.lit(m) / F.lit(n)).cast("int")
        last = (F.ceil((F.col(c) + 1) * F.lit(m) / F.lit(n)) - 1).cast("int")
        last = F.least(last, F.lit(m - 1))
        out = out.withColumns({"__a": first, "__b": last}).filter("__a <= __b").withColumn(c, F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")
    return out


def _mean(volume: DataFrame, c: str, spread: DataFrame, weight: Column) -> DataFrame:
    """volume along one axis, of rows with their target place __d and its weight."""
    others = [k for k in ("volume_id", "z", "y", "x") if k != c]
    spread = spread.withColumn("__w", weight).filter(F.col("__w") > 1e-9)
    mean = spread.groupBy(*others, F.col("__d").alias(c)).agg((F.sum(F.col("value") * F.col("__w")) / F.sum("__w")).alias("value"))
    return mean.select("volume_id", "z", "y", "x", "value")


def _by_overlap(volume: DataFrame, c: str, n: int, m: int) -> DataFrame:
    """Mean along one axis by overlap, n places to m (no more than n)."""
    scale = n / m
    first = F.floor(F.col(c) / F.lit(scale)).cast("int")
    last = F.least(F.lit(m - 1), (F.ceil((F.col(c) + 1) / F.lit(scale)) - 1).cast("int"))
    spread = volume.withColumn("__d", F.explode(F.sequence(first, F.greatest(first, last))))
    return _mean(volume, c, spread, F.least((F.col("__d") + 1) * F.lit(scale), F.col(c) + 1.0) - F.greatest(F.col("__d") * F.lit(scale), F.col(c).cast("double")))


def _by_neighbours(volume: DataFrame, c: str, n: int, m: int) -> DataFrame:
    """Along one axis, n places to m: place d lies at s = floor(d n / m) and takes (d + 1) - (s + 1) m / n, where that is
    above 0 without its whole part, of the place behind s, and the rest of s; the last place has none behind it."""
    # The places that s, or the place before s, gives to.
    first = F.greatest(F.lit(0), F.ceil((F.col(c) - 1) * F.lit(m) / F.lit(n)).cast("int"))
    last = F.least(F.lit(m - 1), (F.ceil((F.col(c) + 1) * F.lit(m) / F.lit(n)) - 1).cast("int"))
    spread = volume.withColumn("__d", F.explode(F.sequence(first, F.greatest(first, last))))
    s = F.floor(F.col("__d") * F.lit(n) / F.lit(m))
    part = (F.col("__d") + 1) - (s + 1) * F.lit(m) / F.lit(n)
    part = F.when((s >= n - 1) | (part <= 0), F.lit(0.0)).otherwise(part - F.floor(part))
    return _mean(volume, c, spread, F.when(s == F.col(c), F.lit(1.0) - part).when(s + 1 == F.col(c), part).otherwise(F.lit(0.0)))


def resize_area(volume: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int], level: float = 0.1) -> DataFrame:
    """Area resize of (z, y, x), in the plane, then in depth; after each, values above level become 1.

    Means are by overlap where nothing is enlarged. Where an axis of the plane is, both of its axes are by neighbours.
    """
    high = F.when(F.col("value") > level, F.lit(1.0)).otherwise(F.col("value"))
    one = _by_neighbours if target[1] > source[1] or target[2] > source[2] else _by_overlap
    plane = one(one(volume, "x", source[2], target[2]), "y", source[1], target[1]).withColumn("value", high)
    deep = _by_neighbours if target[0] > source[0] else _by_overlap
    return deep(plane, "z", source[0], target[0]).withColumn("value", high)


def int8_wrap(value: Column) -> Column:
    """255 times a mask as a signed byte: 1 becomes -1."""
    return (F.pmod(value.cast("long") * 255 + 128, F.lit(256)) - 128).cast("tinyint")


def transpose(volume: DataFrame) -> DataFrame:
    """Axes (x, y, z) to pages (z, x, y): page, row, column."""
    return volume.withColumnsRenamed({"z": "page", "x": "row", "y": "column"})
