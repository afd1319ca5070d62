"""Sharding by balanced label propagation: linked rows come together in a shard, and shards hold equally many rows.

Links are those between rows with equal texts (128 bits of hash), and a text's rows are a hub: a row's neighbours are the
other rows of its hub. A hub's rows begin dealt over the shards. In a round the rows of a hub that lie in one shard, a
cell, ask for the shard where most of their neighbours are, of those that have room or would give rows in turn. Quotas
say how many rows go from one shard to another: as many as come the other way, and what room the shard has that they ask
for, for the largest gains first. Cells are known by their counts, so that a hub of any size is a few numbers in one row: a
round is a sum over cells, by pair of shards and class of gain, and a projection with the quotas, a number of rows for each
pair. A round leaves no shard over its share that was not so before. Rounds end when nothing moves, or after ROUNDS.

Then rows get places. Every row has a key, and its rank in its hub follows from counts of slices of keys, so no task sees
a hub. Rows without links fill the shards' rooms. Rows are numbered within their shards, linked ones first; numbers
beyond a shard's share go to the rooms of others, which happens to linked rows only where rows without links are too few.

Edge cases: a null text is empty and linked with empty ones; rows that share a doc_id, or have none, and repeated rows are
rows of their own; with fewer rows than shards the last shards are empty; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, stored, table

SHARDS, ROUNDS = 16, 12
#: Slices of a hub's or a shard's rows: the unit that is numbered in a task.
SLICES = 1024
#: Slices of a class of gain, of which quotas take whole ones and a part of the last.
CLASS = 64

_HUB = ["h1", "h2"]


def shares(rows: int, shards: int) -> list[int]:
    """Rows of every shard: at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the hub and a key of every row of docs (doc_id, text), stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    data = text.cast("binary")
    hub = {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text, F.lit(2))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *[v.alias(k) for k, v in hub.items()])
    return stored(rows.withColumn("key", F.monotonically_increasing_id()))


def _turned(c: Column, shards: int) -> Column:
    return F.pmod(c, F.lit(shards)).cast("int")


def dealt(hubs: DataFrame, shards: int) -> DataFrame:
    """Hubs (h1, h2, total) with at: how many of their rows begin in each shard, from one that the hub's hash names."""
    numbers = F.array(*[F.lit(j) for j in range(shards)])
    at = lambda j: F.floor(F.col("total") / shards) + F.when(_turned(j - F.col("h1"), shards) < F.col("total") % shards, 1).otherwise(0)
    return hubs.withColumn("at", F.transform(numbers, at))


def targeted(hubs: DataFrame, room: list[int], turn: int = 0) -> DataFrame:
    """Hubs with cells: for every shard j that holds rows of the hub, m (rows), to (the shard that they ask for, j itself
    where they stay) and gain (class and slice, the best least).

    A hub's target is the shard of its largest cell (of equal ones, by a hash of the hub, the shard and the round), or, where
    that has no room and the hub has three cells or more, of its largest cell with room. Smaller cells ask for it; in a shard
    without room they can take the places of rows that leave for theirs.
    """
    n = len(room)
    order = lambda j: F.struct(F.get("at", j).alias("m"), F.xxhash64(*_HUB, j, F.lit(turn)).alias("t"), j.alias("j"))
    cells = F.transform(F.filter(F.array(*[F.lit(j) for j in range(n)]), lambda j: F.get("at", j) > 0), order)
    spare = F.array(*[F.lit(v > 0) for v in room])
    rows = hubs.withColumn("cells", cells).withColumns({"first": F.array_max("cells"), "open": F.array_max(F.filter("cells", lambda c: F.get(spare, c["j"])))})
    target = F.when(F.get(spare, F.col("first.j")) | F.col("open").isNull() | (F.size("cells") == 2), F.col("first")).otherwise(F.col("open"))
    rows = rows.withColumn("target", target)
    size = F.floor(F.log2(F.col("target.m").cast("double"))).cast("int")

    def wish(c: Column) -> Column:
        gain = (63 - size) * CLASS + F.pmod(F.xxhash64(*_HUB, c["j"]), F.lit(CLASS)).cast("int")
        return F.struct(c["j"].alias("j"), c["m"].alias("m"), F.when(c < F.col("target"), F.col("target.j")).otherwise(c["j"]).alias("to"), gain.alias("gain"))

    return rows.select(*_HUB, "total", "at", F.transform("cells", wish).alias("cells"))


def quotas(wishes: list[tuple[int, int, int, int]], room: list[int]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Of wishes (i, j, gain, rows), how far those from i to j are met: all below a gain, and at this gain so many of so
    many rows. Between two shards as many move as the other way, and further ones into a shard's room, best gains first."""
    want: dict[tuple[int, int], int] = {}
    for i, j, _, m in wishes:
        want[i, j] = want.get((i, j), 0) + m
    free = {p: min(m, want.get((p[1], p[0]), 0)) for p, m in want.items()}
    left, out = list(room), {}
    for i, j, gain, m in sorted(wishes, key=lambda w: (w[2], w[0], w[1])):
        swap = min(m, free[i, j])
        free[i, j] -= swap
        more = min(m - swap, max(left[j], 0))
        left[j] -= more
        # What a pair is allowed ends where its swaps and its target's room have ended.
        if swap + more:
            out[i, j] = (gain, swap + more, m)
    return out


def moved(hubs: DataFrame, allowed: dict[tuple[int, int], tuple[int, int, int]], shards: int) -> DataFrame:
    """Hubs (h1, h2, total, at) after the moves that are allowed, with moves: how many rows moved."""
    pairs = [allowed.get((i, j), (-1, 0, 1)) for i in range(shards) for j in range(shards)]
    limit, part, whole = (F.array(*[F.lit(p[k]).cast("long") for p in pairs]) for k in range(3))

    def gone(c: Column) -> Column:
        """A part of a slice moves as whole numbers rounded down, so that no quota is passed."""
        pair = c["j"] * shards + c["to"]
        cut = F.floor(c["m"].cast("decimal(38,0)") * F.get(part, pair) / F.get(whole, pair)).cast("long")
        met = F.when(c["gain"] < F.get(limit, pair), c["m"]).when(c["gain"] == F.get(limit, pair), cut).otherwise(F.lit(0).cast("long"))
        return F.struct(c["j"].alias("j"), c["to"].alias("to"), F.when(c["j"] == c["to"], F.lit(0).cast("long")).otherwise(met).alias("m"))

    rows = hubs.withColumn("gone", F.transform("cells", gone))
    sums = lambda f: F.aggregate(F.transform("gone", f), F.lit(0).cast("long"), lambda a, b: a + b)
    numbers = F.array(*[F.lit(j) for j in range(shards)])
    at = F.transform(numbers, lambda k: F.get("at", k) + sums(lambda g: F.when(g["to"] == k, g["m"]).otherwise(F.lit(0).cast("long")) - F.when(g["j"] == k, g["m"]).otherwise(F.lit(0).cast("long"))))
    return rows.select(*_HUB, "total", at.alias("at"), sums(lambda g: g["m"]).alias("moves"))


#: Hubs of a task in a round.
_HUBS = 100_000


def propagated(hubs: DataFrame, share: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Hubs (h1, h2, total, at) after the rounds."""
    n = len(share)
    hubs = checkpointed(hubs)
    hubs = hubs.coalesce(hubs.count() // _HUBS + 1)
    for turn in range(rounds):
        used = hubs.agg(*[F.sum(F.get("at", F.lit(j))) for j in range(n)]).first()
        room = [s - (u or 0) for s, u in zip(share, used)]
        asking = targeted(hubs, room, turn)
        # At most a row for each pair of shards, class of gain and slice.
        cells = asking.select(F.explode("cells").alias("c")).filter("c.j != c.to").groupBy("c.j", "c.to", "c.gain").agg(F.sum("c.m"))
        allowed = quotas([tuple(r) for r in cells.collect()], room)
        if not allowed:
            break
        after = checkpointed(moved(asking, allowed, n))
        hubs = after.drop("moves")
        if not after.filter("moves > 0").limit(1).count():
            break
    return hubs


def _place(rank: Column, counts: Column, shards: int) -> Column:
    """The first shard whose counts, summed from shard 0, exceed rank."""
    sums = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c)))
    return (F.size(F.filter(sums, lambda s: s <= rank)) - 1).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, hub (h1, h2), shard and slot (from 0, without gaps) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    lean(spark)
    rows = linked_rows(docs)
    number = rows.count()
    share = shares(number, shards)
    piece = F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int")
    # Counts by slice: a hub has SLICES of them at most, and each its rows' first rank.
    slices = rows.groupBy(*_HUB, piece.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    hub = Window.partitionBy(*_HUB)
    upto = hub.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "total": F.sum("n").over(hub)}).filter("total > 1")
    slices = stored(slices.select(*_HUB, "slice", "before", "total"))
    hubs = propagated(dealt(slices.groupBy(*_HUB).agg(F.max("total").alias("total")), shards), share, rounds)
    used = hubs.agg(*[F.sum(F.get("at", F.lit(j))) for j in range(shards)]).first()
    rooms = [max(0, s - (u or 0)) for s, u in zip(share, used)]
    # Rows with links by their rank, the others by chance, in proportion to the rooms.
    known = slices.join(hubs.select(*_HUB, "at"), _HUB).select(*_HUB, "slice", "before", "at")
    own = Window.partitionBy(*_HUB, "slice").orderBy("doc_id", "key")
    ranked = rows.withColumn("slice", piece).join(known, [*_HUB, "slice"], "left").withColumn("rank", F.row_number().over(own) - 1 + F.col("before"))
    chance = F.pmod(F.xxhash64(F.lit(7), *_HUB, "doc_id"), F.lit(max(1, sum(rooms))).cast("long"))
    alone = F.col("at").isNull()
    shard = F.when(alone, _place(chance, F.array(*[F.lit(v).cast("long") for v in rooms]), shards)).otherwise(_place(F.col("rank"), F.col("at"), shards))
    shard = F.least(shard, F.lit(shards - 1))
    kept = stored(ranked.select("doc_id", "size", "text_crc32", *_HUB, "key", shard.alias("want"), alone.cast("int").alias("alone")))
    # Places: linked rows first, by slices again.
    counts = kept.groupBy("want", "alone", piece.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("want").orderBy("alone", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0))).drop("n"))  # 2 * SLICES rows a shard
    got = {r["want"]: r["n"] for r in counts.groupBy("want").agg(F.sum("n").alias("n")).collect()}
    over = [max(0, got.get(j, 0) - share[j]) for j in range(shards)]
    holes = [max(0, share[j] - got.get(j, 0)) for j in range(shards)]
    one = Window.partitionBy("want", "alone", "slice").orderBy("doc_id", *_HUB, "key")
    placed = kept.withColumn("slice", piece).withColumn("rank", F.row_number().over(one) - 1).join(starts, ["want", "alone", "slice"]).withColumn("slot", F.col("rank") + F.col("before"))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    sums = lambda values: [sum(values[:j]) for j in range(len(values))]
    limit = F.get(longs(share), F.col("want"))
    far = F.when(F.col("slot") >= limit, F.get(longs(sums(over)), F.col("want")) + F.col("slot") - limit)
    placed = placed.withColumn("far", far).withColumn("shard", F.when(F.col("far").isNull(), F.col("want")).otherwise(_place(F.col("far"), longs(holes), shards)))
    hole = F.get(longs([got.get(j, 0) for j in range(shards)]), F.col("shard")) + F.col("far") - F.get(longs(sums(holes)), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", *_HUB, "shard", F.when(F.col("far").isNull(), F.col("slot")).otherwise(hole).cast("long").alias("slot"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place, counts at most one apart."""
    rows = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op12_shards": op12_shards}
SQL: dict[str, str] = {}
