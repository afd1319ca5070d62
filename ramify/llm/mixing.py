"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is measured in words and dealt in blocks of BLOCK words. Blocks go to sources by the highest
quotients target / (2 * seats + 1), then each source's blocks go in the same way to its shards (rows dealt by a seeded
hash), which gives every shard a whole number of blocks; the last of a source's is cut to the words that its target
leaves. A shard's rows, put in seeded order, are cut into blocks of BLOCK words. It gives every block as often as its
quota covers it whole, and of the rest the blocks that come first by a seeded hash. So a text is taken or left whole
but where a block's edge runs through it. No row is taken more than `repeats` times.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own and
comes last; rows that share a doc_id stay separate rows, dealt by the digest of their content too where there is one (rows
equal in id and content are dealt to one shard); rows without an id are dealt by their row's key; an empty table
gives an empty table; columns beside those named are carried along where asked for and never looked at, whatever their
names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lean, packed, stored, table, unpacked, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of a block.
BLOCK = 1024
#: Up to so many sources their list is broadcast (a row of some 100 bytes each); more are joined by shuffles.
SOURCES = 50_000
#: A source has a shard for every 256 to 512 of its rows, but no more than SHARDS; a shard is a unit of work.
ROWS_PER_SHARD, SHARDS = 512, 1 << 16


def fill_targets(sizes: list[int], weights: list[float], total: float, repeats: float) -> list[float]:
    """Shares of total by weight; what exceeds repeats * size goes to the others by weight."""
    caps = [repeats * s for s in sizes]
    targets = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes))], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= caps[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(caps[i])
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), at most caps[i] for i; ties go to the earlier.

    A divisor that gives no more than the seats is found by bisection: its allocation is a prefix of
    the order of quotients, and the rest is dealt one by one from a heap.
    """
    v, c = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = min(int(seats), int(c[v > 0].sum())) if len(v) else 0
    if seats <= 0:
        return [0] * len(v)

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(c, np.floor(v / divisor + 0.5).astype(np.int64))

    low, high = float(v[v > 0].min()) / (4.0 * seats + 4.0), 4.0 * float(v.max())
    for _ in range(100):
        middle = (low * high) ** 0.5
        if dealt(middle).sum() <= seats:
            high = middle
        else:
            low = middle
    got = dealt(high)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if got[i] < c[i] and v[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < c[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return got.tolist()


def plan_sources(pdf: pd.DataFrame, weights: tuple[float, ...], repeats: int, block: int) -> pd.DataFrame:
    """Targets and seats of all sources. One row per source: the list of sources is configuration."""
    pdf = pdf.sort_values("key", ignore_index=True)
    sizes = [int(x) for x in pdf["source_size"]]
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    targets = fill_targets(sizes, own, sum(sizes), repeats)
    seats = sainte_lague(targets, int(sum(sizes) / block + 0.5), [-(-repeats * s // block) for s in sizes])
    return pdf[["key", "source_size"]].assign(target=targets, seats=np.array(seats, dtype=np.int64))


def plan_shards(pdf: pd.DataFrame, repeats: int, block: int) -> pd.DataFrame:
    """The words that each shard of one source gives; at most SHARDS rows."""
    pdf = pdf.sort_values("shard", ignore_index=True)
    sizes = [int(x) for x in pdf["shard_size"]]
    seats = sainte_lague([float(s) for s in sizes], int(pdf["seats"].iloc[0]), [-(-repeats * s // block) for s in sizes])
    quota = [min(n * block, repeats * s) for n, s in zip(seats, sizes)]
    left = int(np.floor(float(pdf["target"].iloc[0]) + 0.5)) - sum(quota)
    for k, size in enumerate(sizes):
        move = min(left, repeats * size - quota[k]) if left > 0 else max(left, -quota[k])
        quota[k] += move
        left -= move
    return pdf[["key", "shard", "shard_size", "source_size", "target"]].assign(quota=np.array(quota, dtype=np.int64))


def _number(digest: str, digits: int) -> int:
    return int(digest[:digits], 16)


def chosen(sizes: np.ndarray, quota: int, name: str, block: int) -> np.ndarray:
    """The words taken of each row of a shard, from the sizes in seeded order; blocks are chosen by md5(name|number)."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), dtype=np.int64)
    rounds, rest = divmod(quota, total)
    number = -(-total // block)
    order = np.array(sorted(range(number), key=lambda i: (_number(hashlib.md5(f"{name}|{i}".encode()).hexdigest(), 15), i)), dtype=np.int64)
    own = np.minimum(block, total - np.arange(number, dtype=np.int64) * block)
    part = np.zeros(number + 1, dtype=np.int64)
    part[order] = np.clip(rest - (np.cumsum(own[order]) - own[order]), 0, own[order])
    before = np.cumsum(np.r_[0, part])

    def given(place: np.ndarray) -> np.ndarray:
        """Words that the chosen blocks, cut where they are, give before a place."""
        k = place // block
        return before[k] + np.minimum(place - k * block, part[k])

    ends = np.cumsum(sizes)
    return rounds * sizes + given(ends) - given(ends - sizes)


def dealt(sized: DataFrame, seed: int = 0) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows of sized with their source's key, shard and turn in it, and the hint for tables with a row for each source."""
    hex_ = lambda c, a, n: F.conv(F.substring(c, a, n), 16, 10).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    key: Column = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    content = ["content"] if "content" in sized.columns else []
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("size").cast("string"), *content))
    rows = sized.select("row", "doc_id", "size", key.alias("key"), digest.alias("digest"))
    counts = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    bits = F.length(F.regexp_replace(F.bin(F.floor(F.col("n") / ROWS_PER_SHARD)), "^0$", ""))
    # One row per source.
    few = F.broadcast if counts.count() <= SOURCES else lambda df: df
    shards = few(counts.select("key", F.least(F.lit(SHARDS), F.pow(F.lit(2), bits)).cast("long").alias("shards")))
    shard = (hex_(F.col("digest"), 16, 8) % F.col("shards")).alias("shard")
    return rows.join(shards, "key").select("row", "doc_id", "size", "key", hex_(F.col("digest"), 1, 15).alias("turn"), shard), few


def mix(sized: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, repeats: int = 3, block: int = BLOCK) -> DataFrame:
    """row, doc_id, size, source_size, target and taken of sized (row, doc_id, source, size, and content, if there is one);
    row: a key of each row; content: a digest of its text.

    sized is gone through several times, so it should be a table, not a plan that makes keys anew.
    """
    rows, few = dealt(sized, seed)
    sums = checkpointed(rows.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")))
    sources = sums.groupBy("key").agg(F.sum("shard_size").alias("source_size"))
    sources = sources.groupBy(F.lit("all").alias("all")).applyInPandas(lambda pdf: plan_sources(pdf, weights, repeats, block), "key string, source_size long, target double, seats long")
    quotas = sums.join(few(sources), "key").groupBy("key").applyInPandas(
        lambda pdf: plan_shards(pdf, repeats, block), "key string, shard long, shard_size long, source_size long, target double, quota long"
    )
    quotas = checkpointed(quotas.drop("shard_size"))

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
        name = f"{seed}|{rows['key'][0].as_py()}|{rows['shard'][0].as_py()}"
        taken = chosen(rows["size"].to_numpy().astype(np.int64), rows["quota"][0].as_py(), name, block)
        return rows.select(["row", "doc_id", "size", "source_size", "target"]).append_column("taken", pa.array(taken))

    doc = dict(sized.dtypes)["doc_id"]
    return rows.join(quotas, ["key", "shard"]).groupBy("key", "shard").applyInArrow(shard, f"row long, doc_id {doc}, size long, source_size long, target double, taken long")


def _content(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit(""))).alias("content")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, the last time cut to the words left.

    Returns the columns of docs. Rows that the mix takes no word of are left out.
    """
    lean(docs.sparkSession)
    # Rows are stored with their keys, as keys made again could be others.
    rows = packed(docs).select("row", F.monotonically_increasing_id().alias("key"), word_count(F.col("row.text")).alias("size"), _content(F.col("row.text")))
    rows = stored(rows)
    taken = mix(rows.select(F.col("key").alias("row"), F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", "content"), seed)
    taken = taken.filter("taken > 0").select(F.col("row").alias("its"), "taken")
    both = rows.join(taken, F.col("key") == F.col("its"))
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    lengths = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), ""))
    return unpacked(both.withColumn("words", F.explode(lengths)), docs.columns, text=cut)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's part in the mix of all documents."""
    lean(spark)
    sized = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), _content(F.col("text")))
    return mix(checkpointed(sized)).drop("row")


def _seats(source: str, votes: str, cap: str, seats: str, by: str, tie: str) -> str:
    """Seats by highest quotients, at most cap each, in SQL: a row for each candidate seat, the best of them taken."""
    by = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER ({by}ORDER BY {votes} / (2 * k + 1) DESC, {tie}) place FROM (SELECT *, unnest(range(0, {cap})) k FROM {source}) WHERE {votes} > 0) WHERE place <= {seats})"""


_SQL = f"""WITH RECURSIVE sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size, md5(coalesce(text, '')) content FROM documents),
 counted AS (SELECT *, md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), content)) digest, count(*) OVER (PARTITION BY key) n FROM sized),
 dealt AS (SELECT *, CAST('0x' || substr(digest, 1, 15) AS BIGINT) turn, CAST('0x' || substr(digest, 16, 8) AS BIGINT)
  % CAST(least({SHARDS}, CASE WHEN n < {ROWS_PER_SHARD} THEN 1 ELSE pow(2, length(bin(n // {ROWS_PER_SHARD}))) END) AS BIGINT) shard FROM counted),
 src AS (SELECT key, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY key) - 1 i FROM dealt GROUP BY key),
 fill AS (SELECT 0 it, key, i, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][i % 3 + 1] w, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) l, true op, NULL::DOUBLE target FROM src
  UNION ALL SELECT it + 1, key, i, w, cap, l - coalesce(sum(CASE WHEN op AND share >= cap THEN cap END) OVER (), 0), op AND share < cap, CASE WHEN op AND share >= cap THEN cap ELSE target END
  FROM (SELECT *, bool_or(op AND share >= cap) OVER () again FROM (SELECT *, l * w / sum(CASE WHEN op THEN w END) OVER () share FROM fill)) WHERE again),
 targets AS (SELECT key, i, coalesce(target, l * w / sum(CASE WHEN op THEN w END) OVER ()) target FROM fill WHERE it = (SELECT max(it) FROM fill)),
 wanted AS (SELECT key, i, target, source_size, CAST(floor((SELECT sum(source_size) FROM src) / {BLOCK}.0::DOUBLE + 0.5) AS BIGINT) seats FROM targets JOIN src USING (key, i)),
 given AS (SELECT key, count(*) seats FROM {_seats('wanted', 'target', f'(3 * source_size + {BLOCK - 1}) // {BLOCK}', 'seats', '', 'i')} GROUP BY key),
 shards AS (SELECT key, shard, CAST(sum(size) AS BIGINT) shard_size FROM dealt GROUP BY key, shard),
 asked AS (SELECT key, shard, shard_size, coalesce(seats, 0) seats FROM shards LEFT JOIN given USING (key)),
 dues AS (SELECT key, shard, count(*) q FROM {_seats('asked', 'shard_size::DOUBLE', f'(3 * shard_size + {BLOCK - 1}) // {BLOCK}', 'seats', 'key', 'shard')} GROUP BY key, shard),
 firstly AS (SELECT key, shard, shard_size, least(coalesce(q, 0) * {BLOCK}, 3 * shard_size) quota FROM shards LEFT JOIN dues USING (key, shard)),
 moved AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - sum(quota) OVER (PARTITION BY key) l, sum(3 * shard_size - quota) OVER w - (3 * shard_size - quota) room, sum(quota) OVER w - quota held
  FROM firstly JOIN wanted USING (key) WINDOW w AS (PARTITION BY key ORDER BY shard)),
 quotas AS (SELECT key, shard, shard_size, source_size, target, CAST(quota + CASE WHEN l > 0 THEN greatest(0, least(l - room, 3 * shard_size - quota)) ELSE -greatest(0, least(-l - held, quota)) END AS BIGINT) quota FROM moved),
 blocks AS (SELECT *, least({BLOCK}, shard_size - b * {BLOCK}) own, quota % shard_size AS rest FROM (SELECT *, unnest(range(0, (shard_size + {BLOCK - 1}) // {BLOCK})) b FROM quotas WHERE shard_size > 0)),
 chosen AS (SELECT key, shard, b, greatest(0, least(own, rest - (sum(own) OVER w - own))) part FROM blocks
  WINDOW w AS (PARTITION BY key, shard ORDER BY CAST('0x' || substr(md5(concat_ws('|', '0', key, CAST(shard AS VARCHAR), CAST(b AS VARCHAR))), 1, 15) AS BIGINT), b)),
 placed AS (SELECT *, sum(size) OVER (PARTITION BY key, shard ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) stop FROM dealt),
 taken AS (SELECT doc_id, key, shard, sum(greatest(0, least(stop, b * {BLOCK} + part) - greatest(stop - size, b * {BLOCK}))) extra FROM placed JOIN chosen USING (key, shard)
  WHERE b * {BLOCK} < stop AND (b + 1) * {BLOCK} > stop - size GROUP BY doc_id, key, shard)
 SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN quota // shard_size * size ELSE 0 END + coalesce(extra, 0) AS BIGINT) taken
 FROM dealt JOIN quotas USING (key, shard) LEFT JOIN taken USING (doc_id, key, shard)"""

QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {"op2_mixing": _SQL}
