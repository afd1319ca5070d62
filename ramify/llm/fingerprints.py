"""Document fingerprints by one-permutation MinHash, on DataFrame functions only.

Each shingle of five words is hashed once; the hash's top bits choose one of BINS bins and the rest is
kept as the bin's minimum. An empty bin takes the value of a full bin found by probing in an order that
depends on the empty bin alone, so equal sets of full bins are filled equally (optimal densification).
Of each bin's value the low BITS bits are stored, one hexadecimal digit a bin. Two fingerprints agree in
a share J + (1 - J) / 2**BITS of their bins; likeness() takes that bias out.

Edge cases: a null text is empty; words split at ASCII white space; a text of one to four words is one
shingle; a text without words has a fixed fingerprint of its own, so it is like every other such text
and unlike the rest. Rows that share a doc_id count as one neighbour, the one with the longest text (of these,
with the largest hash); a null doc_id comes last. One document is its own next. Other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

BIN_BITS, BITS, WORDS = 8, 4, 5
BINS = 1 << BIN_BITS
#: Probes of the densification that are tried one by one; what they miss is settled by hash order.
PROBES = 16
#: Ids of a range of neighbours.
RANGE = 100_000
_EMPTY = (1 << (63 - BIN_BITS)) - 1


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of all runs of five words (of all words where there are fewer)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(h) - (WORDS - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(WORDS)]))
        return F.when(F.size(h) >= WORDS, run).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def bin_minima(hashes: Column) -> Column:
    """The least rest of each bin as an array of BINS numbers; an empty bin has _EMPTY."""
    width = 63 - BIN_BITS
    packed = F.transform(hashes, lambda h: F.shiftleft(F.shiftrightunsigned(h, 64 - BIN_BITS), width).bitwiseOR(h.bitwiseAND(F.lit(_EMPTY))))
    marks = F.array(*[F.lit((b << width) | _EMPTY) for b in range(BINS)])
    ordered = F.sort_array(F.concat(packed, marks))
    first = lambda v: F.filter(v, lambda x, i: (i == 0) | (F.shiftright(x, width) != F.shiftright(F.get(v, i - 1), width)))
    return F.transform(let(ordered, first), lambda x: x.bitwiseAND(F.lit(_EMPTY)))


def densified(minima: Column) -> Column:
    """Minima with every empty bin filled from a full one; all _EMPTY where no bin is full."""
    rng = random.Random(20170706)
    probes = [F.array(*[F.lit(rng.randrange(BINS)) for _ in range(BINS)]) for _ in range(PROBES)]

    def fill(v: Column) -> Column:
        full = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != _EMPTY)

        def filled(s: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                tried = [F.nullif(F.get(v, F.get(p, j)), F.lit(_EMPTY)) for p in probes]
                rest = F.array_min(F.transform(s, lambda f: F.struct(F.xxhash64(j, f["i"]).alias("h"), f["x"].alias("x"))))["x"]
                return F.when(x != _EMPTY, x).otherwise(F.coalesce(*tried, rest, F.lit(_EMPTY)))

            return F.transform(v, one)

        return let(full, filled)

    return let(minima, fill)


def fingerprint(text: Column) -> Column:
    """BINS hexadecimal digits."""
    digits = F.array(*[F.lit(d) for d in "0123456789abcdef"])
    packed = F.transform(densified(bin_minima(shingle_hashes(text))), lambda x: F.get(digits, x.bitwiseAND(F.lit(15)).cast("int")))
    blank = (text == "") | ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, F.repeat(F.lit("-"), BINS)).otherwise(F.array_join(packed, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of the shingles behind two fingerprints, 0 to 1."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1.0 - chance)))


def neighbours(ids: DataFrame, groups: int) -> DataFrame:
    """doc_id, n_chars and next_id (the next smaller, after the smallest the largest) of distinct ids.

    Ids are dealt by value into ranges; only each range's ends meet in one task.
    """
    ranged = checkpointed(ids.repartitionByRange(groups, "doc_id").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last())
    ranged = ranged.withColumn("next_id", F.lead("doc_id").over(inside))
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    across = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    first = F.first("top").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select(F.col("range").alias("__range"), F.coalesce(F.lead("top").over(across), first).alias("below"))
    # One row per range, of which there is one for every RANGE ids.
    return ranged.join(F.broadcast(tops), ranged["range"] == tops["__range"]).select("doc_id", "n_chars", F.coalesce("next_id", "below").alias("next_id"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and the next document's."""
    none = F.lit(-(1 << 63))  # stands for a null id
    rows = docs.select(F.coalesce("doc_id", none).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Shared ids: one neighbour, and as many characters as its longest text may ask for.
    ids = checkpointed(rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars")))
    links = checkpointed(neighbours(ids, max(16, -(-ids.count() // RANGE))))
    asked = links.select(F.col("doc_id").alias("asks"), F.col("next_id").alias("its_id"), F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"))
    # Rows that share an id: the one whose fingerprint counts as the neighbour's gives its head too.
    rank = F.struct(F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("order"), F.expr("substring(text, 1, wanted)").alias("head"))
    heads = rows.join(asked, rows["doc_id"] == asked["its_id"]).groupBy("asks").agg(F.max(rank)["head"].alias("head"))
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("head"), F.lit(1), m))
    prints = rows.join(heads, rows["doc_id"] == heads["asks"]).select("doc_id", n.cast("long").alias("n_chars"), F.array("text", edited).alias("__texts"))
    # Both texts go through one expression, and each fingerprint is computed once.
    prints = prints.select(
        "doc_id", "n_chars", F.sha2(F.col("__texts")[1], 256).alias("edited_sha256"), F.transform("__texts", fingerprint).alias("__prints"), F.xxhash64(F.col("__texts")[0]).alias("__order")
    )
    prints = checkpointed(prints.select("doc_id", "n_chars", "edited_sha256", F.col("__prints")[0].alias("fingerprint"), F.col("__prints")[1].alias("edited_fingerprint"), "__order"))
    follow = prints.groupBy(F.col("doc_id").alias("its_id")).agg(F.max(F.struct("n_chars", "__order", "fingerprint"))["fingerprint"].alias("next_print"))
    follow = links.select(F.col("doc_id").alias("asks"), "next_id").join(follow, F.col("next_id") == F.col("its_id")).select("asks", "next_print")
    out = prints.join(follow, prints["doc_id"] == follow["asks"])
    return out.select(
        F.nullif("doc_id", none).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
SQL: dict[str, str] = {}
