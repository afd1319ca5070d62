"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is the bag of its runs of five words (split at white space; all words where there are fewer). A
shingle weighs its count times 1 + IDF_WEIGHT * ln((N + 1) / (df + 1)), where df counts the documents of
its bucket in a table of 2**DF_BITS buckets over the whole corpus, as hashed TF-IDF does. HASHES
consistent samples (Ioffe 2010) are drawn per text; two texts agree on one with the probability of
their weighted Jaccard similarity. Samples are banded, ROWS to a band, and texts that share a band are
candidates (at 0.8: 99.7 % of pairs).

Candidates are verified by their weighted Jaccard similarity, LIKE or more being a link. Within a
bucket every text is compared with the bucket's smallest, which costs one pair per row. Then the
buckets that still hold several components are settled: their texts are dealt into blocks of at most
BLOCK texts and BLOCK_CHARS characters, a task compares one pair of blocks by matrix products over the
shingles they share, and one spanning edge per text leaves it. So every pair of a bucket that could join
two components is decided, and pairs are never rows of a table.

Every row has a key of its own, so rows are tied by their texts alone. Of a class the row with the smallest
doc_id is kept, then the one whose text has the smallest hash.

Edge cases: a null text is empty; a text without words is linked with nothing, such rows are all kept; equal
texts are always in one class; rows that share a doc_id, or have none, are documents of their own, so class_id
names their class only together with the kept row's text; a null doc_id comes first; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lean, packed, released, stored, table, unpacked
from .components import components

WORDS, LIKE = 5, 0.8
BANDS, ROWS = 8, 3
HASHES = BANDS * ROWS
DF_BITS, DF_BLOCK = 18, 4096
IDF_WEIGHT = 0.05
_TABLE_BITS = 16
BLOCK, BLOCK_CHARS, _COLUMNS = 256, 4_000_000, 4096
_CACHE = 150_000
_SHINGLES = 1 << 18


class _Words(dict):
    """Row numbers of words in a table of 64-bit hashes, kept for a bounded number of them."""

    def __init__(self):
        self.table = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = i
        return i

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > _CACHE:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[rows]


def shingles(text: str | None, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes in order, and their counts."""
    words = text.split() if text else []
    h = known.hashes(words)
    size = min(WORDS, len(h))
    if not size:
        return h, np.zeros(0, dtype=np.int64)
    run = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for j in range(size):
        run = (run ^ h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(31)
    return np.unique(run, return_counts=True)


def factors(counts: np.ndarray, documents: int) -> np.ndarray:
    """ln of the weight of a shingle of count one, by bucket."""
    return np.log(1.0 + IDF_WEIGHT * np.log((documents + 1.0) / (counts + 1.0))).astype(np.float32)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The number of documents by bucket of the shingle hash; the table's size does not grow."""

    @released
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = _Words(), np.zeros(1 << DF_BITS, dtype=np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                found, _ = shingles(text, words)
                # A bucket counts a document as often as it has shingles there.
                np.add.at(total, (found >> np.uint64(64 - DF_BITS)).astype(np.int64), 1)
        if total.any():
            blocks = total.reshape(-1, DF_BLOCK)
            yield pd.DataFrame({"block": np.arange(len(blocks)), "counts": [b.astype("<i4").tobytes() for b in blocks]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DF_BLOCK, dtype=np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, dtype="<i4")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    parts = texts.select("text").mapInPandas(counted, "block long, counts binary").groupBy("block").applyInPandas(summed, "block long, counts binary")
    out = np.zeros((1 << DF_BITS) // DF_BLOCK * DF_BLOCK, dtype=np.int64)
    for row in parts.collect():  # always 2**DF_BITS numbers
        out[row["block"] * DF_BLOCK : (row["block"] + 1) * DF_BLOCK] = np.frombuffer(bytes(row["counts"]), dtype="<i8")
    return out


def _tables() -> tuple[np.ndarray, ...]:
    """r, ln c, beta and the multipliers that choose from them: fixed numbers."""
    rng = np.random.RandomState(11)
    size = (HASHES, 1 << _TABLE_BITS)
    r = rng.gamma(2.0, 1.0, size).astype(np.float32)
    ln_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
    beta = rng.random_sample(size).astype(np.float32)
    return r, ln_c, beta, rng.randint(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Sampler:
    """Consistent weighted samples; r, ln c and beta of a shingle come from tables by its hash."""

    def __init__(self, lift: np.ndarray):
        self.lift, self.tables, self.words = lift, None, _Words()

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return shingles(text, self.words)

    def weights(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """ln of the weights."""
        return np.log(counts).astype(np.float32) + self.lift[(found >> np.uint64(64 - DF_BITS)).astype(np.int64)]

    def bands(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Band keys (bags x BANDS) of bags that are not empty."""
        lengths = np.array([len(b[0]) for b in bags])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(bags)), lengths)
        found = np.concatenate([b[0] for b in bags])
        ln_w = self.weights(found, np.concatenate([b[1] for b in bags]))
        mixed = np.uint64(0xC2B2AE3D27D4EB4F)
        self.tables = self.tables or _tables()
        r_of, ln_c_of, beta_of, odd = self.tables
        keys = np.zeros((len(bags), BANDS), dtype=np.uint64)
        for k in range(HASHES):
            i = (found * odd[k] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            r, beta = r_of[k][i], beta_of[k][i]
            t = np.floor(ln_w / r + beta)
            a = ln_c_of[k][i] - r * (t - beta + np.float32(1.0))
            at = np.flatnonzero(a == np.minimum.reduceat(a, starts)[owner])
            at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]
            sample = (found[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0x165667B19E3779F9))) * mixed
            band = k // ROWS
            keys[:, band] = (keys[:, band] ^ (sample ^ (sample >> np.uint64(29)))) * mixed + np.uint64(k + 1)
        return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (hashes in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    high = float(a[1].sum()) + float(b[1].sum()) - low
    return low / high if high > 0 else 0.0


def marked(found: np.ndarray, counts: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag as a set: one mark per shingle and count up to its own, with the weight of a single one.

    The weighted Jaccard similarity of two bags is that of these sets by weight.
    """
    each = np.repeat(found, counts)
    order = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    return each + order.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.repeat(factor, counts)


def linked(bags: list[tuple[np.ndarray, np.ndarray]], split: int, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a similarity of at least `like`: between the first `split` and the rest, or all if split is 0."""
    marks, owner = np.concatenate([b[0] for b in bags]), np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    weights = np.concatenate([b[1] for b in bags])
    total = np.bincount(owner, weights=weights, minlength=len(bags))
    kinds, place, times = np.unique(marks, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    owner, weights, place = owner[shared], weights[shared], (np.cumsum(times > 1) - 1)[place[shared]]
    turn = np.argsort(place, kind="stable")
    owner, weights, place = owner[turn], weights[turn], place[turn]
    rows = slice(0, split) if split else slice(0, len(bags))
    columns = slice(split, len(bags)) if split else rows
    low = np.zeros((rows.stop - rows.start, columns.stop - columns.start))
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        a, b = np.searchsorted(place, [first, first + _COLUMNS])
        part = np.zeros((len(bags), _COLUMNS))
        part[owner[a:b], place[a:b] - first] = np.sqrt(weights[a:b])
        low += part[rows] @ part[columns].T
    high = total[rows][:, None] + total[columns][None, :] - low
    i, j = np.nonzero(low >= like * high - 1e-9)
    i, j = i + rows.start, j + columns.start
    return (i, j) if split else (i[i < j], j[i < j])


def signatures(rows: DataFrame, lift) -> DataFrame:
    """__doc, doc_id, the text's length, its two 64-bit hashes (null without words) and its band keys."""

    @released
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Sampler(lift.value)
        for pdf in batches:
            done: list = []
            held, size = [], 0

            def flush():
                nonlocal held, size
                full = [b for b in held if len(b[1][0])]
                keys = iter(own.bands([b[1] for b in full])) if full else iter(())
                for (hi, lo), bag in held:
                    done.append((hi, lo, next(keys).tolist()) if len(bag[0]) else (None, None, []))
                held, size = [], 0

            for text in pdf["text"]:
                h = xxhash.xxh3_128_intdigest((text or "").encode("utf-8", "surrogatepass"))
                bag = own.shingles(text)
                held.append((((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)), bag))
                size += len(bag[0])
                if size >= _SHINGLES:
                    flush()
            flush()
            yield pd.DataFrame({"__doc": pdf["__doc"], "its": pdf["its"], "none": pdf["none"], "size": pdf["text"].map(len), "hi": pd.array([d[0] for d in done], dtype="Int64"), "lo": pd.array([d[1] for d in done], dtype="Int64"), "keys": [d[2] for d in done]})

    # A null id would make pandas' column one of floats.
    ids = rows.select("__doc", F.coalesce("doc_id", F.lit(0).cast("long")).alias("its"), F.isnull("doc_id").alias("none"), "text")
    done = ids.mapInPandas(signed, "__doc long, its long, none boolean, size long, hi long, lo long, keys array<long>")
    return done.withColumn("doc_id", F.when(~F.col("none"), F.col("its"))).drop("its", "none")


def verified(pairs: DataFrame, rows: DataFrame, lift) -> DataFrame:
    """pairs (a, b) with the weighted Jaccard similarity of their texts."""
    texts = rows.select("__doc", "text")

    @released
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, bag = Sampler(lift.value), None, None

        def bagged(text: str):
            found, counts = own.shingles(text)
            return found, np.exp(own.weights(found, counts).astype(np.float64))

        for pdf in batches:
            out = []
            for left, right in zip(pdf["left_text"], pdf["right_text"]):
                if bag is None or left != last:
                    last, bag = left, bagged(left)
                out.append(similarity(bag, bagged(right)))
            yield pdf[["a", "b"]].assign(like=out)

    right = pairs.join(texts, F.col("b") == F.col("__doc")).select("a", "b", F.col("text").alias("right_text"))
    both = right.join(texts, F.col("a") == F.col("__doc")).select("a", "b", F.col("text").alias("left_text"), "right_text")
    return both.mapInPandas(compared, "a long, b long, like double").groupBy("a", "b").agg(F.max("like").alias("like"))


def settled(placed: DataFrame, rows: DataFrame, lift, like: float) -> DataFrame:
    """Spanning links (a, b) of the texts of buckets (band, key, b, component, blocks), block pair by block pair."""
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "b", "component")
    texts = rows.select("__doc", "text")
    order = ["band", "key", "one", "two"]
    dealt = dealt.join(texts, F.col("b") == F.col("__doc")).drop("__doc").repartition(*order).sortWithinPartitions(*order, "block", "b")

    @released
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known, rest = Sampler(lift.value), {}, None

        def bag(doc: int, text: str):
            if (doc, len(text)) not in known:
                if len(known) >= 4 * BLOCK:
                    known.clear()
                found, counts = own.shingles(text)
                known[doc, len(text)] = marked(found, counts, np.exp(own.lift[(found >> np.uint64(64 - DF_BITS)).astype(np.int64)].astype(np.float64)))
            return known[doc, len(text)]

        def group(blocks: np.ndarray, crossing: bool, ids: np.ndarray, parts: np.ndarray, texts: np.ndarray, out: list):
            split = int(np.searchsorted(blocks, blocks[-1])) if crossing else 0
            if len(ids) < 2 or (crossing and not split) or (parts == parts[0]).all():
                return
            i, j = linked([bag(d, t) for d, t in zip(ids.tolist(), texts)], split, like)
            i, j = i[parts[i] != parts[j]], j[parts[i] != parts[j]]
            # Each text's smallest neighbour over all paths: enough to span what is linked here.
            least = np.arange(len(ids))
            while True:
                low = np.minimum(least[i], least[j])
                if (least[i] == low).all() and (least[j] == low).all():
                    break
                np.minimum.at(least, i, low)
                np.minimum.at(least, j, low)
            moved = np.flatnonzero(least != np.arange(len(ids)))
            out.append((ids[moved], ids[least[moved]]))

        def groups(frame: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            out: list = [(np.zeros(0, dtype=np.int64),) * 2]
            own_block, ids, parts, texts = (frame[c].to_numpy() for c in ("block", "b", "component", "text"))
            crossing = frame["one"].to_numpy() != frame["two"].to_numpy()
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                group(own_block[a:b], bool(crossing[a]), ids[a:b], parts[a:b], texts[a:b], out)
            return pd.DataFrame({"a": np.concatenate([x[0] for x in out]), "b": np.concatenate([x[1] for x in out])})

        for pdf in batches:
            rest = pdf if rest is None or not len(rest) else pd.concat([rest, pdf], ignore_index=True)
            mark = rest[order].to_numpy()
            ends = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            if len(ends):
                yield groups(rest, ends)
                rest = rest.iloc[ends[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield groups(rest, np.array([len(rest)]))

    return dealt.mapInPandas(compared, "a long, b long").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct with a key of each row, __doc. They are stored, as keys made again could be others."""
    return stored(packed(docs).withColumn("__doc", F.monotonically_increasing_id()))


def classed(docs: DataFrame, like: float) -> DataFrame:
    """__doc, doc_id, class_id (the smallest doc_id of its group) and kept of every row of docs (__doc, doc_id, text)."""
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select("__doc", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    lift = spark.sparkContext.broadcast(factors(document_frequencies(rows), n))
    signed = checkpointed(signatures(rows, lift))
    worded = signed.filter("hi is not null")
    groups = checkpointed(worded.groupBy("hi", "lo").agg(F.min("__doc").alias("text_id"), F.min(F.struct("doc_id", "__doc")).alias("first")))
    members = checkpointed(worded.join(groups, ["hi", "lo"]).select("__doc", "doc_id", "text_id", "first", "size", F.when(F.col("__doc") == F.col("text_id"), F.col("keys")).alias("keys")))
    banded = members.filter("keys is not null").select(F.col("__doc").alias("b"), "size", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    banded = checkpointed(banded.join(buckets, ["band", "key"]))
    tried = checkpointed(verified(banded.filter("a != b").select("a", "b").distinct(), rows, lift))
    links = tried.filter(F.col("like") >= like).select("a", "b")
    found = components(links)
    # Buckets that still hold several components: their texts against each other, across components only.
    label = found.select(F.col("id").alias("b"), "component")
    placed = banded.join(label, "b", "left").select("band", "key", "b", "size", F.coalesce("component", "b").alias("component"))
    open_ = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    open_ = checkpointed(open_.filter("lo != hi").select("band", "key", blocks.alias("blocks")))
    if not open_.isEmpty():
        # What was found is a forest of stars: only these and the new links are gone through again.
        stars = found.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(stars.unionByName(checkpointed(settled(placed.join(open_, ["band", "key"]), rows, lift, like))))
    # Texts that are linked get the first row of their component; the others their own.
    linked_ = found.select(F.col("id").alias("text_id"), "component").join(groups, "text_id")
    heads = linked_.groupBy("component").agg(F.min(F.struct("first.doc_id", "hi", "lo", "first.__doc")).alias("head"))
    heads = linked_.select("text_id", "component").join(heads, "component").select("text_id", F.struct("head.doc_id", "head.__doc").alias("head"))
    worded = members.join(heads, "text_id", "left").select("__doc", "doc_id", F.coalesce("head", "first").alias("head"))
    out = worded.unionByName(signed.filter("hi is null").select("__doc", "doc_id", F.struct("doc_id", "__doc").alias("head")))
    return out.select("__doc", "doc_id", F.col("head.doc_id").alias("class_id"), (F.col("__doc") == F.col("head.__doc")).alias("kept"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("__doc", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group) and kept (one row of its class is) of every row of docs (doc_id, text)."""
    return classed(_named(keyed(docs.select("doc_id", "text"))), like).drop("__doc")


def one_of_each(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """The first row of each class, with its columns."""
    rows = keyed(docs)
    kept = classed(_named(rows), like).filter("kept").select(F.col("__doc").alias("__kept"))
    return unpacked(rows.join(kept, F.col("__doc") == F.col("__kept"), "left_semi"), docs.columns)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash": op7_minhash}
SQL: dict[str, str] = {}
