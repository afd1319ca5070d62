"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, their stems (first 4, 5 and 6 letters), word pairs and pairs with one
word between, lower-cased and hashed into 2**BITS numbers. Each coordinate has a rate of its own and an L1 term
keeps most weights at zero, so what is left is sent to the executors as a short list of (number, weight).

The model is fitted on a bounded sample of the labelled rows: the first MAX_POSITIVE and MAX_NEGATIVE ids by
a hash of the id, of these, in the same order, those whose features still fit MAX_FEATURES (a row that doesn't fit
is passed over, later ones are not); the intercept is put back to the share of
positives among all labelled rows. Rows whose crc32(doc_id) leaves 2 modulo 4 are never learned from.

Edge cases: a null or empty text has no features and scores the intercept alone; a document with
several labels is positive if one of them is; of rows that share a labelled id the smallest text is learned from;
labels that are null or belong to no document are not used; without any usable label every score is 0; repeated rows
score alike; an empty table gives an empty table; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lean, packed, released, stored, table, unpacked

BITS = 22
THRESHOLD = 0.3
MAX_POSITIVE, MAX_NEGATIVE, MAX_FEATURES = 3000, 6000, 40_000_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 1.0
STEMS = (4, 5, 6)
#: Updates aimed at: a small sample is gone through more often.
UPDATES, MOST_EPOCHS = 24_000, 40
_CACHE = 150_000


class Tokens(dict):
    """Row numbers of words in a table of 64-bit hashes (the word, its stems), for a bounded number of them.

    A stem is a word cut to its first letters: inflected forms of a word share it.
    """

    def __init__(self):
        self.table = np.zeros((1024, 1 + len(STEMS)), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        own = [word, *(f"{n}:{word[:n]}" for n in STEMS)]
        self.table[i] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for x in own]
        self[word] = i
        return i

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > _CACHE:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[rows]  # looked up first: a new word may move the table


def features(text: str | None, tokens: Tokens) -> np.ndarray:
    """Numbers of all n-grams and skip-grams of a text, repeats included."""
    words = text.lower().split() if text else []
    table = tokens.hashes(words)
    h = table[:, 0]
    a, b, shift = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(64 - BITS)
    parts = [table.ravel()]
    for gap, salt in ((1, 0x27D4EB2F165667C5), (2, 0x85EBCA77C2B2AE63)):
        if len(h) > gap:
            parts.append((h[:-gap] * a + (h[gap:] ^ np.uint64(salt))) * b)
    return (np.concatenate(parts) >> shift).astype(np.int64)


def train(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights that are not zero, and the intercept, from distinct features of each row."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.RandomState(7)
    epochs = int(min(MOST_EPOCHS, max(2, UPDATES // max(1, len(rows)))))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rows = [np.append(r, np.int32(size)).astype(np.int32) for r in rows]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    found = np.flatnonzero(np.abs(z[:size]) > L1)
    return found, weights(found), float(weights(np.array([size]))[0])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The labelled rows to learn from (doc_id, text, label) and the number of all, by label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    # At most MAX_POSITIVE + MAX_NEGATIVE ids of 12 bytes, so this side is always small.
    few = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows, counts


def fitting(sizes: list[tuple[int, int]], most: int = MAX_FEATURES) -> list[int]:
    """Ids of (doc_id, size) that fit `most` together, taken by a hash of the id; what doesn't fit is passed over."""
    out, total = [], 0
    for doc, size in sorted(sizes, key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0])):
        if total + size <= most:
            out.append(doc)
            total += size
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights that are not zero, and the intercept."""
    rows, counts = sample(docs, labels)

    @released
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for pdf in batches:
            found = [np.unique(features(t, tokens)).astype("<i4") for t in pdf["text"]]
            yield pdf[["doc_id", "label"]].assign(size=[len(f) for f in found], found=[f.tobytes() for f in found])

    @released
    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [(zlib.crc32(str(i).encode()), i, v, f) for pdf in batches for i, v, f in zip(pdf["doc_id"], pdf["label"], pdf["found"])]
        every.sort(key=lambda x: x[:2])
        if every:
            numbers, weights, intercept = train([np.frombuffer(x[3], dtype="<i4") for x in every], np.array([x[2] for x in every]))
            p = sum(x[2] for x in every)
            q = len(every) - p
            if p and q and counts.get(1) and counts.get(0):
                intercept += float(np.log(counts[1] / counts[0]) - np.log(p / q))
            yield pd.DataFrame({"number": np.append(numbers, -1), "weight": np.append(weights, intercept)})

    # A bounded number of rows, so their sizes may come to the driver and their ids go back.
    held = stored(rows.mapInPandas(hashed, "doc_id long, label int, size long, found binary"))
    ids = fitting([(r["doc_id"], r["size"]) for r in held.select("doc_id", "size").collect()], most)
    held = held.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")
    model = held.select("doc_id", "label", "found").repartition(1).mapInPandas(learned, "number long, weight double").toPandas()
    if not len(model):
        return np.array([], dtype=np.int64), np.array([]), -np.inf
    own = model["number"].to_numpy() >= 0
    return model["number"].to_numpy()[own], model["weight"].to_numpy()[own], float(model["weight"].to_numpy()[~own][0])


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with the column `name` (in place of one that it may have): the probability that a document is toxic."""
    return unpacked(_scores(docs, labels), [c for c in docs.columns if c != name], **{name: F.col("score")})


def _scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs as a struct, and their scores."""
    lean(docs.sparkSession)
    numbers, weights, intercept = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((numbers, weights.astype(np.float64), intercept))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, values, start = sent.value
        tokens, dense = Tokens(), np.zeros(1 << BITS, dtype=np.float32)
        dense[own] = values
        for texts in batches:
            out = np.full(len(texts), start)
            for k, text in enumerate(texts):
                i = features(text, tokens)
                i = np.unique(i[dense[i] != 0.0])
                out[k] += dense[i].sum(dtype=np.float64)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -700, 700))))

    return packed(docs).withColumn("score", score("row.text"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    return unpacked(_scores(docs, labels).filter(F.col("score") < threshold), docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
