"""Embedding near-dedup with binary codes under random rotations.

A unit vector x is rotated at random; its code is the signs of the rotated vector, its correction factor
f = <signs / sqrt(D), rotated x>. For another vector y, <signs / sqrt(D), rotated y> / f estimates the
cosine without bias, and its error stays below WIDTH * sqrt((1 - f^2) / f^2 / (D - 1)) with overwhelming
probability (Gao and Long 2024). Codes and factors are made once per vector and stored, with the rotated vector in
steps of a 254th of its range (what that can add to the error is added to the bound). Only these are sent to the
buckets. Vectors are fetched for those members of a bucket alone that have a pair there whose upper bound reaches the
threshold. Their codes come with them and bound each pair once more, so only pairs whose upper bound reaches the threshold
are recomputed exactly, in double precision, and only what the exact cosine confirms is a link.

Pairs to look at share one of several bands of sign bits (as many rotations as the bands need). The bits
of a band grow with the logarithm of the number of vectors, so chance meetings in a bucket do not; the
number of bands is set so that a pair at the threshold shares one with probability RECALL. Equal vectors
are collapsed first (by 128 bits of hash) and counted by their number. A large bucket is cut into blocks of BLOCK
vectors and its block pairs are dealt over the tasks; counts and one spanning edge per vector leave a task,
never the pairs. A pair is counted in the first band that it shares.

Edge cases: vectors that are null, zero or empty, or hold null or non-finite components, link with nothing
and are their own component; vectors of different lengths never link; equal rows are vectors of their
own; rows may share a vec_id; a null vec_id counts as larger than any other; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lean, released, table
from .components import components

THRESHOLD, RECALL, WIDTH, BLOCK = 0.95, 0.999, 5.0, 512
_ROWS, _PAIRS, _STEPS = 20_000, 200_000, 127


def bands(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    bits = max(12, math.ceil(math.log2(max(2, vectors))))
    shared = (1.0 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1.0 - recall) / math.log1p(-shared))


def rotations(dim: int, bits: int) -> np.ndarray:
    """Random orthogonal matrices, one below the other, with `bits` rows at least; the first is the code's."""
    rng = np.random.RandomState(dim)
    out = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-bits // dim)))]
    return np.concatenate(out).astype(np.float32)


def encoded(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, correction factors, rotated vectors in whole steps and the steps' sizes, of unit vectors."""
    turned = unit @ turn.T
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    size = np.maximum(np.abs(turned).max(axis=1), 1e-30) / _STEPS
    return np.packbits(turned > 0, axis=1), factor.astype(np.float32), np.rint(turned / size[:, None]).astype(np.int8), size.astype(np.float32)


def coded(rows: DataFrame, bits: int, number: int) -> DataFrame:
    """vec_id, two hashes of the vector (null where it links with nothing), vec (float64 bytes), keys and its code: signs,
    factor, steps and their size."""

    @released
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        weights = (1 << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
        for pdf in batches:
            names = ("node", "lo", "vec", "keys", "signs", "factor", "steps", "step")
            out: dict[str, list] = {c: [None] * len(pdf) for c in names}
            by_dim: dict[int, list[int]] = {}
            held = {}
            for k, e in enumerate(pdf["embedding"]):
                x = None if e is None else np.asarray([np.nan if v is None else v for v in e] if getattr(e, "dtype", None) == object else e, dtype=np.float64)
                if x is not None and len(x) and np.isfinite(x).all() and x.any() and np.isfinite(np.linalg.norm(x)):
                    held[k] = x + 0.0  # -0.0 is 0.0
                    by_dim.setdefault(len(x), []).append(k)
            for dim, ks in by_dim.items():
                if dim not in known:
                    known[dim] = rotations(dim, bits * number), rotations(dim, 1)
                bands_, turn = known[dim]
                x = np.stack([held[k] for k in ks])
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                for at in range(0, len(ks), 1024):
                    part = unit[at : at + 1024]
                    signs = (part @ bands_[: bits * number].T > 0).reshape(-1, number, bits)
                    own = (signs.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
                    for k, row, v, *its in zip(ks[at : at + 1024], own, x[at : at + 1024], *encoded(part, turn)):
                        b = v.astype("<f8").tobytes()
                        h = xxhash.xxh3_128_intdigest(b)
                        found = ((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), b, row.astype("<u8").tobytes(), its[0].tobytes(), float(its[1]), its[2].tobytes(), float(its[3]))
                        for c, value in zip(names, found):
                            out[c][k] = value
            whole = {c: pd.array(v, dtype="Int64") if c in ("node", "lo") else v for c, v in out.items()}
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64")} | whole)

    return rows.mapInPandas(code, "vec_id long, node long, lo long, vec binary, keys binary, signs binary, factor float, steps binary, step float")


def _pairs(frame: pd.DataFrame, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups (across the two blocks where a group has two), a bounded number at a time."""
    block = frame["block"].to_numpy()
    left, right, size = [], [], 0
    for a, b in zip(starts.tolist(), stops.tolist()):
        n = b - a
        if n < 2:
            continue
        if block[a] != block[b - 1]:
            c = a + int(np.searchsorted(block[a:b], block[b - 1]))
            for i in range(a, c, max(1, _PAIRS // (b - c))):
                ii = np.arange(i, min(c, i + max(1, _PAIRS // (b - c))))
                yield np.repeat(ii, b - c), np.tile(np.arange(c, b), len(ii))
            continue
        if frame["one"].iat[a] != frame["two"].iat[a]:
            continue  # only one of the two blocks has rows here
        i, j = np.triu_indices(n, 1)
        left.append(i + a), right.append(j + a)
        size += len(i)
        if size >= _PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


_GROUP = ["dim", "band", "key", "one", "two"]
_MEMBER = "dim int, band int, key long, one int, two int, block int, id long"


def _groups(frame: pd.DataFrame) -> np.ndarray:
    mark = frame[_GROUP].to_numpy()
    return np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]).any(axis=1)])


def bounded(frame: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Upper bounds of the cosines of pairs of rows of one dimension, by their codes."""
    dim = int(frame["dim"].iloc[0])
    signs = np.unpackbits(np.stack([np.frombuffer(v, dtype=np.uint8) for v in frame["signs"]]), axis=1)[:, :dim]
    signs = np.where(signs > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))
    step, factor = frame["step"].to_numpy(), frame["factor"].to_numpy()
    turned = np.stack([np.frombuffer(v, dtype=np.int8) for v in frame["steps"]]).astype(np.float32) * step[:, None]
    # The steps' own error is half a step in each of dim places, each weighing 1 / sqrt(dim).
    own = WIDTH * np.sqrt(np.maximum(0.0, 1.0 - factor**2) / factor**2 / max(1, dim - 1)) + 1e-4
    rounding = 0.5 * step * math.sqrt(dim)
    return lambda i, j: (np.einsum("ij,ij->i", signs[i], turned[j]) + rounding[j]) / factor[i] + own[i]


def likely(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of whole groups, by their codes, that have a pair whose upper bound reaches the threshold."""
    new, hit, bound = _groups(frame), np.zeros(len(frame), dtype=bool), bounded(frame)
    for i, j in _pairs(frame, new, np.r_[new[1:], len(frame)]):
        near = bound(i, j) >= threshold
        hit[i[near]] = True
        hit[j[near]] = True
    return frame.loc[hit, [*_GROUP, "block", "id"]]


def linked(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """id, links, root and recomputed (pairs, at the first of their rows) of the rows of whole groups that link with a row of
    their group or have such a pair."""
    nodes, times, band = frame["id"].to_numpy(), frame["times"].to_numpy(), frame["band"].to_numpy()
    new = _groups(frame)
    x = np.stack([np.frombuffer(v, dtype="<f8") for v in frame["vec"]])
    keys = np.stack([np.frombuffer(v, dtype="<u8") for v in frame["keys"]])
    norm = np.sqrt((x * x).sum(axis=1))
    links, label, recomputed = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame)), np.zeros(len(frame), dtype=np.int64)
    before, bound = np.arange(keys.shape[1]), bounded(frame)
    for i, j in _pairs(frame, new, np.r_[new[1:], len(frame)]):
        near = bound(i, j) >= threshold
        i, j = i[near], j[near]
        np.add.at(recomputed, i, 1)
        cosine = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        first = ~((keys[i] == keys[j]) & (before < band[i][:, None])).any(axis=1)
        i, j = i[first], j[first]
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
    found = np.flatnonzero(links + recomputed)
    return pd.DataFrame({"id": nodes[found], "links": links[found], "root": nodes[label[found]], "recomputed": recomputed[found]})


def by_group(rows: DataFrame, work, schema: str) -> DataFrame:
    """work over frames of whole groups of one dimension, some at a time."""
    rows = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "block", "id")

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(rest) < _ROWS:
                continue
            mark = rest[_GROUP].to_numpy()
            cut = int(np.flatnonzero((mark != mark[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                for _, own in rest.iloc[:cut].groupby("dim", sort=False):
                    yield work(own.reset_index(drop=True))
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            for _, own in rest.groupby("dim", sort=False):
                yield work(own.reset_index(drop=True))

    return rows.mapInPandas(run, schema)


def link_counts(held: DataFrame, number: int, threshold: float) -> DataFrame:
    """id, links, root and recomputed by group, from distinct vectors (id, times, dim, vec, keys and code)."""
    key = lambda b: F.conv(F.hex(F.substring(F.col("keys"), b * 8 + 1, F.lit(8))), 16, -10).cast("long")
    each = F.transform(F.sequence(F.lit(0), F.lit(max(0, number - 1))), lambda b: F.struct(b.alias("band"), key(b).alias("key")))
    keyed = held.select("id", "dim", F.explode(each).alias("k")).select("id", "dim", "k.band", "k.key")
    sizes = checkpointed(keyed.groupBy("dim", "band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    placed = keyed.join(sizes, ["dim", "band", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("id", "dim", "band", "key", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    code = ["signs", "factor", "steps", "step"]
    codes = placed.join(held.select("id", *code), "id")
    some = checkpointed(by_group(codes, lambda frame: likely(frame, threshold), _MEMBER))
    return by_group(some.join(held.select("id", "times", "vec", "keys", *code), "id"), lambda frame: linked(frame, threshold), "id long, links long, root long, recomputed long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows (vec_id, embedding)."""
    lean(rows.sparkSession)
    bits, number = bands(rows.count(), threshold, recall)
    every = checkpointed(coded(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), bits, number))
    valid = every.filter("node is not null")
    # A vector has the number of its row as its id; vectors are told apart by both hashes.
    groups = valid.groupBy("node", "lo").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("vec", "keys", "signs", "factor", "steps", "step")])
    held = checkpointed(groups.withColumns({"id": F.monotonically_increasing_id(), "dim": (F.length("vec") / 8).cast("int")}))
    found = checkpointed(link_counts(held, number, threshold))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    names = held.select("id", "node", "lo", "smallest", "times")
    parts = names.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = parts.groupBy("component").agg(F.min("smallest").alias("component_id"))
    known = parts.join(least, "component").join(counts, "id", "left").select(F.col("node").alias("n"), F.col("lo").alias("l"), F.coalesce("links", F.lit(0)).alias("links"), "times", "component_id")
    out = valid.select("vec_id", "node", "lo").join(checkpointed(known), (F.col("node") == F.col("n")) & (F.col("lo") == F.col("l")))
    out = out.select("vec_id", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
    alone = every.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL)) = 0 THEN CAST(embedding AS DOUBLE[]) END e FROM embeddings),
 valid AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
 links AS (SELECT a.vec_id a, b.vec_id b FROM valid a JOIN valid b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {THRESHOLD}),
 reach AS (SELECT vec_id, vec_id r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
 least AS (SELECT vec_id, min(r) component_id FROM reach GROUP BY vec_id), counted AS (SELECT a vec_id, count(*) n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept FROM v JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""

QUERIES = {"op3_embeddings": op3_embeddings}
SQL: dict[str, str] = {"op3_embeddings": _SQL}
