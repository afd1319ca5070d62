"""Centroid clustering with ball-tree filtering, in whole numbers.

Vectors become integers floor(SCALE * x). Every task builds metric trees over blocks of its vectors, once: a node has a
pivot (the mean), a radius, a count and the integer sum of its vectors. A round goes down these trees with the centroids
that can still be nearest. By the triangle inequality a centroid whose distance to the pivot less the radius exceeds the
least distance plus the radius is nearest to no vector of the ball; where one centroid is left the whole ball is its, by
count and sum, and where a leaf is reached its vectors are compared exactly. Rounding only widens the bound, so results
are those of comparing everything. A task hands on one row per centroid, and the driver holds the centroids alone.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out; a component of
2**19 or more in size is an error, as whole squared distances would leave 64 bits; equal vectors are one ball of radius 0;
of equally near centroids the one with the smaller number counts; rows that share a vec_id are rows of their own, and as
centroids stand in the order of their components; rows without one begin as centroids only where too few others are left;
with fewer vectors than centroids every one is a centroid; an empty table gives an empty table; other columns are not looked
at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, released, stored, table

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a tree, and those of a leaf.
BLOCK, LEAF = 2048, 24
#: Components must be smaller in size, so that a squared distance of two vectors stays below 2**63.
LARGEST = 1 << 19


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q (whole components) of the vectors that have dim finite components."""
    x = F.col("embedding")
    fit = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    size = F.forall(x, lambda v: F.abs(v) < float(LARGEST))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)).cast("long"))
    error = F.raise_error(F.lit(f"a component is {LARGEST} or more in size")).cast("array<bigint>")
    return vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(size, whole).otherwise(error).alias("q"))


def tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """A metric tree over the rows of x: order (rows by leaf), and for each node from, to, right (its second child, 0 for a
    leaf; the first child follows it), radius, sum and squares."""
    order = np.arange(len(x))
    nodes: list[list] = []
    open_ = [(0, len(x), -1)]
    while open_:
        a, b, parent = open_.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        own = x[order[a:b]]
        total = own.sum(axis=0)
        away = own - total / (b - a)
        far = np.sqrt((away * away).sum(axis=1))
        nodes.append([a, b, 0, float(far.max()) * (1 + 1e-9), total, int((own * own).sum())])
        if b - a <= LEAF or (own == own[0]).all():
            continue
        one = own[int(far.argmax())]
        apart = own - one
        two = own[int((apart * apart).sum(axis=1).argmax())]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argsort((own @ (two - one)).astype(float), kind="stable")]
        # The first child is taken up next and so follows its parent; the second tells its parent where it is.
        open_ += [(a + half, b, len(nodes) - 1), (a, a + half, -1)]
    return {
        "order": order.astype("<i4"), "spans": np.array([n[:3] for n in nodes], dtype="<i4"), "radius": np.array([n[3] for n in nodes], dtype="<f8"),
        "sums": np.array([n[4] for n in nodes], dtype="<i8"), "squares": np.array([n[5] for n in nodes], dtype="<i8"),
    }


def assigned(x: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Balls that belong to one centroid as (node, centroid), and the rest as (rows of x, their centroids)."""
    whole, single = [], []
    spans, radius, sums, order = nodes["spans"], nodes["radius"], nodes["sums"], nodes["order"]
    # Products of numbers this small are exact in doubles, and there much faster.
    exact = float if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22 else np.int64
    points, places = centroids.astype(float), centroids.astype(exact)
    lengths = (centroids * centroids).sum(axis=1)
    open_ = [(0, np.arange(len(centroids)))]
    while open_:
        at, left = open_.pop()
        a, b, right = (int(v) for v in spans[at])
        away = points[left] - sums[at] / (b - a)
        near = np.sqrt((away * away).sum(axis=1))
        least, r = near.min(), radius[at]
        left = left[near - r <= least + r + 1e-7 * (1.0 + least + r)]
        if len(left) == 1:
            whole.append((at, int(left[0])))
        elif right:
            open_ += [(right, left), (at + 1, left)]
        else:
            rows = order[a:b]
            # The squared distances less what all centroids share; the first of equal ones counts.
            sizes = lengths[left] - 2 * (x[rows].astype(exact) @ places[left].T).astype(np.int64)
            single.append((rows, left[sizes.argmin(axis=1)]))
    return whole, single


_BLOCKS = {"ids": "binary", "x": "binary", "order": "binary", "spans": "binary", "radius": "binary", "sums": "binary", "squares": "binary"}
_SCHEMA = ", ".join(f"{c} {t}" for c, t in _BLOCKS.items())


def blocks(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """Blocks of vectors (ids, a null's being followed by a 1, and components) and their trees."""

    def block(ids: list, q: list) -> pd.DataFrame:
        x = np.array(q, dtype=np.int64).reshape(-1, dim)
        known = np.array([(0, 1) if i is None or i != i else (int(i), 0) for i in ids], dtype="<i8")
        parts = {"ids": known.tobytes(), "x": x.astype("<i4").tobytes()} | {k: v.tobytes() for k, v in tree(x).items()}
        return pd.DataFrame({k: [v] for k, v in parts.items()})

    @released
    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids: list = []
        q: list = []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            q.append(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            while len(ids) >= BLOCK:
                every = np.concatenate(q)
                yield pa.RecordBatch.from_pandas(block(ids[:BLOCK], every[:BLOCK]), preserve_index=False)
                ids, q = ids[BLOCK:], [every[BLOCK:]]
        if ids:
            yield pa.RecordBatch.from_pandas(block(ids, np.concatenate(q)), preserve_index=False)

    return rows.mapInArrow(build, _SCHEMA)


def opened(row, dim: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """ids, components and tree of a block."""
    read = lambda c, kind: np.frombuffer(getattr(row, c), dtype=kind)
    nodes = {"order": read("order", "<i4"), "spans": read("spans", "<i4").reshape(-1, 3), "radius": read("radius", "<f8"), "sums": read("sums", "<i8").reshape(-1, dim), "squares": read("squares", "<i8")}
    return read("ids", "<i8").reshape(-1, 2), read("x", "<i4").reshape(-1, dim).astype(np.int64), nodes


def tallied(trees: DataFrame, centroids: list[list[int]], dim: int = DIM) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid that has vectors: how many, their summed squared distance and their sum."""
    sent = trees.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.int64).reshape(-1, dim))

    @released
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        number, square, total = [0] * len(c), [0] * len(c), np.zeros((len(c), dim), dtype=np.int64)
        for pdf in batches:
            for row in pdf.itertuples():
                _, x, nodes = opened(row, dim)
                whole, single = assigned(x, nodes, c)
                for at, k in whole:
                    number[k] += int(nodes["spans"][at, 1] - nodes["spans"][at, 0])
                    square[k] += int(nodes["squares"][at])
                    total[k] += nodes["sums"][at]
                for rows, own in single:
                    np.add.at(total, own, x[rows])
                    for k, r in zip(own.tolist(), (x[rows] * x[rows]).sum(axis=1).tolist()):
                        number[k] += 1
                        square[k] += r
        out = []
        for k, n in enumerate(number):
            if n:
                place = [int(v) for v in c[k]]
                inertia = square[k] - 2 * sum(p * int(s) for p, s in zip(place, total[k])) + n * sum(p * p for p in place)
                out.append((k, n, str(inertia), total[k].tolist()))
        yield pd.DataFrame(out, columns=["k", "n", "inertia", "total"])

    parts = trees.mapInPandas(tally, "k int, n long, inertia string, total array<long>")
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
    return {r["k"]: (r["n"], int(r["inertia"]), r["total"]) for r in sums.collect()}


def first_centroids(rows: DataFrame, centroids: int, seed: int) -> list[list[int]]:
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["q"] for r in rows.orderBy(place.asc_nulls_last(), "q").limit(centroids).select("q").collect()]


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of vectors (vec_id, embedding).

    centroids bounds what the driver and every task hold beside a block.
    """
    spark = vectors.sparkSession
    lean(spark)
    rows = quantised(vectors, dim, scale)
    trees = stored(blocks(rows, dim))
    now = first_centroids(rows, centroids, seed)
    for _ in range(rounds if now else 0):
        found = tallied(trees, now, dim)
        now = [[s // found[k][0] for s in found[k][2]] if k in found else c for k, c in enumerate(now)]
    own = {k: v[1] for k, v in tallied(trees, now, dim).items()} if now else {}
    every = sum(own.values())
    if every >= 1 << 63:
        raise ValueError("the summed squared distances leave 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    sent = spark.sparkContext.broadcast((np.array(now, dtype=np.int64).reshape(-1, dim), own, every, digests))

    @released
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, inertia, whole_inertia, names = sent.value
        for pdf in batches:
            for row in pdf.itertuples():
                ids, x, nodes = opened(row, dim)
                whole, single = assigned(x, nodes, c)
                cluster = np.zeros(len(x), dtype=np.int32)
                for at, k in whole:
                    cluster[nodes["order"][nodes["spans"][at, 0] : nodes["spans"][at, 1]]] = k
                for rows_, k in single:
                    cluster[rows_] = k
                away = x - c[cluster]
                out = {"vec_id": pd.array(ids[:, 0], dtype="Int64"), "cluster": cluster, "distance": (away * away).sum(axis=1)}
                out["vec_id"][ids[:, 1] == 1] = pd.NA
                out |= {"cluster_inertia": [inertia[k] for k in cluster.tolist()], "inertia": whole_inertia, "centroid_sha256": [names[k] for k in cluster.tolist()]}
                yield pd.DataFrame(out)

    return trees.select("ids", "x", "order", "spans", "radius", "sums", "squares").mapInPandas(place, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    near = lambda k: (
        f"a{k} AS MATERIALIZED (SELECT rid, vec_id, q, min(d) d, arg_min(k, (d, k)) k FROM (SELECT rid, vec_id, q, k, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) d FROM kept, c{k}) GROUP BY rid, vec_id, q)"
    )
    mean = lambda k: (
        f"m{k} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) c FROM (SELECT k, i, sum(q[i]) s, count(*) n FROM a{k}, (SELECT unnest(range(1, {DIM + 1})) i) GROUP BY k, i) GROUP BY k), "
        f"c{k + 1} AS MATERIALIZED (SELECT c{k}.k, coalesce(m{k}.c, c{k}.c) c FROM c{k} LEFT JOIN m{k} USING (k))"
    )
    fit = f"len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    last = ROUNDS
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) q FROM embeddings WHERE {fit}),
 c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS INT) k, q c FROM kept QUALIFY k < {CENTROIDS}),
 {', '.join(f'{near(k)}, {mean(k)}' for k in range(last))}, {near(last)}
 SELECT vec_id, k AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) cluster_inertia, CAST(sum(d) OVER () AS BIGINT) inertia, sha256(array_to_string(c, ',')) centroid_sha256 FROM a{last} JOIN c{last} USING (k)"""


QUERIES = {"op11_clusters": op11_clusters}
SQL: dict[str, str] = {"op11_clusters": _sql()}
