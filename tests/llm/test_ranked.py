"""Centroid clustering, sharding and ranked search against plain loops, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.llm import clusters, search, shards

# --- centroid clustering


def plain_clusters(rows, centroids, rounds, dim):
    kept = [(i, [math.floor(256.0 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [q for _, q in order[:centroids]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [min(range(len(now)), key=lambda k: (far(q, now[k]), k)) for _, q in kept]
    for _ in range(rounds):
        own = near()
        for k in range(len(now)):
            members = [q for (_, q), o in zip(kept, own) if o == k]
            if members:
                now[k] = [sum(c) // len(members) for c in zip(*members)]
    own = near()
    inertia = Counter()
    for (_, q), k in zip(kept, own):
        inertia[k] += far(q, now[k])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, k, far(q, now[k]), inertia[k], sum(inertia.values()), digest[k]) for (i, q), k in zip(kept, own)), key=repr)


def drawn(n, dim, seed, grid=None):
    draw = random.Random(seed)
    return [(i, [draw.choice(grid) if grid else draw.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


CASES = {
    "spread": drawn(300, 3, 1),
    "ties on a grid": drawn(400, 2, 2, [-1.0, 0.0, 1.0]),
    "one common vector": [(i, [0.5, 0.25, 0.0]) for i in range(200)] + [(1000 + i, v) for i, v in drawn(100, 3, 3)],
    "nulls": [(None, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [3.0, 4.0]), (6, [3.0, 4.0]), (6, [0.0, 0.0]), (None, [1.0, 2.0])],
    "equal all": [(i, [1.0, 1.0]) for i in range(50)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_clusters(spark, name, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 64)
    rows = CASES[name]
    dim = 3 if name in ("spread", "one common vector") else 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(3)
    got = clusters.clustered(frame, 7, 5, 2, dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 7, 5, dim)


def test_clusters_large(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="in size"):
        clusters.clustered(frame, 2, 1, 2, 2).collect()


def test_balls_leave_work_out():
    draw = np.random.default_rng(1)
    x = (draw.normal(size=(2000, 8)) + 40 * draw.integers(0, 4, size=(2000, 1))).astype(float)
    x = np.floor(256 * x).astype(np.int64)
    nodes = clusters.tree(x)
    centroids = x[[0, 500, 1000, 1500, 7]]
    whole, single = clusters.assigned(x, nodes, centroids)
    cluster = np.full(len(x), -1)
    for at, k in whole:
        cluster[nodes["order"][nodes["spans"][at, 0] : nodes["spans"][at, 1]]] = k
    for rows, own in single:
        cluster[rows] = own
    far = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all()
    assert sum(len(r) for r, _ in single) < len(x) / 2
    for a, b, right in nodes["spans"].tolist():
        assert b - a <= clusters.LEAF or right or (x[nodes["order"][a:b]] == x[nodes["order"][a]]).all()
    assert (nodes["sums"][0] == x.sum(axis=0)).all()


# --- sharding


def judged(rows, n):
    """Checks the law and gives the share of links that are cut."""
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes[j] for j in range(n)]
    assert set(sizes) <= set(range(n)) and max(counts) - min(counts) <= 1
    for j in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(counts[j]))
    hubs, cells = Counter((r["h1"], r["h2"]) for r in rows), Counter((r["h1"], r["h2"], r["shard"]) for r in rows)
    pairs = lambda c: sum(v * (v - 1) // 2 for v in c.values())
    return 1 - pairs(cells) / pairs(hubs) if pairs(hubs) else 0.0


TEXTS = {
    "alone": ([str(i) for i in range(1000)], 0.0),
    "groups": ([str(i) if i % 3 else f"g{i % 60}" for i in range(2000)], 0.05),
    "a third is one text": (["x"] * 1000 + [str(i) for i in range(2000)], 0.83),
    "only pairs": ([str(i // 2) for i in range(1000)], 0.3),
    "one text": (["x"] * 333, 0.95),
    "few": (["a", "a", "b"], 1.0),
    "nulls": ([None, "", None, "", "a"] * 40, 0.95),
    "empty": ([], 0.0),
}


@pytest.mark.parametrize("name", TEXTS)
def test_shards(spark, name):
    texts, most = TEXTS[name]
    given = [(None if i % 11 == 0 else i % 700, t, "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(given, "doc_id long, text string, shard string").repartition(3)
    rows = shards.sharded(frame).collect()
    tell = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((tuple(r)[:3] for r in rows), key=repr) == sorted((tell(i, t) for i, t, _ in given), key=repr)
    assert judged(rows, 16) <= most


def test_shards_far_text(spark):
    rows = shards.sharded(spark.createDataFrame([(1, "é" * 100_000), (2, "x")], "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["size"], r["slot"]) for r in rows) == [(1, 200_001, 0), (2, 2, 0)]


def test_quotas_keep_room():
    draw = random.Random(4)
    for _ in range(50):
        n = draw.randint(2, 6)
        wishes = [(i, j, g, draw.randint(1, 50)) for i in range(n) for j in range(n) for g in draw.sample(range(9), 3) if i != j]
        room = [draw.randint(-3, 30) for _ in range(n)]
        got = shards.quotas(wishes, room)
        went = {}
        for i, j, gain, m in wishes:
            limit, part, whole = got.get((i, j), (-1, 0, 1))
            went[i, j] = went.get((i, j), 0) + (m if gain < limit else m * part // whole if gain == limit else 0)
        for k in range(n):
            into, out = sum(m for (i, j), m in went.items() if j == k), sum(m for (i, j), m in went.items() if i == k)
            assert into - out <= max(room[k], 0)


# --- ranked search


def plain_ranked(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: Counter(pattern.findall((t or "").translate(lower)))
    held = [(i, c) for i, t in docs if (c := terms(t))]
    number, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * number // words
            score = sum(q * math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms(text).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def texts(n, seed, words=60):
    draw = random.Random(seed)
    names = [f"w{int(draw.paretovariate(0.7))}" for _ in range(words)] + ["Été", "日本", "A1", "a1"]
    return [" ".join(draw.choices(names, k=draw.randint(0, 40))) for _ in range(n)]


SEARCHES = {
    "random": ([(i * 7 % 301, t) for i, t in enumerate(texts(301, 1))], [(i, t) for i, t in enumerate(texts(70, 2))]),
    "ties": ([(100 - i, "same words here") for i in range(100)] + [(200 + i, "others") for i in range(200)], [(1, "same words"), (2, "others, others; OTHERS")]),
    "odd": ([(None, "alpha beta"), (3, "alpha"), (3, "alpha alpha"), (None, None), (5, ""), (6, "--- !"), (7, "gamma")], [(None, "alpha"), (1, None), (1, "Alpha BETA"), (1, "Alpha BETA"), (2, "delta"), (3, "")]),
    "no documents": ([], [(1, "a")]),
    "no items": ([(1, "a")], []),
    "long": ([(1, "needle " + "hay " * 400_000), (2, "needle in a stack"), (3, "hay")], [(1, "needle hay")]),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_search(spark, name, monkeypatch):
    docs, items = SEARCHES[name]
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0 if name == "odd" else 1000)
    index = search.indexed(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).repartition(2), 40)
    got = search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)), 20, index)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranked(docs, items, 20)


def test_best_is_exact():
    draw = random.Random(9)
    for _ in range(200):
        lists = []
        for _ in range(draw.randint(1, 8)):
            places = sorted(draw.sample(range(60), draw.randint(1, 60)))
            lists.append((places, [draw.randint(1, draw.choice((3, 50))) for _ in places]))
        total = Counter()
        for places, own in lists:
            total.update(dict(zip(places, own)))
        k = draw.randint(1, 12)
        assert search.best(lists, k) == sorted(((s, p) for p, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 300, 1 << 40, (1 << 62) + 5])
    data, starts = search.packed(values)
    assert search.unpacked(data).tolist() == values.tolist() and starts[0] == 0
    assert search.unpacked(search.packed(np.zeros(0, dtype=np.int64))[0]).tolist() == []
