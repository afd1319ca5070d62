"""Suffix-array dedup: bytes inside a LENGTH-byte string that also starts anywhere else are removed.

Every window of LENGTH bytes has an anchor, the GRAM-byte string in it with the smallest hash, and equal
windows have equal anchors. Neighbouring windows with one anchor string are a run, the unit of work; a run is cut at
SPAN windows, so periodic text has no more runs than other text. An anchor that one run alone has, at one place,
settles its windows: they are unique. Runs that are equal as a whole settle theirs: they are
repeated. The rest, one of each kind of run, goes to shards by anchor. In a shard the suffixes are sorted by
Larsson-Sadakane refinement (only groups not yet resolved are sorted again, by doubled prefixes, until they share
LENGTH bytes) in numpy, common prefixes come from Kasai's scan run in parallel lanes, and windows that share LENGTH
bytes with another are repeated. An anchor with more than LIMIT kinds of runs is spread over several shards;
these are merged by binary search of window digests among the sorted digests of the other shards.

Equal texts are collapsed first: each loses all its bytes if it has LENGTH of them.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing; rows have keys of their own, so rows that
share a doc_id, or have none, are documents of their own; an empty table gives an empty table;
other columns are not looked at. Digests have 128 bits (anchor and run, or window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lean, released, stored, table

LENGTH, GRAM, LIMIT = 200, 64, 512
SPAN = LENGTH - GRAM + 1
_BATCH, _SHARD, _LANES = 1 << 19, 1 << 20, 4096
#: Bits of a place among the texts of a batch; Spark's longest text has 2^31 bytes.
_PLACE = 32
_NONE = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def grams(eight: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings (GRAM eight times a power of two) from each place on, by doubling."""
    out, size = eight, 8
    while size < GRAM:
        n = max(0, len(out) - size)
        out = (out[:n] * _MIX) ^ (out[size:] + np.uint64(size))
        out ^= out >> np.uint64(32)
        size *= 2
    return out[: max(0, len(eight) - GRAM + 1)] * np.uint64(0xC2B2AE3D27D4EB4F)


def anchored(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """For each text its runs: anchor hashes, first window, number of windows, and whether the anchor moves inside."""
    out: list = [None] * len(texts)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
    at, held, size = 0, [], 0
    while at <= len(texts):
        if at < len(texts):
            out[at] = none
            if len(texts[at]) >= LENGTH:
                held.append(at)
                size += len(texts[at])
        if held and (size >= _BATCH or at == len(texts)):
            for k, runs in zip(held, _runs([texts[k] for k in held])):
                out[k] = runs
            held, size = [], 0
        at += 1
    return out


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    hashes = grams(words_at(np.frombuffer(b"".join(texts), dtype=np.uint8)))
    n = len(hashes)
    bits = np.uint64(_PLACE)
    # The hash's top bits and the place from the right: of equal strings, and of strings equal in these bits, the last one
    # counts. As many bits in every batch, so equal windows have equal anchors in any two.
    low = (hashes >> bits << bits) | (np.uint64(n) - np.arange(n, dtype=np.uint64))
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if SPAN > width:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    places = n - (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = 0
    for text in texts:
        own = places[start : start + len(text) - LENGTH + 1]
        anchors = hashes[own]
        new = np.r_[True, anchors[1:] != anchors[:-1]]
        # The anchor's first window, of a run that is cut every SPAN windows.
        head = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        first = np.flatnonzero((np.arange(len(own)) - head) % SPAN == 0)
        number = np.diff(np.r_[first, len(own)])
        yield anchors[first].view(np.int64), first, number, own[first] != own[first + number - 1]
        start += len(text)


def refined(data: np.ndarray, eight: np.ndarray, enough: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `enough` bytes, their ranks, and each suffix's group: the rank of the first
    that shares these bytes (Larsson and Sadakane 2007, ended where longer prefixes don't matter).
    """
    n = len(data)
    order = np.argsort(eight)
    ordered = eight[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth = 8
    while depth < enough:
        sizes = np.diff(np.r_[np.flatnonzero(new), n])
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            break
        slots = np.flatnonzero(open_)
        own = order[slots]
        ahead = own + depth
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        # Slots are those of the groups in order, so group and key together sort the slots within each group.
        both = (rank[own] << 32) | key
        turn = np.argsort(both)
        own, both = own[turn], both[turn]
        order[slots] = own
        fresh = np.r_[True, both[1:] != both[:-1]]
        new[slots] = fresh
        rank[own] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))]
        depth *= 2
    group = rank.copy()
    rank[order] = np.arange(n)
    return order, rank, group


def common(eight: np.ndarray, order: np.ndarray, rank: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before, up to LENGTH (Kasai et al. 2001).

    The text is scanned in lanes side by side; going one byte on keeps all but one byte of the prefix. Suffixes of one
    group share LENGTH bytes; as their order in it is open, the place after them starts from nothing.
    """
    n = len(order)
    step = -(-n // _LANES)
    out = np.zeros(n, dtype=np.int64)
    first = np.arange(0, n, step)
    length = np.zeros(len(first), dtype=np.int64)
    for s in range(step):
        lanes = np.flatnonzero(first + s < n)
        i = first[lanes] + s
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        have = length[lanes]
        have[r == 0] = 0
        same = (r > 0) & (group[i] == group[j])
        live = np.flatnonzero((r > 0) & ~same)
        while len(live):
            a, b = i[live] + have[live], j[live] + have[live]
            inside = (a < n) & (b < n) & (have[live] < LENGTH)
            live, a, b = live[inside], a[inside], b[inside]
            differs = eight[a] ^ eight[b]
            # Equal bytes before the first difference; the padding behind the end equals nothing that counts.
            equal = np.where(differs == 0, 8, 7 - np.floor(np.log2(np.maximum(differs, 1).astype(np.float64))).astype(np.int64) // 8)
            equal = np.where(differs >> np.uint64(56) != 0, 0, np.maximum(equal, 0))
            have[live] += equal
            live = live[differs == 0]
        out[r] = np.where(same, LENGTH, np.minimum(have, LENGTH))
        length[lanes] = np.where(same, 0, np.maximum(have - 1, 0))
    return out


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its windows occur in another place of all pieces."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    eight = words_at(data)
    order, rank, alike = refined(data, eight)
    shared = common(eight, order, rank, alike)
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    valid = np.zeros(len(data), dtype=bool)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        valid[a : a + n - LENGTH + 1] = True
    group = np.cumsum(shared < LENGTH)
    counts = np.bincount(group, weights=valid[order].astype(np.float64))
    hit = np.zeros(len(data), dtype=bool)
    hit[order] = counts[group] > 1
    hit &= valid
    return [hit[a : a + n - LENGTH + 1] for a, n in zip(starts.tolist(), sizes.tolist())]


def intervals(hit: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Maximal runs of True as (first, last), moved by first."""
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    return [(first + int(a), first + int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashes(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def scanned(rows: DataFrame) -> DataFrame:
    """__doc, the text's hashes, length, digest and runs of every row."""

    @released
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [_bytes(t) for t in pdf["text"]]
            runs = anchored(data)
            digests = [
                [xxhash.xxh3_64_intdigest(d[s : s + k + LENGTH - 1]) - (1 << 63) for s, k in zip(first.tolist(), number.tolist())]
                for d, (_, first, number, _) in zip(data, runs)
            ]
            yield pdf[["__doc", "hi", "lo"]].assign(
                n=[len(d) for d in data], sha=[hashlib.sha256(d).hexdigest() for d in data], anchors=[r[0] for r in runs], digests=digests,
                firsts=[r[1].astype(np.int32) for r in runs],
                # Negative where the anchor moves inside a run.
                numbers=[np.where(r[3], -r[2], r[2]).astype(np.int32) for r in runs],
            )

    return rows.mapInPandas(scan, "__doc long, hi long, lo long, n long, sha string, anchors array<long>, digests array<long>, firsts array<int>, numbers array<int>")


def sorted_shards(pieces: DataFrame) -> DataFrame:
    """Windows of runs (anchor, salt, salts, digest, data) that are repeated within their shard: digest, from, to.

    Where an anchor has several shards, also the sorted digests of a shard's windows, packed by bucket.
    """
    order = ["anchor", "salt"]
    dealt = pieces.repartition(*order).sortWithinPartitions(*order, "digest")

    def done(frame: pd.DataFrame) -> pd.DataFrame:
        # Equal rows of one doc_id send their pieces twice.
        frame = frame.drop_duplicates(["anchor", "salt", "digest"])
        out, spread = [], {}
        hits = repeated_windows(list(frame["data"]))
        for anchor, salt, salts, digest, data, hit in zip(frame["anchor"], frame["salt"], frame["salts"], frame["digest"], frame["data"], hits):
            out.extend((anchor, digest, a, b, None, salt, None, None, None) for a, b in intervals(hit, 0))
            if salts > 1:
                keys = b"".join(xxhash.xxh3_128_digest(data[w : w + LENGTH]) for w in range(len(hit)))
                spread.setdefault((anchor, salt, salts), []).append((np.frombuffer(keys, dtype=_PAIR), np.full(len(hit), digest, dtype=np.int64), np.arange(len(hit), dtype=np.int32)))
        for (anchor, salt, salts), parts in spread.items():
            keys, digests, places = (np.concatenate(x) for x in zip(*parts))
            bucket = (keys["hi"] % np.uint64(4 * salts)).astype(np.int64)
            turn = np.lexsort((keys["lo"], keys["hi"], bucket))
            keys, digests, places, bucket = keys[turn], digests[turn], places[turn], bucket[turn]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            out.extend((anchor, None, None, None, int(bucket[a]), salt, keys[a:b].tobytes(), digests[a:b].tobytes(), places[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:]))
        # Column by column: whole numbers beside None must not pass through floats.
        names = ["anchor", "digest", "from", "to", "bucket", "salt", "keys", "digests", "places"]
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pd.DataFrame({n: pd.array(list(c), dtype="Int64") if i < 6 else pd.Series(list(c), dtype=object) for i, (n, c) in enumerate(zip(names, columns))})

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, size = [], 0
        for pdf in batches:
            rest.append(pdf)
            size += int(pdf["data"].map(len).sum())
            if size < _SHARD:
                continue
            every = pd.concat(rest, ignore_index=True)
            mark = every[order].to_numpy()
            cut = int(np.flatnonzero((mark != mark[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield done(every.iloc[:cut])
            rest = [every.iloc[cut:]]
            size = int(rest[0]["data"].map(len).sum())
        if size:
            yield done(pd.concat(rest, ignore_index=True))

    return dealt.mapInPandas(shard, "anchor long, digest long, from int, to int, bucket long, salt int, keys binary, digests binary, places binary")


def merged(packed: DataFrame) -> DataFrame:
    """Windows (anchor, digest, from, to) whose digest another shard of the anchor has too.

    A group holds one bucket of one anchor; there are as many buckets as keep it to a few times LIMIT.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(b, dtype=_PAIR) for b in pdf["keys"]]
        out = []
        for own, digests, places in zip(range(len(keys)), pdf["digests"], pdf["places"]):
            there = np.sort(np.concatenate([k for i, k in enumerate(keys) if i != own] or [np.zeros(0, dtype=_PAIR)]))
            if len(there):
                at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
                hit = there[at] == keys[own]
                out.append((np.frombuffer(digests, dtype=np.int64)[hit], np.frombuffer(places, dtype=np.int32)[hit]))
        digest, place = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in (0, 1))
        return pd.DataFrame({"anchor": pdf["anchor"].iloc[0], "digest": digest, "from": place, "to": place}, index=range(len(digest)))

    return packed.groupBy("anchor", "bucket").applyInPandas(merge, "anchor long, digest long, from int, to int")


def repeats(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (row, doc_id, n, sha, times), the texts (row, text) that may lose a part, and their repeated
    windows (row, from, to). `times` says how many rows have the text.
    """
    lean(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    # Two hashes that the JVM makes name a text wherever it is read; a row is found again by its id and its text.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("__doc"), text.alias("text"), F.xxhash64(text).alias("hi"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("lo"))
    scan = stored(scanned(rows).withColumn("row", F.monotonically_increasing_id()))
    # Tables that are joined by a key that may be hot are kept first: Spark can split such a join then.
    copies = checkpointed(scan.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("head")).filter("times > 1"))
    known = scan.select("row", "__doc", "hi", "lo", "n", "sha").join(copies, ["hi", "lo"], "left")
    known = checkpointed(known.select("row", "__doc", "hi", "lo", "n", "sha", F.coalesce("times", F.lit(1)).alias("times"), F.coalesce("head", "row").alias("head")))
    zipped = F.explode(F.arrays_zip("anchors", "digests", "firsts", "numbers")).alias("x")
    runs = scan.select("row", zipped).select("row", F.col("x.anchors").alias("anchor"), F.col("x.digests").alias("digest"), F.col("x.firsts").alias("at"), F.col("x.numbers").alias("number"))
    inner = F.col("number") < 0
    again = checkpointed(runs.groupBy("anchor").agg(F.sum(F.when(inner, 2).otherwise(1)).alias("c")).filter("c > 1").select("anchor"))
    runs = checkpointed(runs.join(again, "anchor"))
    spot = F.struct("row", "at", "number")
    kinds = checkpointed(runs.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("places"), F.min(spot).alias("first")))
    alone = F.max(((F.col("places") == 1) & (F.col("first.number") < 0)).cast("int"))
    several = checkpointed(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), alone.alias("moves")).filter("kinds > 1 or moves = 1"))
    salts = F.ceil(F.col("kinds") / F.lit(limit)).cast("int")
    asked = kinds.join(several, "anchor").select("anchor", "digest", "first.*", salts.alias("salts"), F.pmod(F.xxhash64("digest"), salts).cast("int").alias("salt"))
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "at", F.abs("number").alias("number"), "salts", "salt")).alias("runs"))
    # Of equal texts one is read, for its runs; a text of its own is read too where a run of it occurs again.
    named = known.join(runs.select("row").distinct(), "row", "left_semi").join(lists, "row", "left")
    named = named.filter((F.col("times") == 1) | F.col("runs").isNotNull()).select("row", F.col("__doc").alias("d"), F.col("hi").alias("h"), F.col("lo").alias("l"), "times", "runs")
    # The one time that all texts are shuffled; those that matter are kept for both uses.
    texts = rows.join(named, (F.col("__doc") == F.col("d")) & (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")))
    texts = stored(texts.select("row", "text", "times", "runs"))

    @released
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, own in zip(pdf["text"], pdf["runs"]):
                data = _bytes(text)
                out.extend((r["anchor"], r["salt"], r["salts"], r["digest"], data[r["at"] : r["at"] + r["number"] + LENGTH - 1]) for r in own)
            yield pd.DataFrame(out, columns=["anchor", "salt", "salts", "digest", "data"])

    pieces = texts.filter("runs is not null").select("text", "runs").mapInPandas(cut, "anchor long, salt int, salts int, digest long, data binary")
    shards = stored(sorted_shards(pieces))
    inside = shards.filter("bucket is null").select("anchor", "digest", "from", "to")
    inside = inside.unionByName(merged(shards.filter("bucket is not null").select("anchor", "bucket", "keys", "digests", "places")))
    # A kind with several places is repeated as a whole; of the others, which have one, the shards' windows are.
    whole = runs.join(kinds.filter("places > 1").select("anchor", "digest"), ["anchor", "digest"]).select("row", F.col("at").alias("from"), F.expr("at + abs(number) - 1").alias("to"))
    single = kinds.filter("places = 1").select("anchor", "digest", "first.row", "first.at")
    part = single.join(inside.distinct(), ["anchor", "digest"]).select("row", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    rest = known.select("row", F.nullif("__doc", F.lit(_NONE)).alias("doc_id"), "n", "sha", "times")
    return rest, texts.filter("times = 1").select("row", "text"), whole.unionByName(part)


def spans(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (first, behind the last) that windows (first start, last start) cover."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, removed (byte spans) and kept_sha256 of every row of docs (doc_id, text)."""
    known, texts, windows = repeats(docs, limit)
    lists = windows.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("windows")).withColumnRenamed("row", "its")

    @released
    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, text, own in zip(pdf["its"], pdf["text"], pdf["windows"]):
                data = _bytes(text)
                found = spans([(w["from"], w["to"]) for w in own])
                kept, at = hashlib.sha256(), 0
                for a, b in found:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((row, [{"start": a, "stop": b} for a, b in found], kept.hexdigest()))
            yield pd.DataFrame(out, columns=["its", "part", "part_sha"])

    some = texts.join(lists, F.col("row") == F.col("its")).select("its", "text", "windows").mapInPandas(reduced, "its long, part array<struct<start:int,stop:int>>, part_sha string")
    full = (F.col("times") > 1) & (F.col("n") >= LENGTH)
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")))
    return known.join(some, F.col("row") == F.col("its"), "left").select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(full, whole).otherwise(F.coalesce("part", nothing)).alias("removed"),
        F.when(full, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("part_sha", "sha")).alias("kept_sha256"),
    )


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and the digest of what it keeps."""
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]).cast("long"))
    return rows.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Bytes as pairs of hexadecimal digits; windows are cut from parts of a thousand starts, so that no cut scans a long text.
_SQL = f"""WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
 sized AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) n FROM docs),
 parts AS (SELECT doc_id, n, c, substr(h, CAST(2000 * c + 1 AS BIGINT), {2 * (1000 + LENGTH - 1)}) part FROM (SELECT doc_id, h, n, unnest(range(0, (n - {LENGTH}) // 1000 + 1)) c FROM sized WHERE n >= {LENGTH})),
 windows AS (SELECT doc_id, 1000 * c + k p, md5(substr(part, CAST(2 * k + 1 AS BIGINT), {2 * LENGTH})) w FROM (SELECT *, unnest(range(0, least(1000, n - {LENGTH} + 1 - 1000 * c))) k FROM parts)),
 again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
 hits AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) step FROM windows SEMI JOIN again USING (w)),
 marked AS (SELECT doc_id, p, sum(CASE WHEN step IS NULL OR step > {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) span FROM hits),
 spans AS (SELECT doc_id, min(p) a, max(p) + {LENGTH} b FROM marked GROUP BY doc_id, span),
 cuts AS (SELECT doc_id, h, n, a, b, coalesce(lag(b) OVER w, 0) before FROM spans JOIN sized USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
 done AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) n_removed, count(*) n_spans, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) kept FROM cuts GROUP BY doc_id)
 SELECT doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, CASE WHEN coalesce(kept, h) = '' THEN '{_EMPTY_SHA}' ELSE sha256(unhex(coalesce(kept, h))) END kept_sha256 FROM sized LEFT JOIN done USING (doc_id)"""

QUERIES = {"op8_suffixes": op8_suffixes}
SQL: dict[str, str] = {"op8_suffixes": _SQL}
