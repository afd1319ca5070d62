"""Ranked lexical search, document at a time.

The index is made in one pass without a shuffle: a task cuts its documents into shards, sorts a shard's by doc_id and
writes for every term a row with its postings (places of documents as differences, and occurrences, both as bytes of
seven bits), and a row with the documents' ids and lengths. Statistics of the whole corpus are sums over these rows.
Items are searched in blocks of up to ITEMS. For a shard and a block the postings of the block's terms meet in one task.
There an item's postings are merged by a heap over their next documents, each document is scored whole before the next,
and the best are kept in a bounded heap by score, then doc_id. A term whose largest share, with those of the terms below
it, can't lift a document into that heap is not merged but looked up, for documents that another term brought. The
shards' best are then merged.

A text's terms are its maximal runs of ASCII letters and digits and of characters beyond ASCII; only A to Z are
lower-cased.

Edge cases: null and empty texts, and those without a term, are no documents; items without a term that the corpus holds
have no rows; rows that share a doc_id are documents of their own; of equally scored documents the smaller doc_id is
first, one without an id last; repeated items, also those that share an item_id or have none, have their own ranks; empty
tables give an empty table; other columns are not looked at. A document's length times the number of documents must fit in
58 bits.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, released, stored, table

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
BEST = 20
#: Documents and bytes of text of a shard; a longer text is a shard of its own. Items of a block.
SHARD_DOCS, SHARD_BYTES, ITEMS = 8192, 16 << 20, 64
#: Terms (by block of items) up to which they are broadcast to the index; beyond, both sides are shuffled.
BROADCAST_TERMS = 200_000
_PIECE = 1 << 20


def counted(text: str | None) -> Counter:
    """Occurrences of a text's terms; long texts are counted piece by piece."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= _PIECE:
        return Counter(TERM.findall(data))
    out: Counter = Counter()
    at = 0
    while at < len(data):
        stop = _BREAK.search(data, at + _PIECE)
        end = stop.start() if stop else len(data)
        out.update(TERM.findall(data[at:end]))
        at = end
    return out


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Whole numbers as bytes of seven bits, the last of a number without its high bit; and where each begins."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1) << 7).astype(np.uint8)
    return out.tobytes(), starts


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out, size = np.zeros(len(ends), dtype=np.int64), ends - starts + 1
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def shard_rows(held: list[tuple[int | None, Counter]], shard: int) -> pd.DataFrame:
    """The rows of a shard: for every term, and under the empty term the documents' ids (those without one are last) and
    lengths."""
    held = sorted(held, key=lambda x: (x[0] is None, x[0] or 0))
    sizes = np.array([len(c) for _, c in held])
    numbers: dict[bytes, int] = {}
    terms = np.array([numbers.setdefault(t, len(numbers)) for _, c in held for t in c], dtype=np.int64)
    times = np.array([n for _, c in held for n in c.values()], dtype=np.int64)
    places = np.repeat(np.arange(len(held)), sizes)
    names = sorted(numbers)
    rank = np.empty(len(names), dtype=np.int64)
    rank[[numbers[t] for t in names]] = np.arange(len(names))
    terms = rank[terms]
    turn = np.argsort(terms, kind="stable")
    terms, places, times = terms[turn], places[turn], times[turn]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    steps = np.r_[0, np.diff(places)]
    steps[first] = places[first]
    rows: dict[str, list] = {"term": [b"", *names], "df": [len(held), *np.diff(np.r_[first, len(terms)]).tolist()]}
    ids = np.array([i for i, _ in held if i is not None], dtype="<i8").tobytes()
    for c, values, own in (("docs", steps, ids), ("times", times, packed(np.array([sum(c.values()) for _, c in held]))[0])):
        data, starts = packed(values)
        cuts = [*starts[first].tolist(), len(data)]
        rows[c] = [own, *(data[a:b] for a, b in zip(cuts, cuts[1:]))]
    return pd.DataFrame(rows).assign(shard=shard)[["shard", "term", "df", "docs", "times"]]


def indexed(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, term, df, docs and times of docs (doc_id, text): see shard_rows."""

    @released
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"]):
                if terms := counted(text):
                    held.append((None if doc is None else int(doc), terms))
                    size += len(text)
                if len(held) >= shard_docs or size >= shard_bytes:
                    yield shard_rows(held, shard)
                    held, size, shard = [], 0, shard + 1
        if held:
            yield shard_rows(held, shard)

    # Ids go as text: a column of whole numbers with nulls would come as doubles.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(build, "shard long, term binary, df long, docs binary, times binary")


def best(lists: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best places, best first, of postings given as (ascending places, shares of a score, all
    above 0). Of equal scores the smaller place is better."""
    lists = sorted(lists, key=lambda x: max(x[1]))
    reach, total = [], 0
    for _, shares in lists:
        total += max(shares)
        reach.append(total)
    top: list[tuple[int, int]] = []
    # As many places as a list has with a share of so much reach that score at least; one less is still beaten by them.
    floor = max((heapq.nlargest(k, s)[-1] - 1 for _, s in lists if len(s) >= k), default=0)
    floor, least, at = max(floor, 0), 0, [0] * len(lists)
    while least < len(lists) and reach[least] <= floor:
        least += 1
    merge = [(lists[i][0][0], i) for i in range(least, len(lists))]
    heapq.heapify(merge)
    while merge:
        place, score = merge[0][0], 0
        while merge and merge[0][0] == place:
            i = merge[0][1]
            places, shares = lists[i]
            p = at[i]
            score += shares[p]
            at[i] = p = p + 1
            if p < len(places):
                heapq.heapreplace(merge, (places[p], i))
            else:
                heapq.heappop(merge)
        for i in range(least - 1, -1, -1):
            if score + reach[i] <= floor:
                break
            places, shares = lists[i]
            at[i] = p = bisect_left(places, place, at[i])
            if p < len(places) and places[p] == place:
                score += shares[p]
        else:
            if score > floor:
                if len(top) < k:
                    heapq.heappush(top, (score, -place))
                else:
                    heapq.heapreplace(top, (score, -place))
                if len(top) == k and top[0][0] > floor:
                    floor, before = top[0][0], least
                    while least < len(lists) and reach[least] <= floor:
                        least += 1
                    if least > before:
                        merge = [x for x in merge if x[1] >= least]
                        heapq.heapify(merge)
    return [(s, -p) for s, p in sorted(top, key=lambda x: (-x[0], -x[1]))]


def weight(n, df):
    """Weight of a term, of the numbers of documents and of those that hold it."""
    return F.floor(F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double")) * 1000.0).cast("long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the k best of docs (doc_id, text) for each of items (item_id, text).

    index: what indexed() gave for docs, where it is at hand.
    """
    spark = docs.sparkSession
    lean(spark)
    if index is None:
        index = stored(indexed(docs))

    @released
    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(int(unpacked(t).sum()) for pdf in batches for t in pdf["times"])]})

    heads = index.filter(F.col("term") == F.lit(b""))
    number = heads.agg(F.sum("df")).first()[0] or 0
    words = heads.select("times").mapInPandas(lengths, "n long").agg(F.sum("n")).first()[0] or 0

    @released
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(key, t, n) for key, text in zip(pdf["key"], pdf["text"]) for t, n in counted(text).items()]
            yield pd.DataFrame(out, columns=["key", "term", "n"]).astype({"key": "int64", "n": "int64"})

    keyed = stored(items.select("item_id", "text", F.monotonically_increasing_id().alias("key")))
    terms = keyed.select("key", "text").mapInPandas(asked, "key long, term binary, n long").withColumn("block", F.floor(F.col("key") / ITEMS))
    uses = terms.groupBy("block", "term").agg(F.collect_list(F.struct("key", "n")).alias("uses"))
    few = uses.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda x: x
    df = index.select("term", "df").join(small(uses.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    uses = uses.join(df, "term").select("block", "term", "uses", weight(F.lit(number), F.col("df")).alias("w")).filter("w > 0")
    # A block also asks for the documents' ids and lengths.
    every = uses.unionByName(uses.select("block").distinct().select("block", F.lit(b"").alias("term"), F.lit(None).cast("array<struct<key:bigint,n:bigint>>").alias("uses"), F.lit(0).cast("long").alias("w")))
    found = index.drop("df").join(small(every), "term")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["term"] == b""
        own = pdf[head].iloc[0]
        ids = np.frombuffer(own["docs"], dtype="<i8").tolist()
        size = np.array([75 + 25 * n * number // words for n in unpacked(own["times"]).tolist()], dtype=np.int64)
        asked: dict[int, list] = {}
        for row in pdf[~head].itertuples():
            places, times = np.cumsum(unpacked(row.docs)), unpacked(row.times)
            share = row.w * ((1_000_000_000 * times) // (1000 * times + 12 * size[places]))
            if not share.all():
                places, share = places[share > 0], share[share > 0]
            if len(places):
                places, share = places.tolist(), share.tolist()
                for use in row.uses:
                    n = use["n"]
                    asked.setdefault(use["key"], []).append((places, share if n == 1 else [n * s for s in share]))
        out = [(key, ids[p] if p < len(ids) else None, s) for key, lists in asked.items() for s, p in best(lists, k)]
        found = pd.DataFrame(out, columns=["key", "doc_id", "score"])
        return found.assign(doc_id=pd.array([x[1] for x in out], dtype="Int64"))

    parts = found.groupBy("shard", "block").applyInPandas(search, "key long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(keyed.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = lambda c: rf"regexp_extract_all(translate({c}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = f"""WITH words AS (SELECT doc_id, unnest({_TERMS('text')}) t FROM documents WHERE text IS NOT NULL),
 tfs AS (SELECT doc_id, t, count(*) tf FROM words GROUP BY doc_id, t), sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) n FROM tfs GROUP BY doc_id),
 total AS (SELECT count(*) docs, CAST(sum(n) AS BIGINT) l FROM sizes), dfs AS (SELECT t, count(*) df FROM tfs GROUP BY t),
 asked AS (SELECT item_id, t, count(*) q FROM (SELECT item_id, unnest({_TERMS('text')}) t FROM benchmark) GROUP BY item_id, t),
 shares AS (SELECT item_id, doc_id, q * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // l))) s
  FROM asked JOIN dfs USING (t) JOIN tfs USING (t) JOIN sizes USING (doc_id), total),
 scores AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) score FROM shares GROUP BY item_id, doc_id HAVING sum(s) > 0)
 SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scores WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {BEST}"""

QUERIES = {"op13_search": op13_search}
SQL: dict[str, str] = {"op13_search": _SQL}
