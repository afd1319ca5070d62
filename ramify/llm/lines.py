"""Line dedup over content-defined chunks of lines.

Every line is hashed, a rolling hash runs over the last WINDOW line hashes, and a chunk ends behind a line
where it is a multiple of EVERY and the chunk has LEAST lines and a letter or digit. What is left behind
the last boundary is a chunk too, or joins the last chunk where it has neither. Boundaries thus depend on
nearby lines alone and settle again after an insertion, and chunks hold every line of a text. Beside the
chunks every line and its next are a unit of their own, treated alike, so that a run of two or more lines
goes wherever the boundaries fall. Units are found by hash; the texts of those that several documents hold
are then compared, so what is equal is equal byte for byte. Of a unit that several documents hold the one
with the smallest doc_id keeps it (among rows that share an id, the one whose text has the smallest hash, then one of
those whose texts are equal), and within a document the first place does. All other places lose these
lines; of equal lines one at least stays.

Edge cases: a null text stays null and has no lines; an empty text stays empty; texts without a letter or
digit lose nothing, nor do texts of one line; copies of any other text lose every line; a document may
lose all its lines, its text is then empty; what overlaps its own first place stays; rows that share a
doc_id, or have none, are documents of their own, and of repeated rows one keeps its lines; null ids come last; an
empty table gives an empty table; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, packed, released, stored, table, unpacked

WINDOW, EVERY, LEAST = 2, 2, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
Digest = Callable[[bytes], int]


def boundaries(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks, and the pairs of lines beside them, in order as (first line, line behind the last)."""
    n = len(lines)
    if n < LEAST:
        return []
    h = np.frombuffer(b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8] for x in lines), dtype=">u8").astype(np.uint64)
    rolling = h.copy()
    for back in range(1, WINDOW):
        rolling[back:] = rolling[back:] + h[:-back] * _BASE ** np.uint64(back)
    rolling ^= rolling >> np.uint64(29)
    ends = np.flatnonzero(rolling * _BASE >> np.uint64(33) & np.uint64(0x7FFFFFFF) < np.uint64(0x80000000 // EVERY)) + 1
    word = np.array([any(c.isalnum() for c in x) for x in lines])
    worded = np.concatenate([[0], np.cumsum(word)])
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= LEAST and worded[end] > worded[start]:
            out.append((start, end))
            start = end
    if n - start >= LEAST and worded[n] > worded[start] or not out:
        out.append((start, n))
    elif start < n:
        out[-1] = (out[-1][0], n)
    # Lines without a letter or digit are paired with the lines around them, however many stand together.
    at = np.flatnonzero(word)
    if len(at):
        near = np.flatnonzero(word[1:] | word[:-1]).tolist()
        out.extend((k, k + 2) for k in near)
        wide = np.flatnonzero(np.diff(at) > 2)
        out.extend(zip(at[wide].tolist(), (at[wide + 1] + 1).tolist()))
        if at[0] > 1:
            out.append((0, int(at[0]) + 1))
        if n - at[-1] > 2:
            out.append((int(at[-1]), n))
    return sorted(set(out))


def chunks(lines: list[str], digest: Digest = xxhash.xxh3_128_intdigest) -> Iterator[tuple[int, int, str, int, int]]:
    """first, behind, text and two 64-bit hashes of every chunk and pair that may be removed."""
    for a, b in boundaries(lines):
        body = "\n".join(lines[a:b])
        if any(c.isalnum() for c in body):
            h = digest(body.encode("utf-8", "surrogatepass"))
            yield a, b, body, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


#: What tells rows apart: the id and two hashes of the text. Rows that are equal in these are copies.
_KEY = ["doc", "h1", "h2"]
_KEYED = ", ".join(f"{c} long" for c in _KEY)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct, and their keys."""
    text = F.col("row.text")
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1))
    return packed(docs).select("row", doc.alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("h2"))


def repeated(rows: DataFrame, digest: Digest) -> DataFrame:
    """Keys and the hashes of the chunks that other documents hold too, of rows (row and key)."""

    @released
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, h1, h2, text in zip(*(pdf[c] for c in _KEY), pdf["text"]):
                out.extend((doc, h1, h2, hi, lo) for hi, lo in {c[3:] for c in chunks(text.split("\n"), digest)})
            yield pd.DataFrame(out, columns=[*_KEY, "hi", "lo"]).astype("int64")

    places = rows.filter("row.text is not null").select(*_KEY, "row.text").mapInPandas(found, f"{_KEYED}, hi long, lo long")
    key = F.struct(*_KEY)
    first = places.groupBy("hi", "lo").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first < last").drop("last")
    gone = (key > F.col("first")).alias("gone")
    return places.join(first, ["hi", "lo"]).groupBy(*_KEY).agg(F.collect_set(F.struct("hi", "lo", gone)).alias("held"))


def unequal(rows: DataFrame, digest: Digest) -> dict[tuple[int, int], dict[str, tuple]]:
    """Texts and first holders of the chunks in rows (row, key, held) that share a hash but not their bytes."""

    @released
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, h1, h2, text, held in zip(*(pdf[c] for c in _KEY), pdf["text"], pdf["held"]):
                held = {(g["hi"], g["lo"]) for g in held}
                out.extend((doc, h1, h2, hi, lo, body) for body, hi, lo in {c[2:] for c in chunks(text.split("\n"), digest)} if (hi, lo) in held)
            yield pd.DataFrame(out, columns=[*_KEY, "hi", "lo", "body"])

    bodies = rows.filter("held is not null").select(*_KEY, "row.text", "held").mapInPandas(found, f"{_KEYED}, hi long, lo long, body string")
    clash = bodies.select("hi", "lo", "body").distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hi", "lo")
    known = clash.collect()  # with 128 bits, none
    out: dict[tuple[int, int], dict[str, tuple]] = {(r["hi"], r["lo"]): {} for r in known}
    if out:
        clash = rows.sparkSession.createDataFrame(known, clash.schema)
        for r in bodies.join(F.broadcast(clash), ["hi", "lo"]).groupBy("hi", "lo", "body").agg(F.min(F.struct(*_KEY)).alias("first")).collect():
            out[r["hi"], r["lo"]][r["body"]] = tuple(r["first"])
    return out


def reduced_rows(docs: DataFrame, digest: Digest = xxhash.xxh3_128_intdigest) -> DataFrame:
    """The rows of docs as a struct `row`, with done: their text reduced, lines, removed (lines) and spans (removed runs)."""
    lean(docs.sparkSession)
    rows = keyed(docs)
    held = repeated(rows, digest).select(*[F.col(c).alias(f"its_{c}") for c in _KEY], "held")
    same = [F.col(c) == F.col(f"its_{c}") for c in _KEY]
    joined = rows.join(held, same, "left").drop(*[f"its_{c}" for c in _KEY])
    # Copies of a row meet by the keys of the join; all but one of them lose what they have.
    copy = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(0)))
    joined = stored(joined.withColumn("copy", copy))
    odd = unequal(joined, digest)

    @F.pandas_udf("text string, lines long, removed long, spans string")
    def reduced(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for docs, first, second, copies, texts, helds in batches:
            out = []
            for doc, h1, h2, copy, text, held in zip(docs, first, second, copies, texts, helds):
                if text is None:
                    out.append((None, 0, 0, ""))
                    continue
                lines = text.split("\n")
                gone = {(g["hi"], g["lo"]) for g in held if g["gone"]} if held is not None else set()
                keep, seen, key = np.ones(len(lines), dtype=bool), {}, (doc, h1, h2)
                for a, b, body, hi, lo in chunks(lines, digest):
                    elsewhere = copy > 1 or (odd[hi, lo].get(body, key) < key if (hi, lo) in odd else (hi, lo) in gone)
                    # What overlaps its own first place is no other place.
                    if elsewhere or seen.setdefault(body, b) <= a:
                        keep[a:b] = False
                turns = np.flatnonzero(np.diff(np.r_[True, keep, True].astype(np.int8))).tolist()
                spans = [f"{a}:{b}" for a, b in zip(turns[::2], turns[1::2])]
                out.append(("\n".join(x for x, k in zip(lines, keep) if k) if spans else text, len(lines), int((~keep).sum()), ",".join(spans)))
            yield pd.DataFrame(out, columns=["text", "lines", "removed", "spans"])

    return joined.select("row", reduced(*_KEY, "copy", "row.text", "held").alias("done"))


def deduplicated(docs: DataFrame, digest: Digest = xxhash.xxh3_128_intdigest) -> DataFrame:
    """docs with text reduced, and with __lines, __removed (lines) and __spans (removed runs of lines), in place of
    columns that may have these names."""
    more = {"__lines": "lines", "__removed": "removed", "__spans": "spans"}
    done: dict[str, Column] = {k: F.col(f"done.{v}") for k, v in more.items()}
    return unpacked(reduced_rows(docs, digest), [c for c in docs.columns if c not in more], text=F.col("done.text"), **done)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without repeated chunks. Documents that lose every line are left out: copies of others."""
    rows = reduced_rows(docs).filter("done.removed = 0 or done.removed < done.lines")
    return unpacked(rows, docs.columns, text=F.col("done.text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses, and the digest of what it keeps."""
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


_WORD_SQL = r"'[\p{L}\p{N}]'"
#: The same units, holders and places, with units told by their text.
_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, text, string_split(text, chr(10)) ls FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, len(ls) n, i, regexp_matches(ls[i + 1], {_WORD_SQL}) w, CAST('0x' || substr(md5(ls[i + 1]), 1, 16) AS UBIGINT)::UHUGEINT h FROM (SELECT *, unnest(range(0, len(ls))) i FROM t)),
 rolled AS (SELECT *, CAST((h + coalesce(lag(h) OVER d, 0) * {int(_BASE)}::UHUGEINT % {1 << 64}::UHUGEINT) % {1 << 64}::UHUGEINT AS UBIGINT) r, sum(w::INT) OVER d cw FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 ends AS (SELECT doc_id, i + 1 e, cw FROM rolled WHERE n >= {LEAST} AND xor(r, r >> 29)::UHUGEINT * {int(_BASE)}::UHUGEINT % {1 << 64}::UHUGEINT < {(1 << 64) // EVERY}::UHUGEINT),
 cut AS (SELECT doc_id, 0::BIGINT a, NULL::BIGINT b, 0::HUGEINT cw, 0 k FROM t WHERE len(ls) >= {LEAST}
  UNION ALL SELECT c.doc_id, any_value(coalesce(c.b, c.a)), min(e.e), arg_min(e.cw, e.e), any_value(c.k) + 1 FROM cut c JOIN ends e ON c.doc_id = e.doc_id AND e.e - coalesce(c.b, c.a) >= {LEAST} AND e.cw > c.cw GROUP BY c.doc_id),
 whole AS (SELECT doc_id, max(i) + 1 n, max(cw) cw FROM rolled GROUP BY doc_id),
 last AS (SELECT doc_id, max(k) k, max(coalesce(b, 0)) s, max(cut.cw) cw FROM cut GROUP BY doc_id),
 tail AS (SELECT doc_id, last.k, s, n, n - s >= {LEAST} AND whole.cw > last.cw OR last.k = 0 own FROM last JOIN whole USING (doc_id)),
 chunk AS (SELECT c.doc_id, c.a, CASE WHEN c.k = tail.k AND NOT own THEN n ELSE c.b END b FROM cut c JOIN tail USING (doc_id) WHERE c.k > 0 UNION ALL SELECT doc_id, s, n FROM tail WHERE own),
 worded AS (SELECT doc_id, i, n, lead(i) OVER d nxt, lag(i) OVER d prv FROM l WHERE w AND n >= {LEAST} WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 pairs AS (SELECT doc_id, i a, i + 2 b FROM worded WHERE i + 2 <= n UNION SELECT doc_id, i - 1, i + 1 FROM worded WHERE i >= 1 UNION SELECT doc_id, i, nxt + 1 FROM worded WHERE nxt - i > 2
  UNION SELECT doc_id, 0, i + 1 FROM worded WHERE prv IS NULL AND i > 1 UNION SELECT doc_id, i, n FROM worded WHERE nxt IS NULL AND n - i > 2),
 units AS (SELECT doc_id, a, b, array_to_string(ls[a + 1 : b], chr(10)) body FROM (SELECT doc_id, a, b FROM chunk UNION SELECT doc_id, a, b FROM pairs) JOIN t USING (doc_id)),
 judged AS (SELECT doc_id, a, b, min(doc_id) OVER (PARTITION BY body) < doc_id OR first_value(b) OVER (PARTITION BY doc_id, body ORDER BY a, b) <= a gone FROM units WHERE regexp_matches(body, {_WORD_SQL})),
 lost AS (SELECT DISTINCT doc_id, unnest(range(a, b)) i FROM judged WHERE gone),
 runs AS (SELECT doc_id, min(i) a, max(i) + 1 b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) g FROM lost) GROUP BY doc_id, g),
 told AS (SELECT doc_id, sum(b - a) removed, string_agg(a || ':' || b, ',' ORDER BY a) spans FROM runs GROUP BY doc_id),
 kept AS (SELECT doc_id, string_agg(ls[i + 1], chr(10) ORDER BY i) body FROM l JOIN t USING (doc_id) ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(len(ls), 0) n_lines, CAST(coalesce(removed, 0) AS BIGINT) n_removed, coalesce(spans, '') removed, CASE WHEN d.text IS NULL THEN NULL WHEN removed IS NULL THEN sha256(d.text) ELSE sha256(coalesce(kept.body, '')) END kept_sha256
 FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL: dict[str, str] = {"op1_line_dedup": _SQL}
