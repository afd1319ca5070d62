"""Secret scans with corpus-wide ownership frequency, on DataFrame functions only.

Candidates are the matches of three patterns (assign, access, hex) and, beside them, other long tokens
that mix letters and digits. Hashes of the candidates' values are counted by distinct repositories and
owners over all rows. A value that several owners carry, or that fills a hundred repositories of each
owner it has, is a widely copied example; one that stays with few looks live. Base spans are always reported; of the other tokens only those that look
live are, as kind "owned". Here a document stands for a repository and its source for the owner.

Edge cases: a null text is empty; a null source is an owner of its own; a null doc_id is a value like
any other; rows that share a doc_id stay separate rows (and are one repository); an empty table gives
an empty table; other columns are not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run than the least length can't hide a longer one, so these find the base matches directly.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OTHER = r"[A-Za-z0-9+/_=-]{20,}"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: So many owners make a value an example.
EXAMPLE_OWNERS = 3
#: So do so many repositories for each owner.
EXAMPLE_REPOSITORIES = 100

_SPAN = "array<struct<start:bigint,kind:int,stop:bigint,size:bigint,hash:string,mixed:boolean>>"


#: Elements that a running value goes through at a time; see running().
_CHUNK = 256


def running(values: Column, step, zero: Column) -> Column:
    """The running results of step over an array of longs, each with its own element.

    An array that grows inside a fold is copied at each step, so the fold goes chunk by chunk: what each chunk comes to
    from zero, the results before each chunk, and then the results inside each. step is associative, with zero its unit.
    """

    def fold(v: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, x: Column) -> Column:
            at = step(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(v, none, one, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / _CHUNK).cast("int") - 1), lambda c: F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK)))
        chunks = F.when(F.size(v) > 0, chunks).otherwise(F.array().cast("array<array<bigint>>"))

        def joined(parts: Column) -> Column:
            ends = fold(F.transform(parts, lambda p: F.aggregate(p, zero, lambda s, x: step(s, x))), zero)
            return F.flatten(F.zip_with(parts, F.concat(F.array(zero), ends), lambda p, start: F.when(p.isNotNull(), fold(p, start)).otherwise(F.array().cast("array<bigint>"))))

        return _let(chunks, joined)

    return _let(values, whole)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches in order, with the size and hash of a group's value; mixed: another token holds letters and digits.

    A value is looked at here, where it is at hand: to cut it from the text again would go through all before it.
    """
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    items = F.filter(F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("gap")), lambda x: x["m"].isNotNull())

    def placed(own: Column) -> Column:
        stops = running(F.transform(own, lambda x: (F.length(x["gap"]) + F.length(x["m"])).cast("long")), lambda s, x: s + x, F.lit(0).cast("long"))

        def one(x: Column, stop: Column) -> Column:
            mixed = x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]") if kind == KINDS.index("owned") else F.lit(False)
            return F.struct(
                (stop - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.length(x["v"]).cast("long").alias("size"), F.sha2(x["v"], 256).alias("hash"), mixed.alias("mixed")
            )

        return F.zip_with(own, stops, one)

    return _let(items, placed)


def apart(base: Column, other: Column) -> Column:
    """The spans of other that overlap none of base, in order: each is held against the last end before and the next
    start behind it."""
    far = F.lit((1 << 62)).cast("long")
    side = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x.alias("x")))
    both = F.array_sort(F.concat(side(base, 0), side(other, 1)))

    def judged(v: Column) -> Column:
        ends = running(F.transform(v, lambda e: F.when(e["own"] == 0, e["x"]["stop"]).otherwise(F.lit(0).cast("long"))), F.greatest, F.lit(0).cast("long"))
        behind = F.reverse(running(F.reverse(F.transform(v, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(far))), F.least, far))
        each = F.arrays_zip(v.alias("e"), ends.alias("end"), behind.alias("next"))
        kept = F.filter(each, lambda r: (r["e"]["own"] == 1) & (r["end"] <= r["e"]["start"]) & (r["next"] >= r["e"]["x"]["stop"]))
        return F.transform(kept, lambda r: r["e"]["x"])

    return _let(both, judged)


def _where(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, base and other spans of each row of docs (doc_id, source, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = low.contains(WORDS[0])
    for word in WORDS[1:]:
        named = named | low.contains(word)
    assign = F.filter(_where(named, spans(text, ASSIGN, 0, 2)), lambda x: x["size"] >= 6)
    access = _where(text.contains("AKIA"), spans(text, ACCESS, 1))
    hexes = _where(text.rlike(HEX), spans(text, HEX, 2))
    base = F.array_sort(F.concat(assign, access, hexes))
    other = _where(text.rlike(OTHER), spans(text, OTHER, 3))
    # One struct, bound once to a lambda's variable: nothing below evaluates a pattern again for each span.
    once = F.array(F.struct(base.alias("base"), other.alias("other")))

    def judged(r: Column) -> Column:
        # Pure words and pure numbers are no candidates, nor is what a base span touches.
        kept = F.filter(r["other"], lambda x: x["mixed"])
        return F.struct(r["base"].alias("base"), apart(r["base"], kept).alias("other"))

    return docs.select("doc_id", "source", F.transform(once, judged)[0].alias("__found")).select("doc_id", "source", "__found.base", "__found.other")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories and owners of every candidate value (hash, source, doc_id)."""
    once = found.groupBy("hash", "source", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    owned = once.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("repositories"))
    return owned.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def _joined(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row per row of docs: doc_id, base spans, all spans and the number of live and example spans."""
    rows = checkpointed(candidates(docs).withColumn("row", F.when(F.size("base") + F.size("other") > 0, F.xxhash64("doc_id", "base", "other"))))
    found = rows.filter("row is not null").dropDuplicates(["doc_id", "row", "source"]).select("doc_id", "row", "source", F.explode(F.concat("base", "other")).alias("x"))
    found = found.select("doc_id", "row", "source", "x", F.col("x.hash").alias("hash"))
    few = (F.col("owners") < example_owners) & (F.col("repositories") < F.col("owners") * example_repositories)
    judged = found.join(ownership(found), "hash").withColumn("live", few)
    # Sources of one doc_id have the same spans and counts; each span counts once.
    by_row = judged.groupBy(F.col("doc_id").alias("its_id"), F.col("row").alias("its_row")).agg(F.collect_set(F.struct("x.start", "x.kind", "x.stop", "live")).alias("judged"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,live:boolean>>")
    out = rows.join(by_row, (F.col("row") == F.col("its_row")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    out = out.withColumn("judged", F.coalesce("judged", empty))
    return out.select(
        "doc_id",
        "base",
        F.array_sort(F.filter("judged", lambda x: (x["kind"] < 3) | x["live"])).alias("spans"),
        F.size(F.filter("judged", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        *[of(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def _hits(kind: int, pattern: str, group: int, keep: str = "true") -> str:
    return f"""SELECT doc_id, source, {kind} kind, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) stop FROM (SELECT doc_id, source, unnest(m) m, unnest(v) v, unnest(g[:len(m)]) g, unnest(range(0, len(m))) i
 FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {group}) v, string_split_regex(t, '{pattern}') g FROM docs)) QUALIFY {keep}"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
_SQL = f"""WITH docs AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
 base AS (SELECT *, stop - length(m) AS begin FROM ({_hits(0, _ASSIGN_SQL, 2, 'length(v) >= 6')} UNION ALL {_hits(1, ACCESS, 0)} UNION ALL {_hits(2, HEX, 0)})),
 wide AS (SELECT *, stop - length(m) AS begin FROM ({_hits(3, OTHER, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")})),
 found AS (SELECT * FROM base UNION ALL SELECT * FROM wide w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.begin < w.stop AND w.begin < b.stop)),
 owned AS (SELECT v, sum(n) repositories, count(*) owners FROM (SELECT v, source, count(DISTINCT doc_id) n FROM found GROUP BY v, source) GROUP BY v),
 judged AS (SELECT found.*, owners < {EXAMPLE_OWNERS} AND repositories < owners * {EXAMPLE_REPOSITORIES} live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(begin AS BIGINT) || ':' || CAST(stop AS BIGINT) shown FROM found JOIN owned USING (v)),
 told AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) n_assign, count(*) FILTER (WHERE kind = 1) n_access, count(*) FILTER (WHERE kind = 2) n_hex, string_agg(shown, ',' ORDER BY begin, kind) FILTER (WHERE kind < 3) base,
  string_agg(shown, ',' ORDER BY begin, kind) FILTER (WHERE kind < 3 OR live) spans, count(*) FILTER (WHERE live) n_live, count(*) FILTER (WHERE NOT live) n_example FROM judged GROUP BY doc_id)
 SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
 FROM docs LEFT JOIN told USING (doc_id)"""

QUERIES = {"op4_secrets": op4_secrets}
SQL: dict[str, str] = {"op4_secrets": _SQL}
