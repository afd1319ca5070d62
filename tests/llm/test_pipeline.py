"""Every stage of the pipeline over odd rows, and the whole of it."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ramify.llm import sentencepiece
from ramify.llm.common import WORD
from ramify.llm.vocabulary import load

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def lines(i, n):
    return "\n".join(f"line {i} of {k} here" for k in range(n))


LONG = words(77, 30_000)
#: Nulls in every column, empty and blank texts, one long text, copies under other, shared and no ids.
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (None, None, "de", "b", 0),
    (5, lines(1, 6), "en", "a", 1), (5, lines(1, 6), "en", "a", 1), (6, lines(1, 6), "en", "b", 1), (None, lines(2, 6), "de", "b", 1), (None, lines(2, 6), "de", "b", 1),
    (None, lines(3, 6), None, "b", 1), (7, lines(4, 6), "en", "a", 1), (7, lines(5, 6), "en", "a", 1), (8, LONG, "en", "c", 1), (9, LONG + " more", "en", "c", 1), (10, "é漢字 😀 ok\nline two", "de", "c", 3),
]
#: Names that operators may use for columns of their own.
MORE = ["__doc", "__row", "row", "key", "keys", "size", "taken", "words", "score", "done", "held", "h1", "h2", "doc", "copy", "its", "__kept", "kept", "hi", "lo", "node", "chunk", "ids", "like", "u", "v", "quota", "shard"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(MORE)})


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), DATA)
    assert out.count() == 0


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_stay(spark, docs, name):
    out = STAGES[name](spark, docs, DATA)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert all(r[c] == i for r in out.collect() for i, c in enumerate(MORE))


def kept(spark, docs, name):
    return Counter((r["doc_id"], r["text"]) for r in STAGES[name](spark, docs, DATA).collect())


def test_toxic_rows_go_and_others_stay(spark, docs):
    assert kept(spark, docs, "toxicity") == Counter((r[0], r[1]) for r in ROWS)
    known = spark.read.parquet(f"{DATA}/documents.parquet")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").collect()}
    out = {r["doc_id"] for r in STAGES["toxicity"](spark, known, DATA).collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 0").collect()} - bad
    assert len(out & bad) <= 0.5 * len(bad) and len(clean - out) <= 0.05 * len(clean)


def test_repeated_lines_go(spark, docs):
    got = kept(spark, docs, "line dedup")
    want = Counter((r[0], r[1]) for r in ROWS)
    # One of the copies of each text keeps its lines: the smallest id's, or one of those that share it.
    want -= Counter([(5, lines(1, 6)), (6, lines(1, 6)), (None, lines(2, 6))])
    assert got == want


def test_one_of_near_copies_stays(spark, docs):
    got = kept(spark, docs, "MinHash near-dedup")
    want = Counter((r[0], r[1]) for r in ROWS)
    want -= Counter([(5, lines(1, 6)), (6, lines(1, 6)), (None, lines(2, 6)), (9, LONG + " more")])
    assert got == want


def test_mix_keeps_words(spark, docs):
    out = STAGES["mixing sources to target weights"](spark, docs, DATA)
    count = lambda frame: frame.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0]
    assert abs(count(out) - count(docs)) <= 10
    texts = {r["text"] for r in docs.collect()}
    assert all(any(t is not None and t.startswith(r["text"]) for t in texts) for r in out.collect())


def test_every_row_is_encoded(spark, docs):
    rows = STAGES["SentencePiece encoding and decoding"](spark, docs, DATA).collect()
    own = sentencepiece.Encoder(load())
    want = Counter((r[0], tuple(own.whole(sentencepiece.marked(r[1], True)).tolist()) if r[1] else ()) for r in ROWS)
    parts = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        assert r["exact"]
        if r["chunks"] > 1:
            parts.setdefault(r["doc_id"], []).extend(r["ids"])
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in rows if r["chunks"] == 1) + Counter((d, tuple(x)) for d, x in parts.items())
    assert got == want and max(r["chunks"] for r in rows) > 1


def test_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "chunk", "chunks", "ids", "n_ids", "exact"]
    rows = out.collect()
    assert 0 < len({r["doc_id"] for r in rows}) <= docs.count() and all(r["exact"] for r in rows)
