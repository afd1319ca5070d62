"""Nulls, empty tables, repeated rows and clashing columns, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ramify.llm import embeddings, fingerprints, language, lines, minhash, mixing, secrets, sentencepiece, suffixes, toxicity
from ramify.llm.common import word_count
from ramify.llm.vocabulary import load

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten eleven twelve. " * 60
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "x", "en", None, 1), (5, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "a", len(LONG)), (None, "no id here at all, but six words", "de", "b", 9), (7, LONG, "de", "b", 1), (8, "é漢字 😀 \x00 ok\nline", "de", "c", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["__size", "row", "hash", "score", "u", "__doc", "__lines", "__removed", "__spans", "__key", "key", "size", "taken", "words", "__kept", "__r", "__taken", "doc", "its"]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(1) for c in extra})


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


LABELS = "doc_id long, toxic int"


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(2, 0), (5, 1), (7, 0), (7, None), (None, 1)], LABELS)


def applied(name, spark, docs):
    few = docs.select("doc_id", "text", "lang", "source", "n_chars")
    if name == "mixing":
        sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
        return mixing.mix(sized.checkpoint()), len(ROWS)
    if name == "secrets":
        return secrets.scan(docs), len(ROWS)
    if name == "fingerprints":
        return fingerprints.fingerprinted(docs), len(ROWS)
    if name == "toxicity":
        return toxicity.scored(docs, labels(spark)), len(ROWS)
    if name == "language":
        return language.identified(docs), len(ROWS)
    if name == "lines":
        return lines.deduplicated(docs), len(ROWS)
    if name == "minhash":
        return minhash.classes(docs), len(ROWS)
    if name == "suffixes":
        return suffixes.deduplicated(docs), len(ROWS)
    if name == "sentencepiece":
        return sentencepiece.encode(few, load()), len(ROWS)
    raise KeyError(name)


NAMES = "mixing secrets fingerprints toxicity language lines minhash suffixes sentencepiece".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    out, n = applied(name, spark, docs)
    rows = out.collect()
    assert len(rows) == n
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    out, _ = applied(name, spark, none)
    assert out.count() == 0


def test_odd_results(spark, docs):
    langs = {(r["doc_id"], r["lang_pred"]) for r in language.identified(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= langs
    same = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert same[5] == same[7] == 5 and same[1] == 1 and same[2] == 2 and same[3] == 3
    gone = {r["doc_id"]: r["removed"] for r in suffixes.deduplicated(docs).collect()}
    assert [(r["start"], r["stop"]) for r in gone[5]] == [(0, len(LONG))] and not gone[8]
    assert toxicity.without_toxic(docs, labels(spark, empty=True)).count() == len(ROWS)


def test_copies_lose_every_line(spark):
    texts = ["\n".join(f"line {i} {k} of {n}" for k in range(n)) for n in range(2, 12) for i in range(20)] + ["\n\n--\n\nwords\n\n--", "--\n--\n--\na b\nc d\n--"]
    rows = [(i + len(texts) * c, x) for c in range(2) for i, x in enumerate(texts)]
    out = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["__removed"] == (r["__lines"] if r["doc_id"] >= len(texts) else 0) for r in out)


def test_short_repeated_runs_go(spark):
    own = lambda i, k: f"own {i} {k}"
    runs = [[f"run {j} {k}" for k in range(2 + j % 5)] for j in range(40)]
    rows = [(i, "\n".join([*(own(i, k) for k in range(i % 4)), *runs[i % 40], *(own(i, 9 - k) for k in range(i % 3))])) for i in range(80)]
    rows += [(90, "a 1\n\n\n\nb 2\nx"), (91, "y\na 1\n\n\n\nb 2"), (92, "q\nq\nq\nu\nq\nq")]
    # Also with hashes that differ for few texts.
    for digest in ((), (lambda b: len(b) % 8,)):
        out = {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), *digest).collect()}
        assert all(out[i]["__removed"] == (len(runs[i % 40]) if i >= 40 else 0) for i in range(80))
        assert (out[90]["__removed"], out[91]["text"], out[92]["text"], out[92]["__spans"]) == (0, "y", "q\nq\nq\nu", "4:6")


def test_rows_without_an_id_of_their_own(spark):
    text = lambda i: " ".join(f"t{i}w{k}" for k in range(60))
    big = (1 << 60) + 1
    rows = [(None, text(i), i) for i in range(20)] + [(7, text(i), i) for i in range(20, 40)] + [(100 + i, text(i), i) for i in range(10, 30)] + [(big, text(50), 50), (big + 1, text(50), 50), (3, text(30), 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    kept = minhash.one_of_each(docs).collect()
    assert sorted(r["n"] for r in kept) == [*range(40), 50]
    want = {i: None if i < 20 else 3 if i == 30 else 7 if i < 40 else big for i in [*range(40), 50]}
    assert {r["n"]: r["doc_id"] for r in kept} == want
    got = minhash.classes(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 41
    assert {r["doc_id"]: r["class_id"] for r in got}[big + 1] == big and all(r["class_id"] is None for r in got if r["doc_id"] and 110 <= r["doc_id"] < 120)


def test_mixing_cuts_few_texts(spark):
    rows = [(i, i, f"s{i % 20}", 30) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "row long, doc_id long, source string, size long")).collect()
    # 200 rows to a source are one shard of 6 blocks; texts are cut at the edges of blocks, twice a block at most.
    cut = [r for r in out if r["taken"] % r["size"]]
    assert len(cut) <= 20 * 6 * 2 and len(out) == len(rows) and abs(sum(r["taken"] for r in out) - 30 * len(rows)) <= 20
    assert sum(r["taken"] == 0 for r in out) > 500, "blocks are chosen, not every text cut"


def test_mixing_deals_rows_without_an_id(spark):
    rows = [(i, None if i % 2 else 7, "s", 10 + i % 5) for i in range(4000)]
    sized = spark.createDataFrame(rows, "row long, doc_id long, source string, size long")
    out = mixing.mix(sized).collect()
    assert len(out) == 4000 and sum(r["taken"] for r in out) == sum(r["size"] for r in out)
    assert mixing.mix(sized.limit(0)).count() == 0


def test_mixing_spreads_rows_of_one_id_by_their_content(spark):
    sized = spark.createDataFrame([(i, 7, "s", 10, f"{i:032x}") for i in range(4000)], "row long, doc_id long, source string, size long, content string")
    shards = Counter(r["shard"] for r in mixing.dealt(sized)[0].collect())
    assert len(shards) == 8 and max(shards.values()) < 700
    assert sum(r["taken"] for r in mixing.mix(sized).collect()) == 40_000
    assert len({r["shard"] for r in mixing.dealt(sized.drop("content"))[0].collect()}) == 1


def test_mixing_of_many_sources(spark, monkeypatch):
    sized = spark.createDataFrame([(i, i, f"s{i % 50}", i % 40) for i in range(2000)], "row long, doc_id long, source string, size long")
    want = sorted(mixing.mix(sized).collect())
    assert mixing.dealt(sized)[0]._jdf.queryExecution().toString().count("broadcast") > 0
    monkeypatch.setattr(mixing, "SOURCES", 10)
    assert "strategy=broadcast" not in mixing.dealt(sized)[0]._jdf.queryExecution().toString()
    assert sorted(mixing.mix(sized).collect()) == want


def test_toxicity_learns_from_few_rows(spark):
    rows = [(i, f"common words {'vile' if i % 2 else 'kind'} here {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], LABELS)
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    assert min(out[i] for i in range(1, 60, 2)) > max(out[i] for i in range(0, 60, 2)) + 0.3


def test_a_row_too_long_to_learn_from_keeps_no_other_out():
    sizes = [(i, 10) for i in range(20)] + [(99, 10_000)]
    assert sorted(toxicity.fitting(sizes, 200)) == list(range(20)) and len(toxicity.fitting(sizes, 45)) == 4


def test_lines_of_rows_without_an_id(spark):
    text = lambda i: "\n".join(f"line {i} {k}" for k in range(5))
    rows = [(3, text(1)), (3, text(1)), (3, text(2)), (None, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (9, text(4)), (3, None), (None, "")]
    out = sorted((str(r["doc_id"]), r["text"] or "", r["__removed"]) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(out) == len(rows) and sum(r[2] for r in out) == 20
    for i in range(1, 5):
        assert sum(r[1] == text(i) for r in out) == 1, "one row keeps its lines"
    assert ("9", text(4), 0) in out and ("3", text(2), 0) in out


def test_secrets_of_many_repositories_are_examples(spark):
    rows = [(i, "a", "see T0kenValue1234567890abcXYZ") for i in range(100)] + [(200 + i, "ab"[i % 2], "see Zz0kenValue1234567890abcXYZ") for i in range(40)]
    out = {r["doc_id"]: (len(r["spans"]), r["n_live"], r["n_example"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(out[i] == ((0, 0, 1) if i < 100 else (1, 1, 0)) for i in out) and len(out) == 140


def test_long_runs_of_letters_are_learned_from(monkeypatch):
    from collections import Counter

    pieces = ("a", "b", "ab", "ba", "▁", "▁a", "")
    automaton, singles, p = language.matcher(pieces), frozenset("ab▁"), [0.2, 0.1, 0.3, 0.1, 0.2, 0.1, 0.0]
    words = Counter({"▁ababba": 2, "▁axb": 1, "x▁bba": 3})
    short = language.expected(words, automaton, singles, p)
    monkeypatch.setattr(language, "_LONG", 2)
    assert language.expected(words, automaton, singles, p) == pytest.approx(short)
    # Every letter of a run of 6,000 is in some piece.
    uses = language.expected(Counter({"▁" + "ab" * 3000: 1}), automaton, singles, p)
    assert sum(n * len(x) for n, x in zip(uses, pieces)) == pytest.approx(6001)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [nan, 1.0, 1.0, 1.0]), (5, [inf, 1.0, 1.0, 1.0]), (6, [None, 1.0, 1.0, 1.0]), (7, v), (8, v), (9, w), (9, w), (10, [-x for x in v]), (None, v), (11, [1.0])]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11))
    assert got[7] == (4, 7, True) and got[9] == (4, 7, False) and got[None] == (4, 7, False)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
