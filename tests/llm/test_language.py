"""Language ID: which rows are learned from, and the sums against an enumeration of all segmentations."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ramify.llm import language


def segmentations(word, pieces):
    if not word:
        yield []
    for i, p in enumerate(pieces):
        if p and word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield [i, *rest]


def test_expected_uses_by_enumeration():
    pieces = ("a", "b", "ab", "ba", "aba", "▁", "▁a", "")
    p = [0.2, 0.1, 0.3, 0.05, 0.1, 0.15, 0.1, 0.0]
    counts = Counter({"▁ababa": 3, "▁bb": 2, "▁a": 5})
    uses = np.zeros(len(p))
    for word, times in counts.items():
        every = [(math.prod(p[i] for i in s), s) for s in segmentations(word, pieces)]
        total = sum(w for w, _ in every)
        for w, s in every:
            for i in s:
                uses[i] += times * w / total
    got = language.expected(counts, language.matcher(pieces), frozenset("ab▁"), p)
    assert got.tolist() == pytest.approx(uses.tolist())


def test_posterior_by_enumeration(spark, monkeypatch):
    pieces = ("a", "b", "ab", "ba", "▁", "▁a", "▁b")
    p = np.array([[0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1], [0.1, 0.3, 0.1, 0.2, 0.1, 0.05, 0.15]])

    class Given:
        pass

    Given.pieces = pieces
    monkeypatch.setattr(language, "load", lambda model: Given)
    monkeypatch.setattr(language, "fit", lambda docs, vocabulary: (["x", "y"], p))
    texts = ["ab", "bab a", "b b b", "abab ab", "--"]
    rows = language.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))).collect()
    for r in rows:
        words = texts[r["doc_id"]].split() if r["doc_id"] < 4 else []
        logs = [sum(math.log(sum(math.prod(q[i] for i in s) for s in segmentations("▁" + w, pieces))) for w in words) for q in p]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        want = [math.exp(v) / sum(math.exp(u) for u in logs) for v in logs]
        assert r["lang_pred"] == "xy"[int(np.argmax(want))] and r["score"] == pytest.approx(max(want))


@pytest.mark.parametrize("case", ["no ids", "one id", "one language without ids", "one language is one row"])
def test_learned_whatever_the_ids(spark, case):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").filter("lang is not null and length(text) > 100")
    plain = Counter(r["lang_pred"] for r in language.identified(docs).collect())
    none = F.lit(None).cast("long")
    if case == "no ids":
        rows = docs.withColumn("doc_id", none)
    elif case == "one id":
        rows = docs.withColumn("doc_id", F.lit(3).cast("long"))
        assert not rows.select(language.held_out(F.col("doc_id"))).first()[0]
    elif case == "one language without ids":
        rows = docs.withColumn("doc_id", F.when(F.col("lang") != "fr", F.col("doc_id")))
    else:
        one = docs.filter("lang = 'fr'").orderBy(F.desc(F.length("text"))).limit(1).withColumn("doc_id", F.lit(3).cast("long"))
        rows = docs.filter("lang != 'fr'").unionByName(one.crossJoin(spark.range(3000).select()))
    got = Counter(r["lang_pred"] for r in language.identified(rows).collect())
    assert set(got) == set(plain)
    if case != "one language is one row":
        assert sum((got & plain).values()) >= 0.97 * sum(plain.values())
    else:
        assert got["fr"] >= 2900


def test_sample_bounds_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 5)
    real = language.learn
    rows = spark.createDataFrame([(None, f"mot{i} deux", "fr") for i in range(500)] + [(1, "same text", "en")] * 400, "doc_id long, text string, lang string")
    seen = spark.sparkContext.accumulator(0)

    def counted(texts, pieces):
        texts = list(texts)
        seen.add(len(texts))
        return real(iter(texts), pieces)

    monkeypatch.setattr(language, "learn", counted)
    names, _ = language.fit(rows, language.load(language.MODEL))
    assert names == ["en", "fr"] and seen.value == 10
