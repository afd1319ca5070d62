"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product
over its words (runs of letters, lower-cased, with the mark of a word's start). Piece probabilities are
fitted by expectation maximisation on a bounded sample: the first SAMPLE rows of each language by a
hash of their id and text. Rows whose crc32(doc_id) leaves 2 modulo 4 are never learned from. Rows are scored
against every language with equal priors; the score is the posterior of the best.

Edge cases: more than LANGUAGES languages are an error; a null text, or one without a letter (numerals such as ½ are
none), is `und` with score 0, and so is every text where no
language could be learned; null languages are not learned; rows without an id, and rows that share one, are learned from
like others, and of repeated rows no more than SAMPLE; letters outside the vocabulary cost every
language the same; equally likely languages go to the first by code point; repeated rows get equal
results; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, held_out, lean, released, table
from .vocabulary import MODEL, SPACE, Vocabulary, load

SAMPLE = 400
ROUNDS = 3
#: Probability of a letter that is no piece, in every language.
UNKNOWN = 1e-9
SMOOTH = 0.05
#: Words that a worker remembers, those that are looked up at once, and those that are scored at once.
_CACHE, _MANY, _STEP = 200_000, 50_000, 5_000
_ID_BITS = 24
_WORDS = re.compile(r"[^\W\d_]+")
#: Languages that can be learned: the model has a row of 32,000 numbers for each and is sent to all workers.
LANGUAGES = 500
_LONG = 40


def matcher(pieces: tuple[str, ...], gains: list[float] | None = None, packed: bool = False):
    """An Aho-Corasick automaton over the pieces; its values are (length, id), and gains[id] where there are gains;
    packed: both in one number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        if p:
            found.add_word(p, (len(p) << _ID_BITS) + i if packed else (len(p), i) if gains is None else (len(p), i, gains[i]))
    found.make_automaton()
    return found


def edges(word: str, automaton, singles: frozenset[str]) -> list[tuple[int, int, int]]:
    """(end, length, id) of every piece in a word by end; id -1 for a letter that is no piece."""
    found = [(end + 1, n, i) for end, (n, i) in automaton.iter(word)]
    odd = [(p + 1, 1, -1) for p, c in enumerate(word) if c not in singles]
    return sorted(found + odd) if odd else found


def log_forward(word: str, automaton, singles: frozenset[str], rows: list[list[float]], languages: int) -> list[float]:
    """ln of the summed probability of all segmentations of a word, by language."""
    found = edges(word, automaton, singles)
    if len(word) <= _LONG:
        at: list = [None] * (len(word) + 1)
        at[0] = [1.0] * languages
        unknown = [UNKNOWN] * languages
        for end, n, i in found:
            a, p = at[end - n], rows[i] if i >= 0 else unknown
            if at[end] is None:
                at[end] = [x * y for x, y in zip(a, p)]
            else:
                at[end] = [c + x * y for c, x, y in zip(at[end], a, p)]
        return [math.log(x) if x > 0 else -1e4 for x in at[-1]]
    logs = np.full((len(word) + 1, languages), -np.inf)
    logs[0] = 0.0
    for end, n, i in found:
        logs[end] = np.logaddexp(logs[end], logs[end - n] + (np.log(rows[i]) if i >= 0 else math.log(UNKNOWN)))
    return logs[-1].tolist()


def letters(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased; numerals such as ½ or Ⅷ are word characters but no letters."""
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def words(text: str | None) -> list[str]:
    return [SPACE + w for w in letters(text)] if text else []


def log_sum(a: float, b: float) -> float:
    """ln(exp(a) + exp(b))."""
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expected(counts: Counter, automaton, singles: frozenset[str], p: list[float]) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the counted words."""
    uses = np.zeros(len(p))
    for word, times in counts.items():
        found = edges(word, automaton, singles)
        if len(word) > _LONG:
            # The same sums in logarithms, as the products of long words are too small for floats.
            logs = [math.log(p[i]) if i >= 0 else math.log(UNKNOWN) for _, _, i in found]
            fore, back = [-math.inf] * (len(word) + 1), [-math.inf] * (len(word) + 1)
            fore[0] = back[-1] = 0.0
            for (end, n, _), log in zip(found, logs):
                fore[end] = log_sum(fore[end], fore[end - n] + log)
            for (end, n, _), log in zip(reversed(found), reversed(logs)):
                back[end - n] = log_sum(back[end - n], back[end] + log)
            for (end, n, i), log in zip(found, logs):
                if i >= 0:
                    uses[i] += times * math.exp(fore[end - n] + log + back[end] - fore[-1])
            continue
        fore, back = [0.0] * (len(word) + 1), [0.0] * (len(word) + 1)
        fore[0] = back[-1] = 1.0
        for end, n, i in found:
            fore[end] += fore[end - n] * (p[i] if i >= 0 else UNKNOWN)
        for end, n, i in reversed(found):
            back[end - n] += back[end] * (p[i] if i >= 0 else UNKNOWN)
        if fore[-1] > 0:
            for end, n, i in found:
                if i >= 0:
                    uses[i] += times * fore[end - n] * p[i] * back[end] / fore[-1]
    return uses


def learn(texts: Iterator[str], pieces: tuple[str, ...]) -> np.ndarray:
    """Piece probabilities of one language."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(words(text))
    automaton, singles = matcher(pieces), frozenset(p for p in pieces if len(p) == 1)
    p = np.array([1.0 / (i + 2) if x else 0.0 for i, x in enumerate(pieces)])
    p /= p.sum()
    usable = np.array([bool(x) for x in pieces])
    for _ in range(ROUNDS):
        uses = np.where(usable, expected(counts, automaton, singles, p.tolist()) + SMOOTH, 0.0)
        p = uses / uses.sum()
    return p


def fit(docs: DataFrame, vocabulary: Vocabulary) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their piece probabilities (languages x pieces)."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # A hash limit that leaves about three times SAMPLE of each language, so that no rank sees a whole language. Rows that
    # are equal in id and text share a place; as the limit follows from how many places there are, they can't all miss it.
    hashed = F.xxhash64("doc_id", "text")
    place = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = known.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("places"))
    counts = checkpointed(counts)
    if counts.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: this column holds something else")
    # Broadcast, so that rows are left out before any is dealt by its language. Of equal rows a task hands on SAMPLE at most.
    likely = known.select("doc_id", "lang", "text", place.alias("place")).join(F.broadcast(counts), "lang").filter(F.col("place") * F.col("places") < 3 * SAMPLE)
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    some = likely.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE).select("lang", "text")
    sent = spark.sparkContext.broadcast(vocabulary.pieces)

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [learn(iter(pdf["text"]), sent.value).astype("<f8").tobytes()]})

    model = some.groupBy("lang").applyInPandas(learned, "lang string, p binary").toPandas().sort_values("lang")
    return list(model["lang"]), np.array([np.frombuffer(b, dtype="<f8") for b in model["p"]])


class Words(dict):
    """Row numbers of words in a table of scores, kept for a bounded number of them."""

    def __init__(self, pieces: tuple[str, ...], p: np.ndarray):
        self.pieces, self.singles, self.languages = pieces, frozenset(x for x in pieces if len(x) == 1), len(p)
        self.numbers = matcher(pieces, packed=True)
        # The last row is that of a letter that is no piece, whose id is -1.
        self.p = np.vstack([p.T, np.full((1, len(p)), UNKNOWN)])
        self.table = np.zeros((1024, self.languages))

    def add(self, new: list[str]) -> None:
        """Scores of words that are not known yet, all of them letter by letter side by side."""
        while len(self) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        short = [w for w in new if len(w) < _LONG]
        if short:
            at = np.arange(len(self), len(self) + len(short))
            self.table[at] = self.forward([SPACE + w for w in short])
            self.update(zip(short, at.tolist()))
        for word in new:
            if len(word) >= _LONG:
                self.table[len(self)] = log_forward(SPACE + word, self.automaton, self.singles, self.p, self.languages)
                self[word] = len(self)

    @functools.cached_property
    def automaton(self):
        return matcher(self.pieces)

    def packed(self, word: str) -> list[int]:
        """The edges of a word, in no order: place of the last letter, length and id in one number each."""
        found = [(end << 40) + v for end, v in self.numbers.iter(word)]
        if not self.singles.issuperset(word):
            found += [(k << 40) + (1 << _ID_BITS) + len(self.pieces) for k, c in enumerate(word) if c not in self.singles]
        return found

    def forward(self, words: list[str]) -> np.ndarray:
        """What log_forward gives, for many words of up to _LONG letters."""
        found = [self.packed(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(f) for f in found])
        flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=len(owner))
        turn = np.lexsort((owner, flat >> 40))
        flat, owner = flat[turn], owner[turn]
        end, size, piece = (flat >> 40) + 1, (flat >> _ID_BITS) & ((1 << (40 - _ID_BITS)) - 1), flat & ((1 << _ID_BITS) - 1)
        start = end - size
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        longest = int(lengths.max())
        sums = np.zeros((longest + 1, len(words), self.languages))
        sums[0] = 1.0
        bounds = np.searchsorted(end, np.arange(1, longest + 2))
        for k in range(1, longest + 1):
            a, b = bounds[k - 1], bounds[k]
            own = owner[a:b]
            if len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                sums[k, own[first]] = np.add.reduceat(sums[start[a:b], own] * self.p[piece[a:b]], first, axis=0)
        last = sums[lengths, np.arange(len(words))]
        return np.where(last > 0, np.log(np.where(last > 0, last, 1.0)), -1e4)

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """ln of the texts' probabilities by language; None without a letter."""
        out: list[np.ndarray | None] = []
        held: list[list[str]] = []
        size = 0
        for text in [*texts, None]:
            found = letters(text) if text else []
            held.append(found)
            size += len(found)
            if size >= _MANY or len(held) > len(texts) - len(out):
                out.extend(self.summed(held))
                held, size = [], 0
        return out[: len(texts)]

    def summed(self, held: list[list[str]]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        every = [w for found in held for w in found]
        total = [np.zeros(self.languages) for _ in held]
        owner = np.repeat(np.arange(len(held)), [len(f) for f in held])
        for at in range(0, len(every), _MANY):
            part = every[at : at + _MANY]
            if len(self) > _CACHE:
                self.clear()
            new = list(dict.fromkeys(w for w in part if w not in self))
            for k in range(0, len(new), _STEP):
                self.add(new[k : k + _STEP])
            rows = self.table[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))]
            own = owner[at : at + _MANY]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for k, s in zip(own[first].tolist(), np.add.reduceat(rows, first, axis=0)):
                total[k] = total[k] + s
        out.extend(t if f else None for t, f in zip(total, held))
        return out


def identified(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    lean(spark)
    vocabulary = load(model)
    languages, p = fit(docs, vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary.pieces, languages, p))

    @released
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, names, probabilities = sent.value
        known = Words(pieces, probabilities) if names else None
        for pdf in batches:
            out = []
            for logs in known.scores(pdf["text"].tolist()) if known is not None else [None] * len(pdf):
                if logs is None:
                    out.append(("und", 0.0))
                    continue
                best = int(np.argmax(logs))
                out.append((names[best], float(1.0 / np.exp(logs - logs[best]).sum())))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op10_language": op10_language}
SQL: dict[str, str] = {}
