"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is prefixed with a space, spaces become the word mark, and the segmentation into pieces of the
vocabulary with the largest summed score is taken; a letter that is no piece costs UNKNOWN below the
worst piece and is written as its UTF-8 bytes. Among equal sums the segmentation with fewer pieces
wins, then the one with larger sums of the pieces' starts and of their squares. All of this is packed
into one integer a piece, so paths add up and compare exactly.

No piece crosses the start of a word, nor two letters that stand side by side in no piece, so what lies
between such places is solved one by one and remembered. A text longer than
CHUNK letters is cut into chunks at any letter. The state at a cut is how far the piece that covers
it reaches beyond. Each chunk, on its own, yields the matrix of best sums from state to state: full, or
(where a word starts inside) a column plus a row. Matrices are combined by the max-plus product, which is
associative: first those of BLOCK neighbouring chunks, then those of a document's blocks. That fixes
the states at blocks, then, block by block, at chunks, and each chunk is traced back on its own.

encode() returns one row per chunk: the columns asked for, chunk, chunks, ids and the sha256 of the
letters covered. decode() turns ids back into exactly these letters.

Edge cases: a null text is empty, and an empty text has no ids; the word mark itself, where a text
has it, is written as bytes, so decoding is exact for every text; rows are independent of each other, so
repeated rows, shared and null ids are kept as they are; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, released, stored, table
from .language import matcher
from .vocabulary import MODEL, SPACE, Vocabulary, load

CHUNK, BLOCK = 65_536, 256
UNKNOWN = 10 * 1024
#: Stands for a word mark of the text itself; no text from UTF-8 holds it.
_MARK = "\udc96"
#: Words that a worker remembers, those that it looks up and the ids that leave it at once.
_CACHE, _STEP, _IDS = 300_000, 50_000, 1 << 20
#: Bits below the score, the number of pieces and the sum of starts.
_SHORT, _LONG = (54, 44, 26), (190, 158, 92)
#: The same for words of up to _LETTERS letters, whose sums then take less than 53 bits.
_TINY, _LETTERS, _NONE = (30, 24, 14), 32, -math.inf


def splitter(pieces: tuple[str, ...]) -> re.Pattern:
    """Cuts a marked text where no piece reaches across: at the start of a word, at least.

    Where no piece holds a letter beside anything else than letters and a leading mark, runs of letters and of other
    characters part too; ASCII characters that no longer piece holds stand alone.
    """
    beside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
    longer = frozenset("".join(beside))
    alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in longer)
    letter = re.compile(r"[^\W\d_]")
    mixed = lambda odd: {b for b in beside if b[0] != SPACE and (bool(letter.match(b[0])) and b[0] not in odd) != (bool(letter.match(b[1])) and b[1] not in odd)}
    odd = {c for b in mixed("") for c in b if letter.match(c) and ord(c) > 127}
    if mixed(odd):
        return re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
    letters = r"[^\W\d_" + "".join(map(re.escape, sorted(odd))) + "]"
    other = rf"(?:(?!{letters})[^{SPACE}{alone}])"
    return re.compile(f"{SPACE}*(?:{letters}+|{other}+)|{SPACE}+" + (f"|[{alone}]" if alone else ""))


class _Words(dict):
    """Numbers of words, solved where they are new; the ids of word k are pool[ends[k]:ends[k + 1]]."""

    def __init__(self, solve):
        self.solve, self.pool, self.ends = solve, array("i"), array("i", [0])

    def __missing__(self, word: str) -> int:
        self.pool.extend(self.solve(word))
        self.ends.append(len(self.pool))
        k = self[word] = len(self)
        return k


class Encoder:
    """Best segmentations over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.scores, self.pieces, self.bytes = vocabulary.scores, vocabulary.pieces, vocabulary.bytes
        self.singles = frozenset(p for p in vocabulary.pieces if len(p) == 1)
        self.automaton = matcher(vocabulary.pieces, [float((s << _TINY[0]) - (1 << _TINY[1])) for s in vocabulary.scores])
        self.reach = max(map(len, vocabulary.pieces))
        self.unknown = min(vocabulary.scores) - UNKNOWN
        self.words = splitter(vocabulary.pieces)
        self.places = [float((k << _TINY[2]) + k * k) for k in range(_LETTERS + 1)]
        self.sizes = [len(p) for p in self.pieces]
        self.alone = {p: i for i, p in enumerate(self.pieces) if len(p) == 1}
        self.forget()

    def forget(self) -> None:
        self.rows = _Words(self.solved)

    def edges(self, text: str) -> list[tuple[int, int, int]]:
        """(end, start, id) by end; id -1 for a letter that is no piece."""
        found = [(end + 1, end + 1 - n, i) for end, (n, i, _) in self.automaton.iter(text)]
        odd = [(p + 1, p, -1) for p, c in enumerate(text) if c not in self.singles]
        return sorted(found + odd) if odd else found

    def gain(self, start: int, i: int, bits: tuple[int, int, int]) -> int:
        return ((self.scores[i] if i >= 0 else self.unknown) << bits[0]) - (1 << bits[1]) + (start << bits[2]) + start * start

    def table(self, text: str, begin: dict[int, int], stop: int, base: int, bits: tuple[int, int, int]) -> tuple[list, list]:
        """Best sums and last pieces at each letter, from the sums in begin; pieces start before stop."""
        best: list = [None] * (len(text) + 1)
        last: list = [None] * (len(text) + 1)
        for at, value in begin.items():
            best[at] = value
        for end, start, i in self.edges(text):
            if start >= stop or best[start] is None:
                continue
            value = best[start] + self.gain(base + start, i, bits)
            if best[end] is None or value > best[end]:
                best[end], last[end] = value, (start, i)
        return best, last

    def path(self, word: str) -> list[tuple[int, int]]:
        """(start, id) of a word's best pieces from its end back."""
        _, last = self.table(word, {0: 0}, len(word), 0, _SHORT if len(word) <= 256 else _LONG)
        end, out = len(word), []
        while last[end] is not None:
            out.append(last[end])
            end = last[end][0]
        return out

    def solved(self, word: str) -> list[int]:
        """Ids of a word that is cut nowhere."""
        n, out = len(word), []
        if n == 1 and word in self.alone:
            return [self.alone[word]]
        if n <= _LETTERS and self.singles.issuperset(word):
            # What path() does, for most words, in floats that hold these sums exactly.
            best, last, places = [0.0] + [_NONE] * n, [0] * (n + 1), self.places
            for end, (size, i, gain) in self.automaton.iter(word):
                start = end - size + 1
                value = best[start] + places[start] + gain
                if value > best[end + 1]:
                    best[end + 1] = value
                    last[end + 1] = i
            while n:
                i = last[n]
                out.append(i)
                n -= self.sizes[i]
            out.reverse()
            return out
        for start, i in reversed(self.path(word)):
            if i >= 0:
                out.append(i)
            else:
                letter = SPACE if word[start] == _MARK else word[start]
                out.extend(self.bytes[b] for b in letter.encode("utf-8", "surrogatepass"))
        return out

    def whole(self, marked: str) -> np.ndarray:
        """Ids of a text that is not cut."""
        out, words = [], self.words.findall(marked)
        for at in range(0, len(words), _STEP):
            if len(self.rows) > _CACHE or len(self.rows.pool) > 8 * _CACHE:
                self.forget()
            part = words[at : at + _STEP]
            rows = np.fromiter(map(self.rows.__getitem__, part), dtype=np.int64, count=len(part))
            # Views of the table as it is now; a table that is looked at can't grow.
            ends, pool = np.frombuffer(self.rows.ends, dtype=np.int32), np.frombuffer(self.rows.pool, dtype=np.int32)
            starts = ends[rows].astype(np.int64)
            sizes = ends[rows + 1] - starts
            stops = np.cumsum(sizes)
            out.append(pool[np.repeat(starts - stops + sizes, sizes) + np.arange(int(stops[-1]))])
            del ends, pool
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)

    def cuts(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and the last start of a word from where every state has merged to the chunk's end."""
        first = next((m.start() for m in re.compile(SPACE).finditer(text, self.reach) if text[m.start() - 1] != SPACE), None)
        if first is None or first > size:
            return None
        at = size
        while at > first and not (text[at : at + 1] == SPACE and text[at - 1] != SPACE):
            at -= 1
        return first, at

    def sums(self, word: str) -> tuple[int, int, int, int]:
        """Score and number of a word's best pieces, and the sums of their starts and of their squares."""
        path = self.path(word)
        return sum(self.scores[i] if i >= 0 else self.unknown for _, i in path), len(path), sum(p for p, _ in path), sum(p * p for p, _ in path)

    def matrix(self, text: str, size: int, base: int, ends: bool):
        """Best sums of a chunk (with what lies within reach behind it) from state to state.

        ("parts", column, middle + row) where words start inside, else ("full", rows). None: no path.
        """
        states = range(min(self.reach, size + 1)) if base else range(1)
        goals = range(1) if ends else range(min(self.reach, len(text) - size + 1))
        cut = self.cuts(text, size)
        if cut is None:
            rows = []
            for i in states:
                best, _ = self.table(text, {i: 0}, size, base, _LONG)
                rows.append([best[size + j] for j in goals])
            return "full", rows
        first, at = cut
        column = []
        for i in states:
            best, _ = self.table(text[:first], {i: 0}, first, base, _LONG)
            column.append(best[first])
        # A word's sums move with its place: starts by number * place, squares by the binomial.
        place, score, number, starts, squares = base + first, 0, 0, 0, 0
        known: dict[str, tuple[int, int, int, int]] = {}
        for word in self.words.findall(text[first:at]):
            if word not in known:
                known[word] = self.sums(word)
            a, n, x, y = known[word]
            score, number, starts, squares = score + a, number + n, starts + n * place + x, squares + (n * place + 2 * x) * place + y
            place += len(word)
        total = (score << _LONG[0]) - (number << _LONG[1]) + (starts << _LONG[2]) + squares
        best, _ = self.table(text[at:], {0: 0}, size - at, base + at, _LONG)
        return "parts", column, [None if best[size - at + j] is None else total + best[size - at + j] for j in goals]

    def traced(self, text: str, size: int, enter: int, leave: int) -> np.ndarray:
        """Ids of a chunk between two states."""
        end = size + leave
        # Within the states' path a word starts where one starts in the text, so words stand alone again.
        return self.whole(text[enter:end] if enter < end else "")


def _best(vector: list, others: list):
    """The largest sum of two rows of sums, place by place; None: no path."""
    reached = [v + c for v, c in zip(vector, others) if v is not None and c is not None]
    return max(reached) if reached else None


def _moved(vector: list, by) -> list:
    return [None if x is None or by is None else x + by for x in vector]


def product(vector: list, m) -> list:
    """Max-plus product of a vector of sums and a matrix."""
    if m[0] == "parts":
        return _moved(m[2], _best(vector, m[1]))
    return [_best(vector, [row[j] for row in m[1]]) for j in range(len(m[1][0]) if m[1] else 0)]


def composed(a, b):
    """Max-plus product of two matrices; it is associative, so neighbours can be combined in any order."""
    if a[0] == "parts":
        # The row of a goes through b; its column stays.
        return "parts", a[1], product(a[2], b)
    if b[0] == "parts":
        return "parts", [_best(row, b[1]) for row in a[1]], b[2]
    return "full", [product(row, b) for row in a[1]]


def combined(matrices: list):
    """The product of neighbouring matrices, by a tree."""
    while len(matrices) > 1:
        matrices = [composed(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def entered(vector: list, m, leave: int) -> int:
    """The state at a matrix's start on the best path to state `leave` at its end."""
    column = m[1] if m[0] == "parts" else [row[leave] for row in m[1]]
    sums = [(v + c, i) for i, (v, c) in enumerate(zip(vector, column)) if v is not None and c is not None]
    return max(sums)[1]


def states(matrices: list, enter: int = 0, leave: int = 0) -> list[int]:
    """The states at all cuts between neighbouring matrices, the first and last included, which are given."""
    vectors = [[None] * enter + [0]]
    for m in matrices[:-1]:
        vectors.append(product(vectors[-1], m))
    path = [leave]
    for m, v in zip(reversed(matrices), reversed(vectors)):
        path.append(entered(v, m, path[-1]))
    return path[::-1]


def marked(text: str, first: bool) -> str:
    out = text.replace(SPACE, _MARK).replace(" ", SPACE)
    return SPACE + out if first else out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Out:
    """Rows with ids on their way out, in slices of about _IDS ids."""

    def __init__(self, kept: list[str], pieces: list[bytes]):
        self.kept, self.pieces = kept, pieces
        self.clear()

    def clear(self) -> None:
        self.at, self.ids, self.shas, self.exact, self.size = [], [], [], [], 0

    def add(self, at: int, ids: np.ndarray, letters: str, first: bool) -> None:
        self.at.append(at)
        self.ids.append(ids)
        self.shas.append(_sha(letters))
        self.exact.append(decode(ids.tolist(), self.pieces, first) == letters)
        self.size += len(ids)

    def batch(self, source: pa.RecordBatch) -> pa.RecordBatch:
        take = pa.array(self.at, type=pa.int64())
        ends = np.cumsum([0, *map(len, self.ids)]).astype(np.int32)
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, dtype=np.int32)
        columns = [source.column(c).take(take) for c in self.kept] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32, copy=False))), pa.array(self.shas, type=pa.string()), pa.array(self.exact, type=pa.bool_())]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=[*self.kept, "ids", "letters_sha256", "exact"])


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, chunk, chunks, ids, letters_sha256 and exact (the ids decode to the chunk's letters) of docs (doc_id, text)."""
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = ["doc_id", "chunk", "chunks"]

    @released
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = Encoder(sent.value), _Out(kept, byte_pieces(sent.value))
        for batch in batches:
            texts = batch.column("text")
            for k in range(len(texts)):
                text = texts[k].as_py()
                out.add(k, own.whole(marked(text, True)) if text else np.zeros(0, dtype=np.int32), text, True)
                if out.size >= _IDS:
                    yield out.batch(batch)
            yield out.batch(batch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = max(map(len, sent.value.pieces))
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                n = -(-len(text) // chunk)
                for c in range(n):  # a row of its own for each chunk: no batch holds a document twice
                    part = text[c * chunk : (c + 1) * chunk + reach]
                    fields = [batch.column("row").slice(k, 1), batch.column("doc_id").slice(k, 1), pa.array([c], pa.int64()), pa.array([n], pa.int64()), pa.array([part], pa.string())]
                    yield pa.RecordBatch.from_arrays(fields, names=["row", *kept, "part"])

    def spot(part: str, k: int) -> tuple[str, int, int]:
        """The chunk's marked text, its length and its place: only the first chunk has the leading mark."""
        size = min(chunk, len(part)) + (k == 0)
        return marked(part, k == 0), size, 0 if k == 0 else k * chunk + 1

    @released
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Encoder(sent.value)
        for pdf in batches:
            out = []
            for part, k, n in zip(pdf["part"], pdf["chunk"], pdf["chunks"]):
                text, size, base = spot(part, k)
                out.append(pickle.dumps(own.matrix(text, size, base, k == n - 1)))
            yield pdf[["row", "chunk"]].assign(block=pdf["chunk"] // block, matrix=out)

    def ordered(pdf: pd.DataFrame, by: str) -> tuple[pd.DataFrame, list]:
        pdf = pdf.sort_values(by)
        return pdf, [pickle.loads(m) for m in pdf["matrix"]]

    def blocked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = ordered(pdf, "chunk")
        return pdf[["row", "block"]].iloc[:1].assign(matrix=[pickle.dumps(combined(own))])

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = ordered(pdf, "block")
        path = states(own)
        return pdf[["row", "block"]].assign(enter=path[:-1], leave=path[1:])

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = ordered(pdf, "chunk")
        path = states(own, int(pdf["enter"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pdf[["row", "chunk"]].assign(enter=path[:-1], leave=path[1:])

    @released
    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = Encoder(sent.value), _Out(kept, byte_pieces(sent.value))
        for batch in batches:
            for at, (part, k, enter, leave) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "enter", "leave")))):
                text, size, _ = spot(part, k)
                lead = int(k == 0)
                out.add(at, own.traced(text, size, enter, leave), part[max(0, enter - lead) : size + leave - lead], k == 0)
                if out.size >= _IDS:
                    yield out.batch(batch)
            yield out.batch(batch)

    made = "doc_id long, chunk long, chunks long, ids array<int>, letters_sha256 string, exact boolean"
    zero = F.lit(0).cast("long")
    one = rows.filter(F.length("text") <= chunk).select("doc_id", zero.alias("chunk"), F.lit(1).cast("long").alias("chunks"), "text").mapInArrow(short, made)
    # Chunks are stored with a key of their text's row and go on their own ways from here: a giant document keeps no
    # task to itself.
    parts = rows.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = stored(parts.mapInArrow(cut, "row long, doc_id long, chunk long, chunks long, part string").repartition("row", "chunk"))
    sums = stored(parts.select("row", "chunk", "chunks", "part").mapInPandas(summed, "row long, chunk long, block long, matrix binary"))
    blocks = sums.groupBy("row", "block").applyInPandas(blocked, "row long, block long, matrix binary")
    ends = blocks.groupBy("row").applyInPandas(between, "row long, block long, enter long, leave long")
    path = sums.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(settled, "row long, chunk long, enter long, leave long")
    many = parts.join(path, ["row", "chunk"]).select("doc_id", "chunk", "chunks", "part", "enter", "leave").mapInArrow(traced, made)
    return one.unionByName(many)


def decode(ids: list[int], pieces: list[bytes], first: bool) -> str:
    """The text of a chunk's ids; the first chunk's leading space is taken off."""
    text = b"".join([pieces[i] for i in ids]).decode("utf-8", "surrogatepass")
    return text[1:] if first and text.startswith(" ") else text


def byte_pieces(vocabulary: Vocabulary) -> list[bytes]:
    """The UTF-8 bytes that each id stands for."""
    out = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
    for b, i in enumerate(vocabulary.bytes):
        out[i] = bytes([b])
    return out


def decoded(encoded: DataFrame, vocabulary: Vocabulary, name: str = "text") -> DataFrame:
    """encoded with the text of each row's ids."""
    lean(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(byte_pieces(vocabulary))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pieces = sent.value
        for ids, chunks in batches:
            yield pd.Series([decode(i, pieces, k == 0) for i, k in zip(ids, chunks)], dtype=object)

    return encoded.withColumn(name, text("ids", "chunk"))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Ids of every chunk, and whether their decoding is the chunk's letters again."""
    rows = encode(docs.select("doc_id", "text"), load(model))
    return rows.select("doc_id", "chunk", "chunks", "ids", F.size("ids").alias("n_ids"), "exact")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents."""
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
