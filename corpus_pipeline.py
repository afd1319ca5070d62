"""The corpus pipeline: stages over documents, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage takes all rows that the one before kept; all but the last return the columns of documents.
Documents that score as toxic go; repeated chunks of lines go, and with them documents that consist of
nothing else; of each group of near copies the first stays; sources are brought to their target weights
by taking rows up to three times, cut where a block of words ends; what is left is encoded.

Every stage treats rows, not ids: rows that share a doc_id, or have none, are documents of their own. Null texts count as
empty; an empty table gives an empty table; columns beside those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ramify.llm import lines, minhash, mixing, sentencepiece, toxicity
from ramify.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold stay. A null or empty text scores the share of toxic labels alone, so it stays
    where toxic documents are the exception; ties of score and threshold go; without usable labels every row stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two or more lines that stand in an earlier row (by doc_id, nulls last, then by the text's hash) or earlier in
    the row go. Rows that lose every line go; null, empty and one-line texts lose nothing and stay."""
    return lines.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal or near (also by a chain of near ones) the one with the smallest doc_id stays, null
    first, then the one whose text has the smallest hash; texts without a word are like none and stay."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last time cut to the words that are left; rows that it takes no word of,
    those without a word among them, go. A null source is a source of its own."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of ids for every chunk of every row; a null or empty text has one without ids."""
    return sentencepiece.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: A fitted classifier, consistent samples and a max-plus scan are beyond SQL. tests/llm holds the stages' operators against
#: brute force and every stage against the cases of its docstring.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is stored for the next, so that none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
