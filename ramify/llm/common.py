"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch between Spark and a Python worker: texts are long, and a batch is held several times.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the one its context was given.

    Where there is none, a session on one machine (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ramify-"))
        found = context.getCheckpointDir()
    return found


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, where it has Spark's own sizes; sizes that a user chose stay.

    Called where an operator begins, it also removes what earlier ones have stored and nobody holds.
    """
    swept(spark)
    for key, usual, value in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def released(work):
    """A function over batches that gives its worker's free memory back at its end: workers are used again by later stages."""

    @functools.wraps(work)
    def whole(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return whole


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Tables in the shared folder: their paths, and weak references to the file lists that every plan over them holds.
_tables: dict[str, tuple] = {}


def swept(spark: SparkSession) -> None:
    """Removes stored tables that no plan refers to any more, as Spark does with checkpoints."""
    context = spark.sparkContext
    gc.collect()
    for path, (held, owner) in list(_tables.items()):
        if owner is not context:
            del _tables[path]
        elif held.get() is None:
            del _tables[path]
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, for what is read again by column.

    It goes once no plan refers to it (at the next table's turn), or when the driver ends.
    """
    swept(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    context = df.sparkSession.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(own)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _tables[path] = context._jvm.java.lang.ref.WeakReference(files), context
    return out


def packed(docs: DataFrame) -> DataFrame:
    """The rows of docs as one struct column `row`: names that an operator adds beside it clash with none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The columns of the struct `row`; those of `more` replace or follow them."""
    own = [more.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return rows.select(*own, *[v.alias(k) for k, v in more.items() if k not in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32 of the id as text leaves 2 modulo 4 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
