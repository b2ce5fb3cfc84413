"""Tables in, and tables staged in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What op3, op4 and op8 call a word.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch on its way to Python and back, unless the session has a size of its own. Rows of long texts make
#: the default of 64 MB; a task holds a few of them in the JVM and in Python each. It is the session's setting that is lowered.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder. One of this machine's where none is set, in local mode only."""
    _small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: stored tables need a folder that driver and executors share")
        base = kept or tempfile.mkdtemp(prefix="sedimenta-")
        if not kept:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sedimenta-{uuid.uuid4().hex}"


#: Shuffle files of a write that has ended are of no use any more; without this they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, *parts: str) -> DataFrame:
    """df, written to the shared folder and read again: later reads neither recompute it nor need the executor that made it.

    parts are columns of few values whose rows are stored apart.
    """
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    kept = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    finally:
        conf.set(_CLEAN, kept)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what staged wrote for df, which nothing reads any more. Other tables are left alone."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def row_id() -> tuple[Column, Column]:
    """_r1 and _r2: 128 bits of a row's doc_id and text. Rows alike in both have the same."""
    return tuple(F.xxhash64(F.lit(salt), "doc_id", "text").alias(name) for name, salt in (("_r1", "row"), ("_r2", "and row")))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or none."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), WORD_SEPARATORS, " " * len(WORD_SEPARATORS)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def n_words_of(text: Column) -> Column:
    """The number of words, counted without making them: each word and the separators around it become one character."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.length(F.translate(marks, WORD_SEPARATORS, "")).cast("long")  # a text without words is left as it was


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds
