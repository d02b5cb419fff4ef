"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the text contracts: runs without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may lack it (tests) and gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="relaykit-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run here leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder and cut from its lineage. Its shuffle files go at once."""
    shared_folder(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder: smaller than a checkpoint where rows are many."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that hold about ``size`` bytes of a text column; a longer text makes a run alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for row, length in enumerate(lengths.tolist()):
        if row > at and total + length > size:
            yield batch.slice(at, row - at)
            at, total = row, 0
        total += length
    if at < batch.num_rows:
        yield batch.slice(at)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Counted without an array: each word shrinks to one character."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "a")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")
