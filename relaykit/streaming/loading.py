"""Streams into stored tables, and repeated fetches of what is new."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaykit.sources.loading import read_incremental
from relaykit.sources.tables import StoredTable


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, file_format: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(file_format)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def _into(rows: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], object], every: str | None, mode: str = "append") -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: apply(batch, number) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_stream(changes: DataFrame, table: StoredTable, name: str, checkpoint: str, position: Sequence[str] = (), every: str | None = None) -> StreamingQuery:
    """Each micro-batch upserted by key: the newest version wins, replays and stale rows do nothing.

    The batch number is committed with the data under ``name``. A crash between that commit and the stream's own
    leads to a replay, which is left out. To load anew, use a new checkpoint and ``table.forget(name)``. ``every`` is the
    polling interval; without it the stream ends when all that is there has been read.
    """
    return _into(changes, checkpoint, lambda batch, number: table.upsert(batch, name, number, position), every)


def change_stream(events: DataFrame, table: StoredTable, op: str, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Change events (insert, update, delete) applied by position, which is the table's order; resumes like ``upsert_stream``."""
    return _into(events, checkpoint, lambda batch, number: table.apply_events(batch, op, name, number, [table.version().order]), every)


def summary_stream(rows: DataFrame, table: StoredTable, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Changed groups of a streaming aggregation, upserted by their key; ``rows`` must hold the table's order column."""
    return _into(rows, checkpoint, lambda batch, number: table.upsert(batch, name, number), every, "update")


def fetch_new(source: DataFrame, table: StoredTable, name: str, maxima: Sequence[str], columns: Sequence[str] | None = None, batch: int | None = 1000) -> int:
    """One fetch of rows above the remembered maxima into ``table``; returns how many there were.

    The maxima are part of the version that the rows are committed with, so a fetch that fails leaves both as they were.
    A fetch ends with a whole group of equal maxima. A row with a null among them is never fetched.
    """
    done = table.progress(name)
    seen = done.position if done and done.position else [None] * len(maxima)
    state = {c: None if text is None else F.lit(text).cast(source.schema[c].dataType) for c, text in zip(maxima, seen)}
    rows = read_incremental(source, state, None, batch)
    chosen = rows if columns is None else rows.select(*dict.fromkeys([*columns, *maxima]))
    table.upsert(chosen, name, done.batch + 1 if done else 0, maxima)
    return table.progress(name).n_rows - (done.n_rows if done else 0)


def fetch_all(source: DataFrame, table: StoredTable, name: str, maxima: Sequence[str], columns: Sequence[str] | None = None, batch: int | None = 1000) -> int:
    """Fetches until nothing is new; returns the number of fetches that found rows."""
    n = 0
    while fetch_new(source, table, name, maxima, columns, batch):
        n += 1
    return n
