"""Alerts from streams: rules write what they find, and a cap lets one record through in a while.

The rules themselves (slow records, back pressure, nodes down, bulletins) are in ``operators.series``; they are filters and
take streams as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_alerts(found: DataFrame, name: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends the records of a rule, with its name as ``alert``, to a folder of that name; each record once, also after a restart."""
    writer = found.withColumn("alert", F.lit(name)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", f"{path}/{name}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _first(events: DataFrame, keys: Sequence[str], ts: str, order: str, seconds: int, lateness: str) -> DataFrame:
    window = F.window(ts, f"{seconds} seconds")
    rank = F.struct(F.col(ts), F.col(order))
    return events.withWatermark(ts, lateness).groupBy(window.alias("window"), *keys).agg(
        F.min_by(F.struct(*[c for c in events.columns if c not in keys]), rank).alias("first"), F.count(F.lit(1)).alias("n_events")
    )


def _named(events: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"first.`{c}`").alias(c) if c not in keys else F.col(c) for c in events.columns]


def rate_cap(events: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "event_id", seconds: int = 10, lateness: str = "1 minute") -> DataFrame:
    """The first event (by time, then ``order``) of each key and window, given out once the watermark has passed the window.

    Events may come in any order within ``lateness``; later ones are dropped. The state is one event for each key and
    open window. On a batch it gives the same rows.
    """
    return _first(events, keys, ts, order, seconds, lateness).select(*_named(events, keys))


def rate_cap_updates(events: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "event_id", seconds: int = 10, lateness: str = "1 minute") -> DataFrame:
    """Like ``rate_cap``, but each window is given out whenever its first event may have changed.

    With ``window_start`` and ``version`` (the events seen so far) for an upsert by key and window.
    """
    return _first(events, keys, ts, order, seconds, lateness).select(*_named(events, keys), F.col("window.start").alias("window_start"), F.col("n_events").alias("version"))
