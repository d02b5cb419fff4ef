"""Time series and monitoring: matrices to long and wide tables, regular grids, alerts, rate caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaykit.operators.skew import carry_forward

MATRIX = "struct<data: struct<result: array<struct<metric: map<string,string>, `values`: array<array<string>>>>>>"
# Labels that name the series rather than describe it.
NAMING_LABELS = ("__name__", "job", "instance", "server")


def matrix_to_long(responses: DataFrame, text: str = "response") -> DataFrame:
    """``metric, job, labels, ts, value`` of every point of range-query responses (JSON text)."""
    series = responses.select(F.from_json(text, MATRIX).alias("r")).select(F.inline("r.data.result"))
    # What names a series stands in columns of its own beside ``values``: a point that carried its series would copy all points of it.
    named = series.select(
        F.col("metric")["__name__"].alias("metric"), F.col("metric")["job"].alias("job"),
        F.map_filter("metric", lambda k, v: ~k.isin(*NAMING_LABELS)).alias("labels"), "values",
    )
    points = named.select("metric", "job", "labels", F.explode("values").alias("p"))
    return points.select(
        "metric", "job", "labels", F.timestamp_seconds(F.col("p")[0].cast("bigint")).alias("ts"), F.col("p")[1].try_cast("double").alias("value")
    )


def number_series(series: DataFrame, labels: str = "label_key") -> DataFrame:
    """Adds ``series_no`` in (metric, job) by labels, and ``field``; the first series of a metric is marked ``$``.

    Numbers are given among distinct series, not among points.
    """
    distinct = series.select("metric", "job", labels).distinct()
    nth = F.row_number().over(Window.partitionBy("metric", "job").orderBy(labels))
    first = F.row_number().over(Window.partitionBy("metric").orderBy("job", labels)) == 1
    named = distinct.withColumn("series_no", nth).withColumn(
        "field", F.concat("metric", F.lit("_"), "job", F.lit("_"), F.col("series_no").cast("string"), F.when(first, "$").otherwise(""))
    )
    return series.join(named, ["metric", "job", labels])


def long_to_wide(long: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per time, one column per field of the given list; a missing point is null."""
    return long.groupBy("ts").pivot("field", list(fields)).agg(F.max("value"))


def label_columns(long: DataFrame, labels: Sequence[str], **constants: object) -> DataFrame:
    """Labels as columns beside each point, and the same constants on every row."""
    columns = {name: F.col("labels")[name] for name in labels} | {name: F.lit(value) for name, value in constants.items()}
    return long.withColumns(columns).drop("labels")


def regular_grid(points: DataFrame, keys: Sequence[str], start: str, end: str, seconds: int = 15, day: int = 86_400) -> DataFrame:
    """A row for every step from ``start`` to ``end`` and series, with the last value at or before it.

    Points: keys, ``ts``, ``value``. Of several points in a step the last counts.
    """
    step = lambda c: (F.floor(F.unix_timestamp(c) / seconds) * seconds).cast("bigint")
    bounds = [step(F.lit(b).cast("timestamp")) for b in (start, end)]
    seen = points.withColumn("at", step("ts")).groupBy(*keys, "at").agg(F.max_by("value", "ts").alias("value"))
    steps = points.select(*keys).distinct().withColumn("at", F.explode(F.sequence(bounds[0], bounds[1], F.lit(seconds).cast("bigint"))))
    inside = seen.filter((F.col("at") >= bounds[0]) & (F.col("at") <= bounds[1]))
    joined = steps.join(inside, [*keys, "at"], "left").withColumn("_day", F.floor(F.col("at") / day))
    filled = carry_forward(joined, list(keys), "at", "value", "_day", "filled")
    return filled.select(*keys, F.timestamp_seconds("at").alias("ts"), F.col("filled").alias("value"))


def slow_records(records: DataFrame, start: str, end: str, millis: int = 50) -> DataFrame:
    """Records that took longer than the threshold; works on batches and streams alike."""
    return records.withColumn("millis", F.col(end) - F.col(start)).filter(F.col("millis") > millis)


def back_pressure(status: DataFrame) -> DataFrame:
    text = F.format_string("%s: %s to %s holds %d", "actorHostname", "sourceName", "destinationName", "queuedCount")
    return status.filter("isBackPressureEnabled").withColumn("message", text)


def nodes_down(clusters: DataFrame) -> DataFrame:
    return clusters.filter(F.col("connectedNodeCount") != F.col("totalNodeCount"))


def bulletins(records: DataFrame, content: str = "content") -> DataFrame:
    """Records whose content holds ERROR or WARNING, with level, message and time taken from their JSON."""
    doc = F.try_parse_json(F.col(content))
    fields = [F.try_variant_get(doc, F.lit(f"$.{name}"), "string").alias(name) for name in ("bulletinLevel", "bulletinMessage", "bulletinTimestamp")]
    hit = F.contains(F.col(content), F.lit("ERROR")) | F.contains(F.col(content), F.lit("WARNING"))
    return records.filter(hit).select(*[c for c in records.columns if c != content], *fields)


def split_records(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per record of a JSON array (or the single object), with its position."""
    doc = F.try_parse_json(F.col(text))
    many = F.coalesce(F.try_variant_get(doc, F.lit("$"), "array<variant>"), F.array(doc))
    return df.select(*keep, F.posexplode(many).alias("position", "record")).withColumn("record", F.to_json("record"))


def rate_cap(events: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "event_id", seconds: int = 10) -> DataFrame:
    """The first event of each key and window."""
    windowed = events.withColumn("_window", F.floor(F.unix_timestamp(ts) / seconds))
    row = F.min(F.struct(F.col(ts), F.col(order), *[F.col(c).alias(f"_{c}") for c in events.columns])).alias("row")
    kept = windowed.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys], "_window").agg(row)
    return kept.select(*[F.col(f"row._{c}").alias(c) for c in events.columns])


def map_to_rows(df: DataFrame, keep: Sequence[str], column: Column, key: str, value: str) -> DataFrame:
    return df.select(*keep, F.explode(column).alias(key, value))


def list_to_rows(df: DataFrame, keep: Sequence[str], column: str, name: str, separator: str = ",") -> DataFrame:
    """One row per part of a list text; ``item`` is the name with the part's number."""
    parts = df.select(*keep, name, F.posexplode(F.split(column, separator)).alias("n", "value"))
    return parts.withColumn("item", F.concat_ws("-", name, "n")).drop("n")


def rows_to_list(df: DataFrame, keys: Sequence[str], value: str, separator: str = ",") -> DataFrame:
    """Distinct values of each key as one sorted list text. A list must fit into a row."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), separator).alias("list"))


def select_instances(df: DataFrame, keep: Sequence[str], instances: str, names: Column) -> DataFrame:
    """Of a map of instance name to address, those in ``names`` that have an address, as one map in order of names; rows without any are left out."""
    chosen = F.array_sort(F.map_entries(F.map_filter(instances, lambda k, v: F.array_contains(names, k) & v.isNotNull())))
    return df.select(*keep, F.map_from_entries(chosen).alias(instances)).filter(F.size(instances) > 0)
