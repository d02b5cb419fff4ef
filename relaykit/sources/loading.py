"""Loading tables: incremental reads, upserts, quarantine, partitioned files, completeness, statistics."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def read_incremental(source: DataFrame, state: dict[str, object], columns: Sequence[str] | None = None, batch: int | None = None) -> DataFrame:
    """Rows above the remembered maxima, which are compared as one, in their order; no state, or None in it, reads from the beginning.

    A row with a null among the maxima is never read. ``batch`` bounds one fetch, lowest rows first; it goes on to the
    end of a group of equal maxima, so that the next fetch neither loses nor repeats a row.
    """
    names = list(state)
    rows = source
    for name in names:
        rows = rows.filter(F.col(name).isNotNull())
    if names and all(v is not None for v in state.values()):
        rows = rows.filter(F.struct(*names) > F.struct(*[_literal(v).cast(source.schema[n].dataType).alias(n) for n, v in state.items()]))
    if batch is not None and names:
        last = rows.select(*names).orderBy(*names).limit(batch).agg(F.max(F.struct(*names)).alias("last"))
        found = last.select(*[F.col("last")[n].cast("string").alias(n) for n in names]).first()
        if found[0] is not None:
            rows = rows.filter(F.struct(*names) <= F.struct(*[F.lit(found[n]).cast(source.schema[n].dataType).alias(n) for n in names]))
    return rows.select(*columns) if columns else rows


def _literal(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def newest(rows: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of highest version of each key. A maximum of whole rows, so a hot key is reduced before it is shuffled."""
    value = F.struct(F.col(version).alias("_version"), *[F.col(c) for c in rows.columns])
    best = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(F.max(value).alias("row"))
    return best.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns])


def upsert(target: DataFrame, changes: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """``target`` after inserting or replacing by key; a higher version wins, so stale and repeated changes do nothing.

    Columns that the target lacks are ignored; those that ``changes`` lacks keep the stored values, and are null for
    new keys. Both are warned of. The target has one row a key. To change a stored table in place, see ``StoredTable``.
    """
    ignored, absent = [c for c in changes.columns if c not in target.columns], [c for c in target.columns if c not in changes.columns]
    if ignored or absent:
        warnings.warn(f"columns of changes only: {ignored}; of the table only: {absent}", stacklevel=2)
    given = [c for c in target.columns if c not in absent]
    typed = changes.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in given])
    stored = target.select(F.struct(*target.columns).alias("old"), F.lit(None).cast(typed.schema).alias("change"))
    incoming = newest(typed, key, version).select(F.lit(None).cast(stored.schema["old"].dataType).alias("old"), F.struct(*given).alias("change"))
    both = stored.union(incoming)
    keys = [F.coalesce(F.col("old")[k], F.col("change")[k]).alias(f"_key_{k}") for k in key]
    pairs = both.groupBy(*keys).agg(F.first("old", ignorenulls=True).alias("old"), F.first("change", ignorenulls=True).alias("change"))
    old, change = F.col("old")[version], F.col("change")[version]
    newer = F.col("change").isNotNull() & (F.col("old").isNull() | F.coalesce(change > old, old.isNull() & change.isNotNull()))
    return pairs.select(*[F.when(newer, F.col("change")[c]).otherwise(F.col("old")[c]).alias(c) if c in given else F.col("old")[c].alias(c) for c in target.columns])


def quarantine(rows: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all checks (a reason and the SQL condition to keep), and the others with ``reason`` and ``row`` (JSON).

    A condition that is null counts as broken. The first broken check is the reason.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in checks.items()])
    marked = rows.withColumn("_reason", reason)
    bad = marked.filter("_reason is not null").select(F.col("_reason").alias("reason"), F.to_json(F.struct(*rows.columns)).alias("row"))
    return marked.filter("_reason is null").drop("_reason"), bad


def quarantine_to(rows: DataFrame, checks: dict[str, str], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Like ``quarantine``, with both sets written under ``path`` by one pass over ``rows``; also the counts of that pass.

    Counts: ``good``, and the rows of each reason. ``path`` must not exist.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in checks.items()])
    seen = Observation(f"quarantine-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col("_reason").isNull()).alias("good"), *[F.count_if(F.col("_reason") == name).alias(f"reason {i}") for i, name in enumerate(checks)]]
    marked = rows.withColumn("_reason", reason).observe(seen, *counts)
    marked.withColumn("_bad", F.col("_reason").isNotNull()).write.partitionBy("_bad").parquet(path)
    found = seen.get
    stored = rows.sparkSession.read.schema(marked.schema.add("_bad", "boolean")).parquet(path)
    good = stored.filter("not _bad").select(*rows.columns)
    bad = stored.filter("_bad").select(F.col("_reason").alias("reason"), F.to_json(F.struct(*rows.columns)).alias("row"))
    return good, bad, {"good": found["good"], **{name: found[f"reason {i}"] for i, name in enumerate(checks)}}


def repair_epoch_millis(value: Column) -> Column:
    """Timestamp from text that holds either milliseconds since 1970 or a written time; else null."""
    written = F.expr("null") if value is None else value.try_cast("timestamp")
    return F.when(F.rlike(value, F.lit(r"^-?[0-9]{10,16}$")), F.timestamp_millis(value.try_cast("bigint"))).otherwise(written)


def range_folder(number: Column, total: Column | int, width: int = 100) -> Column:
    """Folder of a numbered partition: the upper bound of its range, but no more than the total."""
    upper = F.ceil(number / width) * width
    return F.least(upper, F.lit(total) if isinstance(total, int) else total).cast("bigint")


def export_csv(df: DataFrame, path: str, folder: Column, if_absent: bool = False) -> None:
    """Gzip CSV in one folder per value of ``folder``; with ``if_absent`` an existing export stays as it is."""
    parts = df.withColumn("folder", folder).repartition("folder", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    parts.write.partitionBy("folder").mode("ignore" if if_absent else "overwrite").option("compression", "gzip").option("header", True).csv(path)


def export_csv_parts(df: DataFrame, path: str, folder: Column) -> list[str]:
    """Like ``export_csv``, but folder by folder: what is there stays as it is, and only missing folders are written.

    Returns the folders written. They must be few, as the names of partitions are.
    """
    spark = df.sparkSession
    marked = df.withColumn("folder", folder)
    wanted = [r["folder"] for r in marked.select(F.col("folder").cast("string")).distinct().collect()]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in files.listStatus(root)} if files.exists(root) else set()
    missing = sorted(w for w in wanted if f"folder={w}" not in there)
    if missing:
        rows = marked.filter(F.col("folder").cast("string").isin(missing)).repartition("folder", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
        rows.write.partitionBy("folder").mode("append").option("compression", "gzip").option("header", True).csv(path)
    return missing


def import_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def replace_tables(tables: dict[str, DataFrame], parents: dict[str, Sequence[str]], write: Callable[[str, DataFrame], None]) -> list[str]:
    """Writes every table after the tables it refers to; returns the order. A cycle raises ValueError."""
    done: list[str] = []
    while len(done) < len(tables):
        ready = [t for t in tables if t not in done and all(p in done or p not in tables or p == t for p in parents.get(t, ()))]
        if not ready:
            raise ValueError("tables refer to each other in a cycle")
        for name in ready:
            write(name, tables[name])
            done.append(name)
    return done


def missing_parts(expected: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected parts that are not there: a load starts only when this is empty."""
    return expected.join(found.select(*key), list(key), "left_anti")


def table_statistics(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """``column_name, n_rows, n_nulls, n_distinct, low, high`` of each column, from one aggregation."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    each = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"),
            distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"),
        )
        for c in columns
    ]
    return df.agg(F.array(*each).alias("all")).select(F.inline("all"))


def json_parameters(text: Column, paths: dict[str, str]) -> list[Column]:
    """One column per parameter: the text at its JSON path, empty where the path is absent."""
    doc = F.try_parse_json(text)
    return [F.coalesce(F.try_variant_get(doc, F.lit(path), "string"), F.lit("")).alias(name) for name, path in paths.items()]


def apply_changes(target: DataFrame, changes: DataFrame, key: Sequence[str], position: str, op: str) -> DataFrame:
    """``target`` after change events (``op``: insert, update, delete), of which the last by position counts for each key."""
    last = newest(changes, key, position)
    kept = target.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last.filter(F.col(op) != "delete").select(*target.columns))
