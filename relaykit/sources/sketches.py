"""Statistics of large tables from sketches that are kept for each part and merged.

A part (a file, a day) is read once; its counts, bounds and sketches are one row. Statistics of the whole are a merge of
these rows, so a table that grows is read only where it is new. Distinct values come from HyperLogLog (relative error
about 1.04 / sqrt(2^``lg``), 1.6 % by default), quantiles of numbers from KLL (rank error about 1 % with ``k`` = 400), and
frequent values from a frequent-items sketch (exact up to its number of tracked values).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, NumericType, StringType

from relaykit.sources.tables import StoredTable

LG, K, TRACKED = 12, 400, 1000


def _hashed(c: str, kind: DataType) -> Column:
    return F.col(f"`{c}`") if isinstance(kind, (StringType, LongType, BinaryType)) else F.col(f"`{c}`").cast("string")


def part_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row for each value of ``by``: ``n_rows``, and a struct for each column with its counts, bounds and sketches."""
    kinds = {c: df.schema[c].dataType for c in columns}

    def one(c: str) -> Column:
        numbers = F.col(f"`{c}`").cast("double") if isinstance(kinds[c], NumericType) else F.lit(None).cast("double")
        return F.struct(
            F.count_if(F.col(f"`{c}`").isNull()).alias("n_nulls"), F.min(f"`{c}`").alias("low"), F.max(f"`{c}`").alias("high"),
            F.hll_sketch_agg(_hashed(c, kinds[c]), F.lit(LG)).alias("distinct"), F.kll_sketch_agg_double(numbers, F.lit(K)).alias("numbers"),
            F.expr(f"approx_top_k_accumulate(cast(`{c}` as string), {TRACKED})").alias("frequent"),
        ).alias(c)

    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[one(c) for c in columns])


def merged_statistics(parts: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75), frequent: int = 5) -> DataFrame:
    """``column_name, n_rows, n_nulls, low, high, n_distinct, quantiles, frequent`` of all parts together.

    ``n_distinct`` is estimated, ``quantiles`` (null for what is no number) and ``frequent`` (value and count) as well;
    the rest is exact. Without parts there is one row a column, with zeros and nulls.
    """
    sums = [F.sum("n_rows").alias("n_rows")]
    for c in columns:
        f = lambda name, c=c: F.col(f"`{c}`.{name}")
        sums.append(F.struct(
            F.sum(f("n_nulls")).alias("n_nulls"), F.min(f("low")).cast("string").alias("low"), F.max(f("high")).cast("string").alias("high"),
            F.hll_union_agg(f("distinct")).alias("distinct"), F.kll_merge_agg_double(f("numbers")).alias("numbers"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(`{c}`.frequent), {frequent + 1})").alias("frequent"),
        ).alias(c))
    # Merging the sketches of no parts fails: they are grouped, and a row without parts is put in.
    merged = parts.withColumn("_one", F.lit(1)).groupBy("_one").agg(*sums)
    whole = parts.sparkSession.range(1).select(F.lit(1).alias("_one")).join(merged, "_one", "left")
    known = lambda c: F.col(f"`{c}`.numbers").isNotNull() & (F.kll_sketch_get_n_double(F.col(f"`{c}`.numbers")) > 0)
    each = [
        F.struct(
            F.lit(c).alias("column_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col(f"`{c}`.n_nulls"), F.lit(0)).alias("n_nulls"),
            F.col(f"`{c}`.low").alias("low"), F.col(f"`{c}`.high").alias("high"), F.coalesce(F.hll_sketch_estimate(F.col(f"`{c}`.distinct")), F.lit(0)).alias("n_distinct"),
            F.when(known(c), F.array(*[F.kll_sketch_get_quantile_double(F.col(f"`{c}`.numbers"), F.lit(float(q))) for q in quantiles])).alias("quantiles"),
            F.coalesce(F.filter(F.col(f"`{c}`.frequent"), lambda x: x["item"].isNotNull()), F.array().cast("array<struct<item: string, count: bigint>>")).alias("frequent"),
        )
        for c in columns
    ]
    rows = whole.select(F.inline(F.array(*each)))
    return rows.withColumn("frequent", F.slice("frequent", 1, frequent))


def exact_quantiles(df: DataFrame, column: str, quantiles: Sequence[float], accuracy: int = 10_000) -> list[float] | None:
    """What ``percentile`` gives for a number column, without its buffers: these hold every distinct value in one task.

    Approximate quantiles on both sides of each rank bound the values that may stand there; only these are sorted, about
    ``6 / accuracy`` of the rows and what equals them, counted by value. None without values.
    """
    value = F.col(f"`{column}`")
    rows = df.select(value.alias("v")).filter("v is not null")
    n = rows.count()
    if not n:
        return None
    margin = 3 / accuracy + 2 / n
    ends = [min(max(q + sign * margin, 0.0), 1.0) for q in quantiles for sign in (-1, 1)]
    bounds = rows.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
    out = []
    for q, low, high in zip(quantiles, bounds[::2], bounds[1::2]):
        inside = rows.filter(F.col("v").between(F.lit(low), F.lit(high))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        upto = inside.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        at = q * (n - 1) - rows.filter(F.col("v") < F.lit(low)).count()
        first, last = math.floor(at), math.ceil(at)
        a, b = upto.agg(F.min(F.when(F.col("upto") > first, F.col("v"))), F.min(F.when(F.col("upto") > last, F.col("v")))).first()
        out.append(float(a) if first == last or a == b else (last - at) * a + (at - first) * b)
    return out


class FileStatistics:
    """Statistics of the files under a path; a file that was read is never read again."""

    def __init__(self, spark: SparkSession, path: str, store: str, columns: Sequence[str], file_format: str = "parquet"):
        self.spark, self.path, self.columns, self.format = spark, path, list(columns), file_format
        self.table = StoredTable(spark, store)

    def _files(self) -> DataFrame:
        return self.spark.read.format(self.format).load(self.path)

    def refresh(self) -> int:
        """Reads the files that have no sketch yet; returns their number. Files must not change once written."""
        found = self._files()
        names = self.spark.createDataFrame([(f,) for f in found.inputFiles()], "file string")
        try:
            new = [r["file"] for r in names.join(self.table.read().select("file"), "file", "left_anti").collect()]
        except ValueError:
            new = [r["file"] for r in names.collect()]
        if not new:
            return 0
        rows = self.spark.read.schema(found.schema).format(self.format).load(new)
        parts = part_sketches(rows.select(F.input_file_name().alias("file"), *[F.col(f"`{c}`") for c in self.columns]), self.columns, ["file"]).withColumn("version", F.lit(1))
        try:
            self.table.version()
        except ValueError:
            self.table = StoredTable.create(self.spark, self.table.path, parts.schema, ["file"], "version", buckets=8)
        self.table.upsert(parts)
        return len(new)

    def statistics(self, **how) -> DataFrame:
        return merged_statistics(self.table.read(), self.columns, **how)
