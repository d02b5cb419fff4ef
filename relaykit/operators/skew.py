"""Ways to keep one hot key from landing whole in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def number_in_group(
    df: DataFrame, keys: Sequence[str], order: str, width: int = 1_000_000, name: str = "position"
) -> DataFrame:
    """1-based position of each row in its group, in order of ``order``, a whole number unique in the group.

    The group is cut into ranges of ``order`` that hold at most ``width`` rows each. Rows are numbered
    within a range and lifted by the sizes of the earlier ranges, so a hot group is many small windows.
    """
    keys = list(keys)
    cut = df.withColumn("_range", F.floor(F.col(order) / width))
    by_range = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(by_range), F.lit(0)).alias("_before"))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        _join_null_safe(cut, before, [*keys, "_range"])
        .withColumn(name, F.col("_before") + F.row_number().over(in_range))
        .drop("_range", "_before")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str, block: str, name: str = "filled"
) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group; ``block`` is a coarser step of ``order``.

    Within a block it is a bounded window. The value that enters a block is carried over one row per block.
    """
    keys = list(keys)
    upto = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    entering = (
        df.groupBy(*keys, block)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
        .select(*keys, block, F.last("_last", ignorenulls=True).over(earlier).alias("_entering"))
    )
    return (
        _join_null_safe(df, entering, [*keys, block])
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(upto), F.col("_entering")))
        .drop("_entering")
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a null key equals a null key; the keys stay once."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])
