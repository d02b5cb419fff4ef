"""Checks and consequences of keys: orphans, duplicates, constraints, cascading deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, columns: Sequence[str], parent_columns: Sequence[str]) -> DataFrame:
    """Child rows whose whole key is set and names no parent."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)])
    return child.dropna(subset=list(columns)).join(keys, list(columns), "left_anti")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys held by several rows, with their number; as in a unique index, a key with a null never collides."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def violations(df: DataFrame, rules: dict[str, str], key: Sequence[str]) -> DataFrame:
    """``key`` and ``rule``, one row for each rule (a name and an SQL condition) that a row breaks.

    A condition that is null counts as kept, as in a database.
    """
    broken = F.array(*[F.when(~F.expr(sql), F.lit(name)) for name, sql in rules.items()])
    return df.select(*key, F.explode(F.array_compact(broken)).alias("rule"))


def delete_cascading(
    tables: dict[str, DataFrame], links: Sequence[tuple[str, Sequence[str], str, Sequence[str]]], table: str, victims: DataFrame, key: Sequence[str]
) -> dict[str, DataFrame]:
    """The tables without the victims (keys of ``table``) and whatever hangs below them.

    ``links``: child, its columns, parent, its columns, parents before children.
    """
    gone = {table: tables[table].join(victims, list(key), "left_semi")}
    out = dict(tables) | {table: tables[table].join(victims, list(key), "left_anti")}
    for child, columns, parent, parent_columns in links:
        if parent in gone:
            keys = gone[parent].select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)])
            gone[child] = out[child].join(keys, list(columns), "left_semi")
            out[child] = out[child].join(keys, list(columns), "left_anti")
    return out
