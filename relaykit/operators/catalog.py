"""Source catalogs to target tables: names, types, DDL; and the differences between two catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StringType

from relaykit.functions.naming import identifier
from relaykit.functions.sqltypes import source_type


def add_target_names(catalog: DataFrame) -> DataFrame:
    """Adds ``target_name``: the normalised name, the n-th use of one in a table with the suffix ``_n``.

    Rows: ``table_name, column_name, ordinal_position``. A suffixed name that another column has by itself gets
    a further number behind the highest one used, so names never collide.
    """
    plain = catalog.withColumn("_plain", identifier(F.col("column_name")))
    nth = Window.partitionBy("table_name", "_plain").orderBy("ordinal_position", "column_name")
    numbered = plain.withColumn("_n", F.row_number().over(nth))
    made = F.when(F.col("_n") == 1, F.col("_plain")).otherwise(F.concat_ws("_", "_plain", "_n"))
    named = numbered.withColumn("target_name", made)
    same = Window.partitionBy("table_name", "target_name")
    first = same.orderBy("_n", "ordinal_position")
    again = F.row_number().over(first)
    clash = F.when(again > 1, F.concat_ws("_", "target_name", F.lit("x"), "ordinal_position")).otherwise(F.col("target_name"))
    return named.withColumn("target_name", clash).drop("_plain", "_n")


def add_target_types(catalog: DataFrame) -> DataFrame:
    """Adds ``target_type`` from ``data_type``, ``numeric_precision`` and ``numeric_scale``."""
    return catalog.withColumn(
        "target_type", source_type(F.col("data_type"), F.col("numeric_precision"), F.col("numeric_scale"))
    )


def table_ddl(catalog: DataFrame) -> DataFrame:
    """``table_name, ddl``: one CREATE TABLE text per table; columns by ordinal position. A table's columns are few."""
    line = F.concat(F.lit("  "), "target_name", F.lit(" "), "target_type", F.when(F.col("is_nullable") == "NO", " NOT NULL").otherwise(""))
    rows = catalog.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal_position", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), ",\n")
    name = identifier(F.col("table_name"))
    return rows.select("table_name", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), name, F.lit(" (\n"), body, F.lit("\n);")).alias("ddl"))


def schema_diff(current: DataFrame, target: DataFrame) -> DataFrame:
    """``table_name, column_name, action``: add, keep, widen, conflict or extra.

    Both sides: ``table_name, column_name, kind, size, scale`` (``size`` is a length or precision).
    """
    keys = ["table_name", "column_name"]
    old = current.select(*keys, F.struct("kind", "size", "scale").alias("old"))
    new = target.select(*keys, F.struct("kind", "size", "scale").alias("new"))
    wider = (F.coalesce(F.col("new.size"), F.lit(0)) > F.coalesce(F.col("old.size"), F.lit(0))) | (
        F.coalesce(F.col("new.scale"), F.lit(0)) > F.coalesce(F.col("old.scale"), F.lit(0))
    )
    action = (
        F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "extra").when(F.col("old.kind") != F.col("new.kind"), "conflict")
        .when(wider, "widen").otherwise("keep")
    )
    return old.join(new, keys, "full").select(*keys, action.alias("action"))


def schema_rows(df: DataFrame, table_name: str) -> DataFrame:
    """The columns of a table as ``schema_diff`` takes them; a string's size is its declared ``length`` (field metadata)."""
    rows = []
    for f in df.schema.fields:
        size, scale = (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, DecimalType) else (f.metadata.get("length"), None)
        rows.append((table_name, f.name, f.dataType.typeName(), size, scale))
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, kind string, size int, scale int")


def evolution_report(current: DataFrame, incoming: DataFrame, table_name: str) -> DataFrame:
    """What each column would need (mode ``generate_only``): ``table_name, column_name, action, current_type, incoming_type``. Nothing is changed."""
    old, new = schema_rows(current, table_name), schema_rows(incoming, table_name)
    size = F.when(F.col("size").isNotNull(), F.concat(F.lit("("), F.concat_ws(",", F.col("size").cast("string"), F.col("scale").cast("string")), F.lit(")"))).otherwise("")
    types = lambda rows, name: rows.select("table_name", "column_name", F.concat("kind", size).alias(name))
    keys = ["table_name", "column_name"]
    return schema_diff(old, new).join(types(old, "current_type"), keys, "left").join(types(new, "incoming_type"), keys, "left")


def evolution_conflicts(current: DataFrame, incoming: DataFrame, key: list[str], mode: str = "apply_new_only") -> DataFrame:
    """Values of ``incoming`` that the evolved types do not hold as they are: ``key, column_name, value``.

    ``evolve`` gives null for what cannot be cast, and rounds decimals; a text longer than its column is kept.
    """
    after = evolved_types(current, incoming, mode)
    found = []
    for f in incoming.schema.fields:
        kind, length = after[f.name]
        value = F.col(f"`{f.name}`")
        lost = F.lit(False)
        if kind != f.dataType:
            cast = value.try_cast(kind)
            lost = value.isNotNull() & (cast.isNull() | (cast.cast("string") != value.cast("string") if isinstance(kind, DecimalType) and not isinstance(f.dataType, DecimalType) else cast.try_cast(f.dataType) != value))
        if length is not None:
            lost = lost | F.coalesce(F.char_length(value) > length, F.lit(False))
        found.append(F.when(lost, F.struct(F.lit(f.name).alias("column_name"), value.cast("string").alias("value"))))
    return incoming.select(*key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*key, "f.*")


def evolved_types(current: DataFrame, incoming: DataFrame, mode: str) -> dict[str, tuple[DataType, int | None]]:
    """Type and declared length of every column after evolution."""
    if mode not in ("apply_new_only", "apply_and_update_existing"):
        raise ValueError(f"unknown mode {mode}")
    after = {f.name: (f.dataType, f.metadata.get("length")) for f in current.schema.fields}
    for f in incoming.schema.fields:
        if f.name not in after:
            after[f.name] = (f.dataType, f.metadata.get("length"))
            continue
        old, length = after[f.name]
        if mode == "apply_and_update_existing":
            if isinstance(old, DecimalType) and isinstance(f.dataType, DecimalType):
                scale = max(old.scale, f.dataType.scale)
                whole = max(old.precision - old.scale, f.dataType.precision - f.dataType.scale)
                if whole + scale > 38:
                    raise ValueError(f"no decimal holds both types of {f.name}")
                old = DecimalType(whole + scale, scale)
            elif old == f.dataType and isinstance(old, StringType) and length is not None:
                # A string without a declared length holds any.
                length = None if f.metadata.get("length") is None else max(length, f.metadata["length"])
        after[f.name] = (old, length)
    return after


def evolve(current: DataFrame, incoming: DataFrame, mode: str = "apply_new_only") -> DataFrame:
    """Rows of both in the evolved schema.

    ``apply_new_only`` adds missing columns and keeps types; ``apply_and_update_existing`` also widens decimals and
    declared lengths of strings; ``drop_and_apply`` gives the incoming rows alone; ``generate_only`` leaves the current
    ones (``evolution_report`` says what they would need). Values that a kept type does not hold become null or are
    rounded; ``evolution_conflicts`` lists them.
    """
    if mode == "drop_and_apply":
        return incoming
    if mode == "generate_only":
        return current
    after = evolved_types(current, incoming, mode)

    def shaped(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        columns = []
        for name, (kind, length) in after.items():
            value = F.lit(None).cast(kind) if name not in have else F.col(f"`{name}`") if have[name] == kind else F.col(f"`{name}`").try_cast(kind)
            columns.append(value.alias(name, metadata={"length": length}) if length is not None else value.alias(name, metadata={}))
        return df.select(*columns)

    return shaped(current).union(shaped(incoming))
