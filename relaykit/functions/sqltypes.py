"""SQL type texts: defaults per label, source types to target types, and the Spark type of each."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaykit.functions.variants import lookup

# SQL type of each inferred label.
LABEL_TYPES = {
    "objectId": "STRING(24)",
    "string": "STRING",
    "bool": "BOOL",
    "int": "INT4",
    "int32": "INT4",
    "int64": "INT8",
    "long": "INT8",
    "double": "FLOAT8",
    "decimal": "DECIMAL(38,9)",
    "date": "TIMESTAMPTZ",
    "object": "JSON",
    "array": "JSON",
    "null": "STRING",
}

# Target type of each source catalog type; decimal and numeric take precision and scale.
SOURCE_TYPES = {
    "tinyint": "INT8",
    "smallint": "INT8",
    "int": "INT8",
    "bigint": "INT8",
    "bit": "BOOL",
    "decimal": "DECIMAL",
    "numeric": "DECIMAL",
    "money": "DECIMAL(19,4)",
    "smallmoney": "DECIMAL(10,4)",
    "float": "FLOAT8",
    "real": "FLOAT8",
    "char": "STRING",
    "nchar": "STRING",
    "varchar": "STRING",
    "nvarchar": "STRING",
    "text": "STRING",
    "ntext": "STRING",
    "binary": "BYTES",
    "varbinary": "BYTES",
    "image": "BYTES",
    "rowversion": "BYTES",
    "timestamp": "BYTES",
    "date": "DATE",
    "datetime": "TIMESTAMP",
    "datetime2": "TIMESTAMP",
    "smalldatetime": "TIMESTAMP",
    "datetimeoffset": "TIMESTAMPTZ",
    "time": "TIME",
    "uniqueidentifier": "UUID",
}

SPARK_TYPES = {
    "BOOL": "boolean", "INT4": "int", "INT8": "bigint", "FLOAT8": "double", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "BYTES": "binary",
}


def label_type(
    label: str,
    overrides: dict[str, str] | None = None,
    max_varchar: int = 1024,
    decimal_default: str = "DECIMAL(38,9)",
    time_default: str = "TIMESTAMPTZ",
) -> str:
    """SQL type of a label. A text that is not a label is taken as an explicit SQL type."""
    labels = {name.lower(): sql for name, sql in LABEL_TYPES.items()}
    if label.lower() not in labels:
        return label
    labels.update({name.lower(): sql for name, sql in (overrides or {}).items()})
    sql = labels[label.lower()]
    if sql == "DECIMAL(38,9)":
        return decimal_default
    if sql == "TIMESTAMPTZ":
        return time_default
    if sql == "STRING" and max_varchar > 0:
        return f"STRING({max_varchar})"
    return sql


def spark_type(sql: str) -> str:
    """Spark type that stores a SQL type; JSON and UUID are kept as text."""
    decimal = re.fullmatch(r"DECIMAL(?:\((\d+)(?:,\s*(\d+))?\))?", sql)
    if decimal:
        return f"decimal({decimal[1] or 38},{decimal[2] or (0 if decimal[1] else 9)})"
    return SPARK_TYPES.get(sql, "string")


def source_type(data_type: Column, precision: Column, scale: Column) -> Column:
    """Target type of a source catalog type; unknown types become STRING."""
    low = F.lower(F.coalesce(data_type, F.lit("")))
    sized = F.when(
        precision.isNotNull() & scale.isNotNull(), F.format_string("DECIMAL(%d,%d)", precision, scale)
    ).when(precision.isNotNull(), F.format_string("DECIMAL(%d)", precision))
    mapped = F.coalesce(lookup(low, SOURCE_TYPES), F.lit("STRING"))
    return F.when(mapped == "DECIMAL", F.coalesce(sized, mapped)).otherwise(mapped)
