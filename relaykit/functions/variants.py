"""Reading values out of VARIANT documents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single-key objects that stand for a scalar, with the label each one carries.
WRAPPERS = {
    "$oid": "objectId",
    "$date": "date",
    "$timestamp": "int32",
    "$numberInt": "int32",
    "$numberLong": "int64",
    "$numberDouble": "double",
    "$numberDecimal": "decimal",
}

# Text patterns behind the objectId and date labels, and the limits around them.
HEX24 = "^[0-9a-fA-F]{24}$"
ISO_DATE_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2}|[+-]\d{4})?)?$"
ISO_MAX_LENGTH = 35
INT32_MAX = 2147483647

# A wrapper's key with the kind of the value it may hold.
WRAPPER_SIGNATURE = (
    r"^\$(oid STRING|date .*|timestamp .*|numberInt (STRING|BIGINT)|numberLong (STRING|BIGINT)"
    r"|numberDouble (STRING|BIGINT|DOUBLE|DECIMAL.*)|numberDecimal STRING)$"
)
SCALAR_KINDS = {
    "VOID": "null", "STRING": "string", "BIGINT": "int32", "DECIMAL": "double", "DOUBLE": "double", "BOOLEAN": "bool",
}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, so that an expression grows with its parts and no faster."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup(key: Column, values: dict[str, str]) -> Column:
    """Value of a small fixed table as an expression, null for an unknown key."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def json_path(names: list[str]) -> str:
    return "$" + "".join(f".{n}" if re.fullmatch(r"[A-Za-z_]\w*", n) else f"['{n}']" for n in names)


def get(value: Column, names: list[str], as_type: str) -> Column:
    """Value at a path of field names, null when absent or not convertible."""
    return F.try_variant_get(value, json_path(names), as_type)


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def json_text(value: Column, names: list[str]) -> Column:
    """JSON text of the subtree, null when the path is absent or holds a JSON null."""
    sub = get(value, names, "variant")
    return F.when(~F.is_variant_null(sub), F.to_json(sub))


def wrapper_label(members: Column) -> Column:
    """Label of a wrapper object, null for any other object. ``members`` is the object as a map."""
    key, inner = F.map_keys(members)[0], F.map_values(members)[0]
    signature = F.concat_ws(" ", key, F.schema_of_variant(inner))
    fits = signature.rlike(WRAPPER_SIGNATURE) & (
        (key != "$oid") | F.coalesce(get(inner, [], "string").rlike(HEX24), F.lit(False))
    )
    return F.when((F.size(members) == 1) & key.startswith("$") & fits, lookup(key, WRAPPERS))


def scalar_kind(value: Column) -> Column:
    """Kind of a value that is neither an object nor an array: null, bool, int32, int64, double or string."""
    found = lookup(F.substring_index(F.schema_of_variant(value), "(", 1), SCALAR_KINDS)
    wide = (found == "int32") & ~get(value, [], "decimal(20,0)").between(-INT32_MAX, INT32_MAX)
    return F.when(wide, "int64").otherwise(F.coalesce(found, F.lit("string")))


def string_label(text: Column) -> Column:
    """objectId for 24 hex digits, then date for ISO date or date-time text, else string."""
    return (
        F.when(text.rlike(HEX24), "objectId")
        .when((F.length(text) <= ISO_MAX_LENGTH) & text.rlike(ISO_DATE_TIME), "date")
        .otherwise("string")
    )


def scalar_label(value: Column) -> Column:
    """Like ``scalar_kind``, but text is split into objectId, date and string."""
    return once(scalar_kind(value), lambda found: F.when(found == "string", string_label(get(value, [], "string"))).otherwise(found))


def kind(value: Column) -> Column:
    """Stored kind of any value: wrappers count as the scalar they stand for; text is always string."""
    members = as_map(value)
    return (
        F.when(members.isNotNull(), F.coalesce(wrapper_label(members), F.lit("object")))
        .when(as_array(value).isNotNull(), "array")
        .otherwise(scalar_kind(value))
    )
