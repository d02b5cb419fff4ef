"""Reading document collections: load, filter document, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaykit.functions import variants


def parse_documents(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON text rows to ``[_id STRING, doc VARIANT]``; the id is ``_id`` or ``_id.$oid``. Bad JSON is left out."""
    doc = F.try_parse_json(F.col(text))
    return lines.select(doc.alias("doc")).filter(F.col("doc").isNotNull()).select(
        F.coalesce(
            variants.get(F.col("doc"), ["_id", "$oid"], "string"), variants.get(F.col("doc"), ["_id"], "string")
        ).alias("_id"),
        "doc",
    )


def read_documents(spark: SparkSession, path: str, filters: dict | None = None) -> DataFrame:
    """A folder of JSON lines as documents, with a filter document applied."""
    docs = parse_documents(spark.read.text(path))
    return filter_documents(docs, filters or {})


def filter_documents(docs: DataFrame, filters: dict, doc: str = "doc") -> DataFrame:
    return docs.filter(filter_condition(filters, F.col(doc))) if filters else docs


def filter_condition(filters: dict, doc: Column) -> Column:
    """Predicate for a filter document; unknown operators are an error."""
    tests = []
    for path, wanted in filters.items():
        if path in ("$and", "$or"):
            parts = [filter_condition(f, doc) for f in wanted]
            tests.append(reduce(lambda a, b: a & b if path == "$and" else a | b, parts))
        elif path.startswith("$"):
            raise ValueError(f"unknown filter operator {path}")
        else:
            conditions = wanted if _is_operators(wanted) else {"$eq": wanted}
            tests += [_test(doc, path.split("."), op, value) for op, value in conditions.items()]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _is_operators(value) -> bool:
    return isinstance(value, dict) and bool(value) and all(k.startswith("$") for k in value) and not set(value) & set(variants.WRAPPERS)


def _read(doc: Column, names: list[str], like) -> Column:
    """Value at the path in the type of the literal, plain or wrapped."""
    if isinstance(like, bool):
        return variants.get(doc, names, "boolean")
    if isinstance(like, (int, float)):
        keys = ["$numberDecimal", "$numberDouble", "$numberLong", "$numberInt"]
        raw = variants.get(doc, names, "variant")
        numeric = F.schema_of_variant(raw).rlike("^(BIGINT|DECIMAL|DOUBLE)")
        return F.coalesce(
            *[variants.get(doc, [*names, k], "decimal(38,9)") for k in keys],
            F.when(numeric, variants.get(doc, names, "decimal(38,9)")),
        )
    if isinstance(like, _Date):
        millis = F.timestamp_millis(variants.get(doc, [*names, "$date", "$numberLong"], "bigint"))
        texts = [variants.get(doc, [*names, *rest], "string").try_cast("timestamp") for rest in (["$date"], [])]
        return F.coalesce(millis, *texts)
    return F.coalesce(variants.get(doc, [*names, "$oid"], "string"), variants.get(doc, names, "string"))


class _Date(str):
    """A date literal: compared as an instant, not as text."""


def _literal(value):
    if not isinstance(value, dict):
        return value
    ((kind, inner),) = value.items()
    if kind != "$date":
        return int(inner) if kind in ("$numberInt", "$numberLong") else float(inner) if kind in ("$numberDouble", "$numberDecimal") else inner
    return _Date(inner["$numberLong"] if isinstance(inner, dict) else inner)


def _bound(value) -> Column:
    if not isinstance(value, _Date):
        return F.lit(value)
    return F.timestamp_millis(F.lit(int(value))) if value.lstrip("-").isdigit() else F.lit(str(value)).cast("timestamp")


def _test(doc: Column, names: list[str], op: str, value) -> Column:
    raw = variants.get(doc, names, "variant")
    if op == "$exists":
        return raw.isNotNull() if value else raw.isNull()
    if op in ("$in", "$nin"):
        found = reduce(lambda a, b: a | b, [_test(doc, names, "$eq", v) for v in value], F.lit(False))
        return found if op == "$in" else ~found
    if op in ("$eq", "$ne"):
        if value is None:
            same = raw.isNull() | F.is_variant_null(raw)
        else:
            same = F.coalesce(_read(doc, names, _literal(value)) == _bound(_literal(value)), F.lit(False))
        return same if op == "$eq" else ~same
    read = _read(doc, names, _literal(value))
    bound = _bound(_literal(value))
    tests = {"$gt": read > bound, "$gte": read >= bound, "$lt": read < bound, "$lte": read <= bound}
    if op not in tests:
        raise ValueError(f"unknown filter operator {op}")
    return F.coalesce(tests[op], F.lit(False))


def sample_documents(
    docs: DataFrame, size: int = 1000, strategy: str = "random", seed: int = 0,
    time_col: str | None = None, window: tuple | None = None, id_col: str = "_id",
) -> DataFrame:
    """``size`` documents: at random, first by id, or first by id within a time window.

    Each is a top-k: every task keeps ``size`` rows, so nothing is fully sorted.
    """
    if strategy == "random":
        return docs.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(size)
    if strategy == "prefix":
        return docs.orderBy(id_col).limit(size)
    if strategy == "time_window":
        start, end = window
        inside = (F.col(time_col) >= F.lit(start)) & (F.col(time_col) < F.lit(end))
        return docs.filter(inside).orderBy(id_col).limit(size)
    raise ValueError(f"unknown sampling strategy {strategy}")
