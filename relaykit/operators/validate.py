"""Checks documents against a declared schema and splits off those that break it."""

from __future__ import annotations

import decimal
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaykit.functions import variants
from relaykit.functions.variant_arrays import (
    DECIMAL, DOUBLE, INT32, INT64, LABELS, STRING, T_ARRAY, T_INT8, T_INT16, T_INT32, T_INT64, T_OBJECT, T_SHORT, T_STRING, VARIANT, Run, runs,
)

# Declared type names and the stored kind each one accepts.
TYPE_KINDS = {
    "objectId": "objectId", "string": "string", "bool": "bool", "int": "int32", "long": "int64", "double": "double",
    "decimal": "decimal", "date": "date", "object": "object", "array": "array", "null": "null",
}
# What the batch walk gives: a broken rule, or a value with the number of the test that decides.
CANDIDATES = T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("test", T.IntegerType()), T.StructField("value", T.VariantType()),
]))
CANDIDATE = pa.struct([("path", pa.string()), ("rule", pa.string()), ("test", pa.int32()), ("value", VARIANT)])


KEYWORDS = {
    "bsonType", "pattern", "enum", "minimum", "minItems", "maxItems", "required", "properties", "additionalProperties", "items", "title", "description",
}


def check_schema(schema: dict, path: str = "") -> None:
    """Raises ValueError for a keyword or type name that is not supported, so that no rule is passed over."""
    where = f" at {path}" if path else ""
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"unknown schema keywords {sorted(unknown)}{where}")
    if unknown := set(_names(schema)) - set(TYPE_KINDS):
        raise ValueError(f"unknown types {sorted(unknown)}{where}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"additionalProperties must be true or false{where}")
    for name, inner in schema.get("properties", {}).items():
        check_schema(inner, f"{path}.{name}".lstrip("."))
    if "items" in schema:
        check_schema(schema["items"], f"{path}[]")


def _names(schema: dict) -> list[str]:
    declared = schema.get("bsonType", [])
    return [declared] if isinstance(declared, str) else list(declared)


def _text(value: Column, schema: dict) -> Column:
    wrapped = ["$numberDecimal", "$numberLong", "$numberInt", "$numberDouble"] if "minimum" in schema or "enum" in schema else []
    return F.coalesce(*[variants.get(value, [w], "string") for w in wrapped], variants.get(value, [], "string"))


def _breaks(value: Column, rule: str, schema: dict) -> Column:
    """Whether the text of a value breaks a rule: the engine's patterns and casts decide."""
    text = _text(value, schema)
    if rule == "pattern":
        return ~text.rlike(schema["pattern"])
    if rule == "enum":
        return F.coalesce(~text.isin(schema["enum"]), F.lit(True))
    return text.try_cast("decimal(38,9)") < schema["minimum"]


def _text_tests(schema: dict) -> list[tuple[str, dict]]:
    """Distinct rules on texts in all of a schema, each with the words that it depends on."""
    found = [(rule, {k: schema[k] for k in ("pattern", "enum", "minimum") if k in schema}) for rule in ("pattern", "enum", "minimum") if rule in schema]
    for inner in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        found += [test for test in _text_tests(inner) if test not in found]
    return found


def _levels(schema: dict) -> int:
    """How many arrays the schema has inside one another."""
    below = [_levels(inner) for inner in schema.get("properties", {}).values()]
    return max([0, *below, *([1 + _levels(schema["items"])] if "items" in schema else [])])


class _Checker:
    """Broken rules of the documents of one run, all values that share a schema together.

    A rule on text that is not plainly kept or broken comes out with its value and the number of its test, for the engine
    to decide. Rows are in the order of the schema; elements of an array one after another.
    """

    def __init__(self, run: Run, tests: list[tuple[str, dict]], levels: int) -> None:
        self.run, self.tests, self.width = run, tests, 2 * levels + 2
        self.number = 0
        self.found: list[tuple] = []

    def add(self, nodes: _Nodes, which: np.ndarray, rule: str, test: int | None = None, value: np.ndarray | None = None, path: pa.Array | None = None, nth: np.ndarray | None = None) -> None:
        """``which`` nodes break a rule, or may break it by their ``value``."""
        self.number += 1
        if not len(which):
            return
        order = np.zeros((len(which), self.width), np.int64)
        for k, part in enumerate([*nodes.order, self.number]):
            order[:, k] = part[which] if isinstance(part, np.ndarray) else part
        if nth is not None:
            order[:, -1] = nth
        at = np.full(len(which), -1, np.int64) if value is None else value
        self.found.append((nodes.row[which], order, nodes.named(which) if path is None else path, rule, test, at))

    def check(self, nodes: _Nodes, schema: dict) -> None:
        run, at = self.run, nodes.at
        types = run.types(at)
        if {"bsonType", "pattern", "enum", "minimum"} & set(schema):
            self.check_values(nodes, schema, types, *run.kinds(at, nodes.row, types))
        arrays = np.flatnonzero(types == T_ARRAY)
        size = run.sizes(at[arrays], False)
        if "minItems" in schema:
            self.add(nodes, arrays[size < schema["minItems"]], "minItems")
        if "maxItems" in schema:
            self.add(nodes, arrays[size > schema["maxItems"]], "maxItems")
        properties, required = schema.get("properties", {}), schema.get("required", [])
        if properties or required or schema.get("additionalProperties") is False:
            objects = np.flatnonzero(types == T_OBJECT)
            parent, name, child = run.members(at[objects], nodes.row[objects])
            names = run.names
            slots = {n: k for k, n in enumerate(dict.fromkeys([*properties, *required]))}
            slot = np.array([slots.get(n, -1) for n in names] or [-1], np.int64)[name]
            place = np.full((len(objects), len(slots)), -1, np.int64)
            place[parent[slot >= 0], slot[slot >= 0]] = child[slot >= 0]
            for n in required:
                self.add(nodes, objects[place[:, slots[n]] < 0], "required", path=nodes.inside(n).named(objects[place[:, slots[n]] < 0]))
            if schema.get("additionalProperties") is False:
                declared = np.array([n in properties for n in names] or [False], bool)
                unknown = np.flatnonzero(~declared[name])
                above = nodes.named(objects[parent[unknown]]).to_pylist()
                paths = [names[n] if nodes.path is None else f"{p}.{names[n]}" for p, n in zip(above, name[unknown].tolist())]
                self.add(nodes, objects[parent[unknown]], "additionalProperties", path=pa.array(paths, pa.string()), nth=unknown)
            for n, inner in properties.items():
                there = np.flatnonzero(place[:, slots[n]] >= 0)
                self.check(nodes.inside(n).chosen(objects[there], place[there, slots[n]]), inner)
        if "items" in schema:
            self.number += 1
            parent, nth, child = run.elements(at[arrays])
            self.check(nodes.chosen(arrays[parent], child).element(nth, self.number), schema["items"])

    def check_values(self, nodes: _Nodes, schema: dict, types: np.ndarray, kind: np.ndarray, inner: np.ndarray) -> None:
        run, at = self.run, nodes.at
        words = {k: schema[k] for k in ("pattern", "enum", "minimum") if k in schema}
        test = lambda rule: self.tests.index((rule, words))
        if "bsonType" in schema:
            self.add(nodes, np.flatnonzero(~np.isin(kind, [LABELS.index(TYPE_KINDS[n]) for n in _names(schema)])), "bsonType")
        if "pattern" in schema:
            some = np.flatnonzero(kind == STRING)
            self.add(nodes, some, "pattern", test("pattern"), at[some])
        if "enum" in schema:
            plain = ((types == T_SHORT) | (types == T_STRING)) & all(isinstance(x, str) for x in schema["enum"])
            some = np.flatnonzero(plain)
            known = pc.is_in(run.gathered(*run.texts(at[some], types[some])), pa.array([x.encode() for x in schema["enum"]] if len(some) else [], pa.large_binary()))
            self.add(nodes, some[~known.to_numpy(zero_copy_only=False)], "enum")
            self.number -= 1  # both kinds of rows are the same rule
            self.add(nodes, np.flatnonzero(~plain), "enum", test("enum"), at[~plain])
        if "minimum" in schema:
            some = np.flatnonzero(np.isin(kind, [INT32, INT64, DOUBLE, DECIMAL]))
            held = np.where(inner[some] >= 0, inner[some], at[some])
            low, open_ = self.below(held, schema["minimum"])
            self.add(nodes, some[low], "minimum")
            self.number -= 1
            self.add(nodes, some[open_], "minimum", test("minimum"), held[open_])

    def below(self, at: np.ndarray, minimum: object) -> tuple[np.ndarray, np.ndarray]:
        """Which numbers are plainly below the minimum, and which are left to the engine. Whole numbers and short decimals are plain."""
        low, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
        if type(minimum) is int and abs(minimum) < 1 << 62:
            types = self.run.types(at)
            for number, dtype in ((T_INT8, "<i1"), (T_INT16, "<i2"), (T_INT32, "<i4"), (T_INT64, "<i8")):
                some = np.flatnonzero(types == number)
                low[some], open_[some] = self.run.whole(at[some] + 1, dtype).astype(np.int64) < minimum, False
            some = np.flatnonzero((types == T_SHORT) | (types == T_STRING))
            texts = self.run.gathered(*self.run.texts(at[some], types[some]))
            ascii_ = pc.match_substring_regex(texts, r"^-?[0-9]{1,12}(\.[0-9]{1,9})?\z").to_numpy(zero_copy_only=False)
            some, texts = some[ascii_], texts.filter(pa.array(ascii_)).cast(pa.string())
            low[some], open_[some] = pc.less(texts.cast(pa.decimal128(38, 9)), pa.scalar(decimal.Decimal(minimum), pa.decimal128(38, 9))).to_numpy(zero_copy_only=False), False
        return low, open_

    def listed(self, rows: int) -> pa.Array:
        """One list a document."""
        if not self.found:
            return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], CANDIDATE))
        row = np.concatenate([f[0] for f in self.found])
        order = np.concatenate([f[1] for f in self.found])
        by = np.lexsort((*order.T[::-1], row))
        path = pa.concat_arrays([f[2] for f in self.found])
        rule = pa.concat_arrays([pa.repeat(f[3], len(f[0])) for f in self.found])
        test = pa.concat_arrays([pa.repeat(pa.scalar(f[4], pa.int32()), len(f[0])) for f in self.found])
        at = np.concatenate([f[5] for f in self.found])[by]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
        values = self.run.copies(np.maximum(at, 0), row[by], at >= 0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([path.take(by), rule.take(by), test.take(by), values], fields=list(CANDIDATE)))


@dataclass(frozen=True)
class _Nodes:
    """Values that share a schema: rows and positions, the path with a place for each index, and what orders them."""

    row: np.ndarray
    at: np.ndarray
    path: str | None = None
    indices: tuple[np.ndarray, ...] = ()
    order: tuple = ()

    def chosen(self, which: np.ndarray, at: np.ndarray) -> _Nodes:
        order = tuple(part[which] if isinstance(part, np.ndarray) else part for part in self.order)
        return replace(self, row=self.row[which], at=at, indices=tuple(i[which] for i in self.indices), order=order)

    def inside(self, name: str) -> _Nodes:
        name = name.replace("%", "%%")
        return replace(self, path=name if self.path is None else f"{self.path}.{name}")

    def element(self, nth: np.ndarray, number: int) -> _Nodes:
        return replace(self, path=f"{self.path or ''}[%d]", indices=(*self.indices, nth), order=(*self.order, number, nth))

    def named(self, which: np.ndarray) -> pa.Array:
        if not self.indices:
            return pa.repeat((self.path or "") % (), len(which))
        return pa.array([(self.path or "") % at for at in zip(*(i[which].tolist() for i in self.indices))], pa.string())


def document_violations(doc: Column, schema: dict) -> Column:
    """All broken rules of one document as ``array<struct<path, rule>>``; an unsupported schema raises ValueError."""
    check_schema(schema)
    tests, levels = _text_tests(schema), _levels(schema)

    def candidates(documents: pa.Array) -> pa.Array:
        found = []
        for start, end in runs(documents):
            run = Run(documents.slice(start, end - start))
            checker = _Checker(run, tests, levels)
            checker.check(_Nodes(run.rows, run.starts), schema)
            found.append(checker.listed(end - start))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(CANDIDATE))

    found = F.arrow_udf(candidates, CANDIDATES)(doc)
    if tests:
        broken = lambda v: reduce(lambda c, k: c.when(v["test"] == k, _breaks(v["value"], *tests[k])), range(len(tests)), F.when(v["test"].isNull(), F.lit(True)))
        found = F.filter(found, broken)
    return F.transform(found, lambda v: F.struct(v["path"].alias("path"), v["rule"].alias("rule")))


def violations(docs: DataFrame, schema: dict, id_col: str = "_id", doc: str = "doc") -> DataFrame:
    """One row per broken rule: ``[id, path, rule]``."""
    return docs.select(id_col, F.explode(document_violations(F.col(doc), schema)).alias("v")).select(id_col, "v.*")


def outcomes(docs: DataFrame, schema: dict, level: str = "strict", doc: str = "doc") -> DataFrame:
    """Adds ``violations`` and ``outcome`` (accepted or rejected) in one pass; the ``moderate`` level accepts all."""
    checked = docs.withColumn("violations", document_violations(F.col(doc), schema))
    bad = F.lit(level != "moderate") & (F.size("violations") > 0)
    return checked.withColumn("outcome", F.when(bad, "rejected").otherwise("accepted"))


def write_outcomes(docs: DataFrame, schema: dict, path: str, level: str = "strict", doc: str = "doc") -> None:
    """Both outcomes as Parquet in one pass: folders ``outcome=accepted`` and ``outcome=rejected`` of a shared path; documents as JSON."""
    checked = outcomes(docs, schema, level, doc)
    checked.withColumn(doc, F.to_json(doc)).write.partitionBy("outcome").mode("overwrite").parquet(path)
