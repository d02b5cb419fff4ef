"""Documents that are decoded together, against a plain walk of their JSON and the expressions on single values."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaykit.functions import variants
from relaykit.functions.variant_arrays import Run, runs
from relaykit.operators import infer

# The texts at the edges of each label.
TEXTS = [
    "671f00000000000000000000", "671f00000000000000000000\n", "671f00000000000000000000\r\n", "671f00000000000000000000 ", "671f00000000000000000000x", "671f0000000000000000000g",
    "2024-01-01", "2024-01-01\n", "2024-01-01T10:00:00.123456+02:00", "2024-01-01T10:00:00.1234567+02:00", "2024-01-01 10:00:00Z", "2024-1-01", "٢024-01-01", "ü024-01-01", "", "x" * 300,
]
NUMBERS = [1, 127, 128, -129, 32768, 2147483647, 2147483648, -2147483647, -2147483648, 9223372036854775807, 9223372036854775808, 1.5, 1e300, 100.0, True, None]
WRAPPED = [
    {"$oid": "671f00000000000000000000"}, {"$oid": "short"}, {"$oid": 5}, {"$date": None}, {"$date": {"$numberLong": "1"}}, {"$timestamp": {"t": 1}}, {"$numberInt": 5}, {"$numberInt": 1.5},
    {"$numberLong": "x"}, {"$numberDouble": 1.5}, {"$numberDouble": True}, {"$numberDecimal": 5}, {"$numberDecimal": "5"}, {"$numberDecimal": "5", "more": 1}, {"$other": 1}, {"$date": 1, "b": 2}, {}, {"a": 1},
]


def found_in(value, path, out):
    """Paths and sizes of a document by a plain walk; labels are checked by the expressions."""
    for name, inner in value.items():
        opened(inner, f"{path}.{name}" if path is not None else name, out)


def wrapper(value):
    ((key, held),) = value.items() if len(value) == 1 else (("", None),)
    number = isinstance(held, int) and not isinstance(held, bool)
    return (
        key in ("$date", "$timestamp") or key == "$oid" and isinstance(held, str) and bool(re.fullmatch("[0-9a-f]{24}", held))
        or key in ("$numberInt", "$numberLong") and (isinstance(held, str) or number)
        or key == "$numberDouble" and (isinstance(held, str | float) or number) or key == "$numberDecimal" and isinstance(held, str)
    )


def opened(value, path, out):
    out[path, len(value) if isinstance(value, list) else None] += 1
    if isinstance(value, dict) and not wrapper(value):
        found_in(value, path, out)
    elif isinstance(value, list) and not path.endswith("[]"):
        for x in value:
            opened(x, f"{path}[]", out)


def test_nodes_are_those_of_a_plain_walk(spark):
    """Documents are not walked by interpreted functions of their single values."""
    odd = [
        {"": {"": []}, "x[]": [1], "y[]": {"z": [2, {"q": 1}]}}, {"a.b": 1, "a": {"b": "x"}}, {"l": [[1, [2]], {"x": [1]}, "s", None]}, {"texts": TEXTS}, {"numbers": NUMBERS}, {"wrapped": WRAPPED},
        {"obj": {f"k{i}": i for i in range(300)}, "big": list(range(400))}, {"a": {"b": {"c": {"d": [{"e": 1}]}}}}, {},
    ]
    texts = [json.dumps(d) for d in odd] + ["3", "null", "[1]", None]
    df = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "_id int, t string").coalesce(1).select("_id", F.parse_json("t").alias("doc"))
    want = Counter()
    for document in odd:
        found_in(document, None, want)
    nodes = infer.document_paths(df)
    assert Counter((r["path"], r["size"]) for r in nodes.collect()) == want
    assert "lambda" not in nodes._jdf.queryExecution().optimizedPlan().toString().lower()


def test_labels_are_those_of_the_expressions(spark):
    values = [*TEXTS, *NUMBERS, *WRAPPED, [], [1]]
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)], "_id int, t string").select("_id", F.parse_json("t").alias("doc"))
    typed = ["date'2024-01-01'", "date'-0001-01-01'", "timestamp'2024-01-01 01:02:03.123456'", "cast(1.5 as float)", "X'61'", "cast(100 as decimal(10,2))"]
    every = ", ".join(f"to_variant_object(named_struct('v', {t}))" for t in typed)
    df = df.union(spark.range(1).selectExpr(f"explode(array({every})) as doc").selectExpr("1000 as _id", "doc"))
    v = variants.get(F.col("doc"), ["v"], "variant")
    label = F.when(variants.kind(v) == "string", variants.scalar_label(v)).otherwise(variants.kind(v))
    nodes = infer.document_paths(df).filter("path = 'v'").select("_id", "label").collect()
    assert Counter(nodes) == Counter(df.select("_id", label.alias("label")).collect()) and len(nodes) == len(values) + 6


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_runs_of_any_size_give_the_same_nodes(spark, size):
    text = F.concat(F.lit('{"a":['), F.array_join(F.expr("transform(sequence(0L, id), x -> cast(x as string))"), ","), F.lit('],"b":{"c":"x"}}'))
    read = [r["doc"] for r in spark.range(50).select(F.parse_json(text).alias("doc")).collect()]
    documents = pa.array([{"value": d.value, "metadata": d.metadata} for d in read] + [None], pa.struct({"value": pa.binary(), "metadata": pa.binary()}))
    found = Counter()
    for start, end in runs(documents, size):
        for row, path, label, _ in infer._nodes(Run(documents.slice(start, end - start)), None, None, most=7):
            assert len(row) <= 7
            found.update(zip((row.to_numpy() + start).tolist(), path.to_pylist(), label.to_pylist()))
    assert found == {(r, p, k): n for r in range(50) for p, k, n in [("a", "array", 1), ("a[]", "int32", r + 1), ("b", "object", 1), ("b.c", "string", 1)]}


def test_shapes_are_counted_by_whole_paths_first(spark):
    """Nodes of elements are not renamed one by one."""
    rows = [("a", "array", 2), ("a[]", "objectId", None), ("a[]", "object", None), ("b", "array", 0), ("c", "object", None), ("c[]", "array", 9), ("d", "string", None)]
    profile = infer.shape_profile(spark.createDataFrame(rows, "path string, label string, size int"))
    assert sorted((r["path"], r["n_arrays"], r["n_objects"], r["n_elements"], r["max_length"], r["id_share"], r["suggestion"]) for r in profile.collect()) == [
        ("a", 1, 0, 2, 2, 0.5, "child_table"), ("b", 1, 0, 0, 0, None, "jsonb"), ("c", 0, 1, 1, None, 0.0, "columnize"),
    ]
    assert profile._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
