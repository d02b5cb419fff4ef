"""Validation of odd documents: every rule, in the order of the schema."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from relaykit.operators import validate

SCHEMA = {
    "bsonType": "object", "additionalProperties": False, "required": ["a"],
    "properties": {
        "a": {"bsonType": ["int", "decimal", "double"], "minimum": 1},
        "p": {"bsonType": "string", "pattern": "^[a-z]+$", "enum": ["ab", "é", "x1"]},
        "e": {"enum": ["5", "{}"]},
        "l": {
            "bsonType": "array", "minItems": 1, "maxItems": 3,
            "items": {"bsonType": ["int", "object"], "additionalProperties": False, "required": ["q"], "properties": {"q": {"minimum": 0}, "m%": {"items": {"bsonType": "int"}}}},
        },
    },
}
CASES = [
    ({"a": 1}, []), ({}, ["a required"]), ({"a": 0}, ["a minimum"]), ({"a": 0.5}, ["a minimum"]), ({"a": 1e3}, []), ({"a": "x"}, ["a bsonType"]), ({"a": None}, ["a bsonType"]),
    ({"a": {"$numberDecimal": "0.999999999"}}, ["a minimum"]), ({"a": {"$numberDecimal": "0.9999999999"}}, []), ({"a": {"$numberDecimal": "-1e5"}}, ["a minimum"]), ({"a": {"$numberDecimal": "abc"}}, []),
    ({"a": {"$numberInt": "0"}}, ["a minimum"]), ({"a": {"$numberLong": "7"}}, ["a bsonType"]), ({"a": {"$timestamp": 0}}, []), ({"a": {"$numberDouble": 0.25}}, ["a minimum"]), ({"a": {"$numberDecimal": " 0 "}}, ["a minimum"]),
    ({"a": 1, "p": "ab\n"}, ["p enum"]), ({"a": 1, "p": "é"}, ["p pattern"]), ({"a": 1, "p": "zz"}, ["p enum"]), ({"a": 1, "p": 5}, ["p bsonType", "p enum"]),
    ({"a": 1, "e": 5}, []), ({"a": 1, "e": 5.0}, []), ({"a": 1, "e": {}}, []), ({"a": 1, "e": None}, ["e enum"]), ({"a": 1, "e": {"$numberDecimal": "5", "m": 1}}, []), ({"a": 1, "e": {"x": "5"}}, ["e enum"]),
    ({"a": 1, "l": []}, ["l minItems"]), ({"a": 1, "l": [1, 2, 3, 4]}, ["l maxItems"]),
    ({"z": 1, "l": [{"q": 1}, {"q": -1, "z": 1, "y": 2}, {"m%": [1, "x"]}, "s"], "y": 2}, [
        "a required", "y additionalProperties", "z additionalProperties", "l maxItems", "l[1].y additionalProperties", "l[1].z additionalProperties", "l[1].q minimum",
        "l[2].q required", "l[2].m%[1] bsonType", "l[3] bsonType",
    ]),
    (3, [" bsonType"]), ([1], [" bsonType"]),
]


def test_broken_rules_in_the_order_of_the_schema(spark):
    """Documents are checked in batches; only texts that a batch leaves open meet interpreted functions."""
    rows = [(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)] + [(-1, None)]
    df = spark.createDataFrame(rows, "_id int, t string").coalesce(1).select("_id", F.parse_json("t").alias("doc"))
    checked = validate.outcomes(df, SCHEMA)
    found = {r["_id"]: [f"{v['path']} {v['rule']}" for v in r["violations"]] for r in checked.collect()}
    assert found == {-1: [], **{i: want for i, (_, want) in enumerate(CASES)}}
    assert {r["_id"] for r in checked.filter("outcome = 'accepted'").collect()} == {i for i, v in found.items() if not v}
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("try_variant_get") < 50


def test_a_schema_without_rules_on_text(spark):
    df = spark.createDataFrame([(1, '{"a":[[1],[]]}'), (2, "{}")], "_id int, t string").select("_id", F.parse_json("t").alias("doc"))
    schema = {"properties": {"a": {"items": {"minItems": 1, "items": {"bsonType": "string"}}}}}
    assert [tuple(r) for r in validate.violations(df, schema).orderBy("path").collect()] == [(1, "a[0][0]", "bsonType"), (1, "a[1]", "minItems")]
