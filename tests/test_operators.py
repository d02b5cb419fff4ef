"""Cases that the query tables do not reach."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from relaykit.functions.naming import rename_columns, shorten, unique_names
from relaykit.operators import catalog, integrity, orders, series, shape, validate
from relaykit.operators.infer import document_paths
from relaykit.operators.skew import number_in_group
from relaykit.operators.transforms import apply_transform, cast_failures, to_decimal, to_timestamp
from relaykit.sources import loading, sketches
from relaykit.sources.documents import filter_documents, sample_documents


def docs(spark, *texts):
    return spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "_id string, t string").select("_id", F.parse_json("t").alias("doc"))


def test_rename_keeps_the_target_where_the_source_is_null(spark):
    df = spark.createDataFrame([(None, "keep"), ("new", "old")], "a string, b string")
    assert {r["b"] for r in apply_transform(df, {"op": "rename", "path": "a", "args": {"to": "b"}}).collect()} == {"keep", "new"}


def test_decimal_with_many_digits(spark):
    df = spark.createDataFrame([("123456789012345678901234.5",)], "v string")
    assert str(df.select(to_decimal(F.col("v"), 1).alias("v")).first()["v"]) == "123456789012345678901234.5"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_are_the_same_instant_in_any_session(spark, zone):
    # The vectors of the survey.
    cases = {
        "2025-08-14T18:45:07+0000": "2025-08-14 18:45:07", "2025-08-28T20:03:10.604-04:00": "2025-08-29 00:03:10.604", "2025-08-28T20:03:10.604+07:00": "2025-08-28 13:03:10.604",
        "2025-08-28T20:03:10Z": "2025-08-28 20:03:10", "2025-08-28T20:03:10": "2025-08-28 20:03:10", "2025-08-28 20:03:10": "2025-08-28 20:03:10", "not-a-date": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in cases], "v string")
        rows = df.select("v", F.unix_millis(to_timestamp(F.col("v"))).alias("ms"), F.unix_millis(to_timestamp(F.col("v"), zone="Asia/Tokyo")).alias("tokyo")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    import datetime as dt

    for row in rows:
        want = cases[row["v"]]
        ms = None if want is None else round(dt.datetime.fromisoformat(want + "+00:00").timestamp() * 1000)
        assert row["ms"] == ms
        if row["v"] == "2025-08-28T20:03:10":
            assert row["tokyo"] == ms - 9 * 3_600_000


def test_drop_honours_the_cap_and_the_last_field(spark):
    df = spark.createDataFrame([(["x", "y"], (1,))], "tags array<string>, s struct<a: int>")
    assert apply_transform(df, {"op": "drop", "path": "tags[]"}, 1).first()["tags"] == ["y"]
    assert apply_transform(df, {"op": "drop", "path": "s.a"}).columns == ["tags"]
    assert apply_transform(df, {"op": "upper", "path": "tags[]"}, 0).first()["tags"] == ["x", "y"]


def test_defaults_and_concat_leave_absent_parents_alone(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert apply_transform(df, {"op": "default_if_missing", "path": "meta.absent.lang", "args": {"value": "z"}}).columns == ["x", "y"]
    assert apply_transform(df, {"op": "concat", "path": "y", "args": {"paths": ["x"]}}).first()["y"] is None
    assert apply_transform(df, {"op": "concat", "path": "new", "args": {"paths": ["x"]}}).columns == ["x", "y"]


def test_cast_failures_follow_renames_and_may_be_empty(spark):
    df = spark.createDataFrame([(1, "bad")], "k int, a string")
    specs = [{"op": "rename", "path": "a", "args": {"to": "b"}}, {"op": "cast", "path": "b", "args": {"type": "int"}}]
    assert [r["path"] for r in cast_failures(df, specs, "k").collect()] == ["b"]
    assert cast_failures(df, [], "k").columns == ["k", "op", "path", "value"]


def test_date_filters_compare_instants(spark):
    d = docs(spark, '{"at": {"$date": "2024-01-01T02:00:00+02:00"}}', '{"at": {"$date": {"$numberLong": "1704067200000"}}}', '{"at": {"$date": "2024-01-01T03:00:00Z"}}')
    assert filter_documents(d, {"at": {"$lt": {"$date": "2024-01-01T01:00:00Z"}}}).count() == 2
    with pytest.raises(ValueError):
        filter_documents(d, {"at": {"$near": 1}})
    with pytest.raises(ValueError):
        sample_documents(d, strategy="other")


def test_unknown_schema_words_raise():
    for schema in ({"maximum": 3}, {"bsonType": "regex"}, {"properties": {"a": {"uniqueItems": True}}}):
        with pytest.raises(ValueError):
            validate.check_schema(schema)


def test_depth_bound_labels_containers(spark):
    found = {r["path"]: r["label"] for r in document_paths(docs(spark, '{"a": {"b": {"c": 1}}, "l": [[1]]}'), max_depth=1).collect()}
    assert None not in found.values() and found["a"] == "object"


def test_shared_names_and_paths(spark):
    assert unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert len(shorten("x" * 80)) == 63 and shorten("x" * 63) == "x" * 63
    assert rename_columns(spark.createDataFrame([(1, 2)], "unitPrice int, unit_price int")).columns == ["unit_price", "unit_price_2"]
    mapping = shape.plan_tables({"unitPrice": "int32", "unit_price": "int32", "box": "object", "box[]": "int32"}, "t")
    assert [c.name for c in mapping.base.columns] == ["id", "box", "unit_price", "unit_price_2"]


def test_number_in_group_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 5), ("a", 2)], "k string, v int")
    assert sorted(r["position"] for r in number_in_group(df, ["k"], "v", width=2).collect()) == [1, 1, 2]


def test_replace_order_cycles_and_export(spark, tmp_path):
    seen = []
    frames = {n: spark.range(1) for n in ("line", "order", "customer")}
    assert loading.replace_tables(frames, {"line": ["order"], "order": ["customer"]}, lambda n, d: seen.append(n)) == ["customer", "order", "line"] == seen
    with pytest.raises(ValueError):
        loading.replace_tables({"a": spark.range(1), "b": spark.range(1)}, {"a": ["b"], "b": ["a"]}, lambda n, d: None)
    path = str(tmp_path / "out")
    loading.export_csv(spark.range(5), path, F.lit(1))
    loading.export_csv(spark.range(9), path, F.lit(1), if_absent=True)
    assert loading.import_csv(spark, path, "id bigint").count() == 5


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert loading.upsert(empty, empty, ["k"], "v").count() == 0
    assert integrity.duplicates(spark.createDataFrame([(None,), (None,)], "k int"), ["k"]).count() == 0
    assert series.rate_cap(spark.createDataFrame([], "event_id long, ts timestamp, t string"), ["t"]).count() == 0
    with pytest.raises(ValueError):
        catalog.evolve(empty, empty, "other")
    assert catalog.evolve(empty, spark.createDataFrame([(1,)], "k int"), "drop_and_apply").count() == 1
    assert catalog.evolve(empty, spark.createDataFrame([(1,)], "k int"), "generate_only").count() == 0


def test_stock_outside_of_the_range_raises(spark):
    lines = spark.createDataFrame([(1, 1, 500, 1)], "w_id int, i_id int, ol_quantity long, supply_w_id int")
    with pytest.raises(Exception, match="out of range"):
        orders.update_stock(lines, spark.createDataFrame([(1, 1, 20)], "w_id int, i_id int, s_quantity long")).collect()


def test_points_do_not_carry_their_series(spark):
    """A point beside its whole series costs the square of the series' length."""
    response = '{"data":{"result":[{"metric":{"__name__":"m","job":"j","user":"1"},"values":[["15","1"],["30","x"]]},{"metric":{"job":"j"},"values":[]},null]}}'
    long = series.matrix_to_long(spark.createDataFrame([(response,), (None,)], "response string"))
    assert sorted((r["metric"], r["job"], r["labels"], r["ts"].timestamp(), r["value"]) for r in long.collect()) == [("m", "j", {"user": "1"}, 15.0, 1.0), ("m", "j", {"user": "1"}, 30.0, None)]
    carried = [re.search(r"values\S*\), \[(.*?)\]", line)[1] for line in long._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(" in line and "values" in line]
    assert [re.sub(r"#\d+L?", "", c) for c in carried] == ["metric, job, labels"]


def test_exact_quantiles_are_those_of_percentile(spark):
    for n in (1, 2, 5, 4000):
        rows = spark.range(n).selectExpr("pmod(id * 7919, 613) * 1.25D as v").union(spark.sql("select cast(null as double)"))
        assert sketches.exact_quantiles(rows, "v", [0.0, 0.48, 0.52, 1.0], 100) == rows.selectExpr("percentile(v, array(0.0, 0.48, 0.52, 1.0))").first()[0]
    assert sketches.exact_quantiles(rows.filter("v < 0"), "v", [0.5]) is None


def test_a_normalized_object_builds_its_document_once(spark):
    """A filter on the object would be moved below the documents, and would parse each of them again."""
    mapping = shape.plan_tables({"box": "object", "box.a": "int32"}, "orders", {"tableOverrides": [{"path": "box", "mode": "normalize"}]})
    rows = shape.table_rows(docs(spark, '{"box":{"a":1}}', '{"box":null}', "{}", "3", '{"box":{}}'), mapping, mapping.table("box"))
    assert sorted((r["id"], r["box_a"]) for r in rows.collect()) == [("0", 1), ("4", None)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_paths_read_documents_once_and_at_any_depth(spark):
    """No pass over the documents counts their depth; brackets inside strings and mixed elements do not mislead the walk."""
    deep = '{"a":[{"b":{"c":{"d":{"e":{"f":[{"g":"]}"},5]}}}}}]}'
    source, seen = docs(spark, deep), spark.sparkContext.accumulator(0)
    counted = source.select("_id", "doc", F.udf(lambda _: seen.add(1), "int")("_id").alias("n")).select("_id", F.when(F.coalesce("n", F.lit(0)) >= 0, F.col("doc")).alias("doc"))
    nodes = document_paths(counted)
    assert seen.value == 0
    assert {(r["path"], r["label"], r["size"]) for r in nodes.collect()} >= {("a", "array", 1), ("a[].b.c.d.e.f", "array", 2), ("a[].b.c.d.e.f[].g", "string", None), ("a[].b.c.d.e.f[]", "int32", None)}


def test_the_grid_has_every_step_of_the_range_queries(spark, tmp_path):
    """``m_grid`` fills the steps of 15 seconds that its points come in, not one step an hour."""
    from suite.records import m_grid

    events = [(1, "click", 2, "2024-01-01 23:59:31", 1.25), (2, "click", 2, "2024-01-02 00:00:50", 2.5), (3, "view", 2, "2024-01-02 00:01:00", 4.0)]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    by_time = sorted(((r["metric"], r["ts"], r["value"]) for r in m_grid(spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert [v for m, _, v in by_time if m == "click"] == [1.25] * 5 + [2.5] * 2 and [v for m, _, v in by_time if m == "view"] == [None] * 6 + [4.0]
