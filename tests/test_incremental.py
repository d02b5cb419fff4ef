"""Kept sketches, summaries, co-located tables, metric files and one-pass outputs."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaykit.operators import catalog, infer, shape
from relaykit.operators.transforms import apply_transforms, cast_failures, observed_transforms, transform_stats
from relaykit.sources import loading, metric_files, sketches


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def scans(spark, action) -> int:
    """File scans in the plans of all queries that an action runs."""
    before = {e.executionId() for e in plans(spark)}
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return sum(e.physicalPlanDescription().split("\n\n")[0].count("Scan parquet") for e in plans(spark) if e.executionId() not in before)


def plans(spark):
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [store.apply(i) for i in range(store.size())]


def test_sketches_read_new_files_only(spark, tmp_path):
    data, kept = str(tmp_path / "data"), sketches.FileStatistics(spark, str(tmp_path / "data"), str(tmp_path / "kept"), ["a", "s", "d"])
    make = lambda low, high: spark.range(low, high).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("d"))
    make(0, 20_000).repartition(4).write.parquet(data)
    assert kept.refresh() == 4 and kept.refresh() == 0
    make(20_000, 50_000).repartition(3).write.mode("append").parquet(data)
    assert kept.refresh() == 3 and kept.table.read().count() == 7
    found = {r["column_name"]: r for r in kept.statistics().collect()}
    assert [(found[c]["n_rows"], found[c]["n_nulls"], found[c]["low"], found[c]["high"]) for c in "asd"] == [(50_000, 0, "0", "49999"), (50_000, 0, "0", "6"), (50_000, 25_000, "0.0", "24999.0")]
    assert abs(found["a"]["n_distinct"] - 50_000) < 0.06 * 50_000 and found["s"]["n_distinct"] == 7 and abs(found["d"]["n_distinct"] - 25_000) < 0.06 * 25_000
    # Rank errors: quartiles of 0..49999 within 2 % of the rows.
    assert all(abs(q - want) < 1000 for q, want in zip(found["a"]["quantiles"], (12_500, 25_000, 37_500))) and found["s"]["quantiles"] is None
    assert sum(x["count"] for x in found["s"]["frequent"]) >= 5 * 7142 and all(x["count"] in (7142, 7143) for x in found["s"]["frequent"])


def test_sketches_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "p int, a long, s string")
    found = {r["column_name"]: r for r in sketches.merged_statistics(sketches.part_sketches(empty, ["a", "s"], ["p"]), ["a", "s"]).collect()}
    assert [(r["n_rows"], r["n_nulls"], r["low"], r["n_distinct"], r["quantiles"]) for r in found.values()] == [(0, 0, None, 0, None)] * 2
    nulls = spark.createDataFrame([(1, None, None), (2, None, None)], empty.schema)
    found = sketches.merged_statistics(sketches.part_sketches(nulls, ["a", "s"], ["p"]), ["a", "s"]).collect()
    assert [(r["n_rows"], r["n_nulls"], r["low"], r["n_distinct"], r["quantiles"], r["frequent"]) for r in found] == [(2, 2, None, 0, None, [])] * 2


def test_summaries_of_parts_equal_the_whole(spark):
    texts = ['{"a": {"b": 1}, "l": [1, "x", null]}', '{"a": null, "l": [1, 2]}', '{"a": 5, "l": "no", "n": [[1]]}', '{"l": [{"k": 1}, {"k": "x"}]}', "{}", '{"a": {"b": 1}, "l": [1, "x", null]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, j string").select("_id", F.parse_json("j").alias("doc"))
    nodes = infer.document_paths(docs)
    whole = infer.merge_summaries(*[infer.path_summary(infer.document_paths(docs.filter(F.col("_id") % 3 == p))) for p in range(3)])
    assert rows(infer.report_of(whole)) == rows(infer.path_report(nodes)) and rows(infer.schema_of(whole)) == rows(infer.infer_schema(nodes))
    assert rows(whole.filter("label is not null")) == rows(infer.path_labels(nodes))
    assert infer.merge_summaries(whole, infer.path_summary(infer.document_paths(docs.limit(0), max_depth=1))).count() == whole.count()


def test_families_join_without_an_exchange(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("x"), F.col("id").cast("string").alias("y"), F.lit(1).alias("z"))
    saved = shape.save_families(df, ["id"], {"hot": ["x"], "cold": ["y"]}, "families_test", str(tmp_path), buckets=4)
    joined = shape.join_families(spark, saved, ["id"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan
    assert rows(joined.select(*df.columns)) == rows(df) and set(saved) == {"hot", "cold", "rest"}
    for name in saved.values():
        spark.sql(f"DROP TABLE {name}")


def test_metric_files(spark, tmp_path):
    schema = "ts long, value double, note string, scenario string, test int, instance string"
    data = [(i, i / 2, None if i % 3 else 'a "b", c', "base", i % 2, f"n{i % 4}") for i in range(40)]
    folder = str(tmp_path / "out")
    metric_files.write_metrics(spark.createDataFrame(data, schema).repartition(5), folder)
    files = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)
    assert files == sorted({f"base/test{i % 2}/n{i % 4}.csv.gz" for i in range(40)})
    read = metric_files.read_metrics(spark, folder, "ts long, value double, note string")
    assert rows(read) == rows(spark.createDataFrame(data, schema)) and [r["ts"] for r in read.filter("instance = 'n1'").collect()] == list(range(1, 40, 4))
    # A task that fails leaves no file and no staging folder, and what was there stays.
    broken = spark.createDataFrame([(1, 1.0, None, "base", 7, "n0"), (2, 1.0, None, "base", 8, None)], schema)
    with pytest.raises(Exception, match="must have a place"):
        metric_files.write_metrics(broken, folder)
    assert sorted(os.listdir(folder)) == ["base"] and sorted(os.listdir(f"{folder}/base")) == ["test0", "test1"]
    metric_files.register(spark)
    scattered = spark.createDataFrame(data, schema).filter("instance = 'n0'").repartition(3)
    with pytest.raises(Exception, match="several tasks"):
        scattered.write.format("metric_files").option("path", folder).mode("append").save()
    metric_files.write_metrics(spark.createDataFrame(data[:4], schema), folder, overwrite=True)
    assert rows(metric_files.read_metrics(spark, folder, "ts long, value double, note string")) == rows(spark.createDataFrame(data[:4], schema))
    with pytest.raises(Exception, match="need the columns"):
        spark.range(1).write.format("metric_files").option("path", folder).mode("append").save()


def test_quarantine_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(i, "x" if i % 4 else None) for i in range(100)], "k int, s string").write.parquet(str(tmp_path / "in"))
    checks, out = {"no text": "s is not null", "large": "k < 50"}, {}
    source = spark.read.parquet(str(tmp_path / "in"))
    assert scans(spark, lambda: out.update(found=loading.quarantine_to(source, checks, str(tmp_path / "out")))) == 1
    good, bad, counts = out["found"]
    plain_good, plain_bad = loading.quarantine(source, checks)
    assert rows(good) == rows(plain_good) and rows(bad) == rows(plain_bad) and counts == {"good": good.count(), "no text": 25, "large": bad.count() - 25}


def test_transforms_counted_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([("1", " a ", ["x", "y"]), ("z", None, None), (None, "b", [])], "n string, t string, l array<string>")
    specs = [{"op": "trim", "path": "t"}, {"op": "cast", "path": "n", "args": {"type": "int"}}, {"op": "default_if_missing", "path": "t", "args": {"value": "d"}}, {"op": "upper", "path": "l[]"}, {"op": "lower", "path": "none"}]
    done, counts = observed_transforms(df, specs)
    assert rows(done) == rows(apply_transforms(df, specs))
    assert [(c["step"], c["op"], c["path"], c["matches"]) for c in counts()] == [tuple(r) for r in transform_stats(df, specs).orderBy("step").collect()]
    assert [c["failures"] for c in counts()] == [0, cast_failures(df, specs, "t").count(), 0, 0, 0]
    same, none = observed_transforms(df, [])
    assert same is df and none() == []


def test_evolution_of_lengths_and_conflicts(spark):
    def frame(data, length, kind="int"):
        fields = [T.StructField("k", T.LongType()), T.StructField("s", T.StringType(), True, {"length": length} if length else {}), T.StructField("v", T.StringType() if kind == "string" else T.IntegerType())]
        return spark.createDataFrame(data, T.StructType(fields))

    old, new = frame([(1, "ab", 1)], 3), frame([(2, "abcd", "7"), (3, "a", "x"), (4, None, None)], 5, "string")
    wide, kept = (catalog.evolve(old, new, m) for m in ("apply_and_update_existing", "apply_new_only"))
    assert wide.schema["s"].metadata == {"length": 5} and kept.schema["s"].metadata == {"length": 3} and kept.schema["v"].dataType == T.IntegerType()
    assert rows(kept) == [(1, "ab", 1), (2, "abcd", 7), (3, "a", None), (4, None, None)]
    assert rows(catalog.evolution_conflicts(old, new, ["k"])) == [(2, "s", "abcd"), (3, "v", "x")]
    assert rows(catalog.evolution_conflicts(old, new, ["k"], "apply_and_update_existing")) == [(3, "v", "x")]
    assert catalog.evolve(old, frame([], None), "apply_and_update_existing").schema["s"].metadata == {}
    assert rows(catalog.evolution_report(old, new.withColumn("more", F.lit(1)), "t")) == [
        ("t", "k", "keep", "long", "long"), ("t", "more", "add", None, "integer"), ("t", "s", "widen", "string(3)", "string(5)"), ("t", "v", "conflict", "integer", "string")]


def test_export_fills_in_missing_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    assert loading.export_csv_parts(spark.range(4), path, F.col("id") % 2) == ["0", "1"]
    assert loading.export_csv_parts(spark.range(9), path, F.col("id") % 3) == ["2"] and loading.export_csv_parts(spark.range(9), path, F.col("id") % 3) == []
    assert sorted(r["id"] for r in loading.import_csv(spark, path, "id bigint, folder int").collect()) == [0, 1, 2, 2, 3, 5, 8]
