"""Queries on work that is done once: one pass for good and bad rows, kept sketches and summaries, co-located tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaykit.operators import catalog, infer, series, shape
from relaykit.operators.transforms import observed_transforms
from relaykit.session import work_dir
from relaykit.sources import loading, metric_files, sketches
from relaykit.sources.documents import sample_documents
from suite.inference import MIXED_LABELS, mixed_documents
from suite.inputs import table
from suite.records import POINTS, evolve_frames, long
from suite.transforms import STAT_SPECS


def quarantine_one_pass(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    good, bad, counts = loading.quarantine_to(events, {"value is low": "value >= 5", "type is error": "event_type <> 'error'"}, f"{work_dir(spark, 'quarantine')}/rows")
    counted = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    rows = good.select("event_id", F.lit("good").alias("reason")).union(bad.select(F.get_json_object("row", "$.event_id").cast("bigint"), "reason"))
    return rows.withColumn("n_alike", counted[F.col("reason")])


def transforms_one_pass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "case when lang <> 'fr' then lang end as lang2", "split(text, ' ') as words")
    done, counts = observed_transforms(docs, [*STAT_SPECS, {"op": "cast", "path": "lang2", "args": {"type": "int"}}])
    folder = work_dir(spark, "transforms")
    done.select("doc_id", "lang2").write.parquet(folder)
    found = spark.createDataFrame([(c["step"], c["op"], c["path"], c["matches"], c["failures"]) for c in counts()], "step int, op string, path string, matches long, failures long")
    return found.crossJoin(F.broadcast(spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n_rows"), F.count("lang2").alias("n_casts"))))


def table_stats_sketch(spark, sf_dir):
    """Line items in files by month of shipping, half of which come later; estimates are held against exact figures."""
    folder, columns = work_dir(spark, "sketches"), ["l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").select(*columns).withColumn("part", F.month("l_shipdate"))
    kept = sketches.FileStatistics(spark, f"{folder}/lines", f"{folder}/sketches", columns)
    for late in (False, True):
        # Months stand together, and a large one is dealt to several files.
        lines.filter((F.col("part") > 6) == late).hint("rebalance", "part").write.mode("append").parquet(f"{folder}/lines")
        kept.refresh()
    again = kept.refresh()
    found = kept.statistics(quantiles=[0.5])
    exact = loading.table_statistics(lines, columns, exact=True).select("column_name", F.col("n_distinct").alias("exact"))
    near = [(c, sketches.exact_quantiles(lines, c, [0.48, 0.52])) for c in ("l_orderkey", "l_partkey", "l_extendedprice")]
    bounds = spark.createDataFrame(near, "column_name string, near array<double>")
    both = found.join(exact, "column_name").join(bounds, "column_name", "left")
    return both.select(
        "column_name", "n_rows", "n_nulls", "low", "high", (F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(0.06 * F.col("exact"), F.lit(1))).alias("distinct_is_near"),
        F.coalesce((F.col("quantiles")[0] >= F.col("near")[0]) & (F.col("quantiles")[0] <= F.col("near")[1]), F.col("near").isNull()).alias("median_is_near"), F.lit(again).alias("read_again"),
    )


def frequent_values(spark, sf_dir):
    parts = sketches.part_sketches(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["event_type"], ["day"])
    return sketches.merged_statistics(parts, ["event_type"], frequent=10).select(F.inline("frequent")).select(F.col("item").alias("event_type"), F.col("count").alias("n"))


def infer_incremental(spark, sf_dir):
    """Three sets of documents, summed up apart and folded together; the report is that of all."""
    docs, folder = mixed_documents(spark, sf_dir), work_dir(spark, "summaries")
    for part in range(3):
        infer.path_summary(infer.document_paths(docs.filter(F.pmod(F.xxhash64("_id"), F.lit(3)) == part))).write.parquet(f"{folder}/part{part}")
    whole = infer.merge_summaries(*[spark.read.parquet(f"{folder}/part{part}") for part in range(3)])
    return infer.report_of(whole).join(infer.schema_of(whole), "path")


def d_family_tables(spark, sf_dir):
    saved = shape.save_families(
        table(spark, sf_dir, "orders"), ["o_orderkey"], {"hot": ["o_orderstatus"], "cold": ["o_orderpriority", "o_orderdate"]}, f"orders_{uuid.uuid4().hex}", work_dir(spark, "families"), buckets=8
    )
    return shape.join_families(spark, saved, ["o_orderkey"])


METRICS = "ts timestamp, value double, metric string, label_key string"


def metric_file_trip(spark, sf_dir):
    folder = f"{work_dir(spark, 'metrics')}/files"
    points = long(spark, sf_dir).select("ts", "value", "metric", "label_key", F.lit("base").alias("scenario"), F.length("metric").alias("test"), F.col("job").alias("instance"))
    metric_files.write_metrics(points, folder)
    return metric_files.read_metrics(spark, folder, METRICS)


def export_if_absent(spark, sf_dir):
    """A second export, of other rows, finds the files of the first."""
    path, orders = f"{work_dir(spark, 'absent')}/out", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    folder = loading.range_folder(F.col("o_custkey") % 1000, 950)
    done = [loading.export_csv_parts(rows, path, folder) for rows in (orders.filter("o_custkey % 1000 > 300"), orders)]
    found = loading.import_csv(spark, path, "o_orderkey bigint, o_custkey bigint, folder bigint")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total")).withColumn("written", F.concat(F.lit(str(len(done[0]))), F.lit("+"), F.lit(str(len(done[1])))))


def replace_load(spark, sf_dir):
    """Three tables loaded twice; the second load replaces the first, parents before children."""
    folder = work_dir(spark, "replace")
    tables = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")}
    parents = {"lineitem": ["orders"], "orders": ["customer"]}
    for share in (2, 1):
        frames = {"lineitem": tables["lineitem"].filter(f"l_orderkey % {share} = 0"), "orders": tables["orders"].filter(f"o_orderkey % {share} = 0"), "customer": tables["customer"].filter(f"c_custkey % {share} = 0")}
        order = loading.replace_tables(frames, parents, lambda n, df: df.write.mode("overwrite").parquet(f"{folder}/{n}"))
    return reduce(DataFrame.union, [spark.read.parquet(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), F.lit(i).alias("step"), "n_rows") for i, n in enumerate(order)])


def evolution_report(spark, sf_dir):
    old, new = evolve_frames(spark, sf_dir)
    told = catalog.evolution_report(old.withColumn("gone", F.lit("x")), new.withColumn("p_partkey", F.col("p_partkey").cast("string")), "part")
    return told.join(F.broadcast(table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n_rows"))))


def evolution_conflicts(spark, sf_dir):
    """Prices that lose digits, and brands that are longer than their column or no number."""
    part = table(spark, sf_dir, "part")
    old = part.select("p_partkey", F.col("p_retailprice").cast("decimal(12,1)").alias("price"), F.col("p_name").alias("name", metadata={"length": 20}), F.col("p_size").alias("size"))
    new = part.select("p_partkey", F.col("p_retailprice").cast("decimal(14,2)").alias("price"), "p_name", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("size")).withColumnRenamed("p_name", "name")
    return catalog.evolution_conflicts(old, new, ["p_partkey"])


def evolve_replace(spark, sf_dir):
    old, new = evolve_frames(spark, sf_dir)
    return catalog.evolve(old, new, "drop_and_apply").select("p_partkey", F.col("price").cast("double").alias("price"), "brand").unionByName(
        catalog.evolve(old, new, "generate_only").select("p_partkey", F.col("price").cast("double").alias("price")), allowMissingColumns=True
    )


def sample_members(spark, sf_dir):
    """What a random sample must be: its size, all different, all documents, the same again, and another one for another seed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"))
    size = 100
    one, same, other = (sample_documents(docs, size, "random", seed=s).select("_id") for s in (7, 7, 8))
    flat = lambda df: df.agg(F.array_sort(F.collect_set("_id")).alias("ids")).select("ids")
    whole = flat(one).withColumnRenamed("ids", "a").crossJoin(flat(same).withColumnRenamed("ids", "b")).crossJoin(flat(other).withColumnRenamed("ids", "c"))
    known = one.join(docs, "_id", "left_semi").agg(F.count(F.lit(1)).cast("int").alias("n_known"))
    return whole.crossJoin(known).select(F.size("a").alias("n"), "n_known", (F.col("a") == F.col("b")).alias("repeats"), (F.col("a") != F.col("c")).alias("differs"))


def select_named(spark, sf_dir):
    """Instances as a map of name to record; the chosen ones that have an address, joined to one map again."""
    nations = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("s_name", F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("10.0.0."), "s_suppkey")).alias("address"))))).alias("instances")
    )
    wanted = F.array(*[F.lit(f"Supplier#{n:09d}") for n in range(0, 1000, 2)])
    chosen = series.select_instances(nations, ["s_nationkey"], "instances", wanted)
    return chosen.select("s_nationkey", F.array_join(F.transform(F.map_entries("instances"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("list"))


QUERIES = {
    "quarantine_one_pass": (
        quarantine_one_pass,
        """SELECT event_id, reason, count(*) OVER (PARTITION BY reason) AS n_alike
        FROM (SELECT event_id, CASE WHEN NOT coalesce(value >= 5, false) THEN 'value is low' WHEN event_type = 'error' THEN 'type is error' ELSE 'good' END AS reason FROM events)""",
    ),
    "transforms_one_pass": (
        transforms_one_pass,
        """WITH c AS (SELECT 0 AS step, 'trim' AS op, 'text' AS path, count(text) AS matches, 0::BIGINT AS failures FROM documents
           UNION ALL SELECT 1, 'default_if_missing', 'lang2', count(*) FILTER (lang = 'fr'), 0 FROM documents
           UNION ALL SELECT 2, 'lower', 'missing', 0, 0
           UNION ALL SELECT 3, 'mask', 'words[]', CAST(sum(len(string_split(text, ' '))) AS BIGINT), 0 FROM documents
           UNION ALL SELECT 4, 'cast', 'lang2', count(*), count(*) FROM documents)
        SELECT *, (SELECT count(*) FROM documents) AS n_rows, 0::BIGINT AS n_casts FROM c""",
    ),
    "table_stats_sketch": (
        table_stats_sketch,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, 0::BIGINT AS n_nulls, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high,
            true AS distinct_is_near, true AS median_is_near, 0::INTEGER AS read_again FROM lineitem""" for c in ("l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_shipdate")
        ),
    ),
    "frequent_values": (frequent_values, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "infer_incremental": (
        infer_incremental,
        f"""WITH m AS ({MIXED_LABELS}) SELECT path, count(DISTINCT id) AS n_docs, count(*) AS n_nodes, count(*) FILTER (label = 'null') AS n_null,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'null'), '') AS labels, count(DISTINCT label) FILTER (label <> 'null') > 1 AS conflict,
            CASE path WHEN 'ints' THEN 'int64' WHEN 'num_str' THEN 'double' WHEN 'date_str' THEN 'date' WHEN 'bool_str' THEN 'string' WHEN 'flag' THEN 'bool' WHEN 'nothing' THEN 'string'
            WHEN 'wide' THEN 'decimal' WHEN 'box' THEN 'object' WHEN 'list' THEN 'array' WHEN 'list[]' THEN 'array' ELSE 'int32' END AS label FROM m GROUP BY path""",
    ),
    "d_family_tables": (d_family_tables, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"),
    "metric_file_trip": (metric_file_trip, POINTS + "SELECT ts, value, metric, label_key, 'base' AS scenario, length(metric)::INTEGER AS test, job AS instance FROM x"),
    "export_if_absent": (
        export_if_absent,
        """WITH f AS (SELECT o_orderkey, o_custkey % 1000 AS c, CAST(least(ceil((o_custkey % 1000) / 100) * 100, 950) AS BIGINT) AS folder FROM orders),
        a AS (SELECT DISTINCT folder FROM f WHERE c > 300)
        SELECT folder, count(*) AS n, sum(o_orderkey)::BIGINT AS total, (SELECT count(*) FROM a) || '+' || (SELECT count(DISTINCT folder) FROM f WHERE folder NOT IN (SELECT folder FROM a)) AS written
        FROM f GROUP BY folder""",
    ),
    "replace_load": (
        replace_load,
        """SELECT 'customer' AS name, 0 AS step, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', 1, count(*) FROM orders UNION ALL SELECT 'lineitem', 2, count(*) FROM lineitem""",
    ),
    "evolution_report": (
        evolution_report,
        """SELECT 'part' AS table_name, c AS column_name, a AS action, o AS current_type, n AS incoming_type, (SELECT count(*) FROM part) AS n_rows
        FROM (VALUES ('p_partkey', 'conflict', 'long', 'string'), ('price', 'widen', 'decimal(12,1)', 'decimal(14,2)'), ('brand', 'add', NULL, 'string'), ('gone', 'extra', 'string', NULL)) v(c, a, o, n)""",
    ),
    "evolution_conflicts": (
        evolution_conflicts,
        """WITH p AS (SELECT *, CAST(p_retailprice AS DECIMAL(14,2)) AS price FROM part)
        SELECT p_partkey, 'price' AS column_name, price::VARCHAR AS value FROM p WHERE CAST(price AS DECIMAL(12,1)) <> price
        UNION ALL SELECT p_partkey, 'name', p_name FROM p WHERE length(p_name) > 20 UNION ALL SELECT p_partkey, 'size', p_brand FROM p WHERE p_size % 3 = 0""",
    ),
    "evolve_replace": (
        evolve_replace,
        """SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS DOUBLE) AS price, p_brand AS brand FROM part WHERE p_partkey % 2 = 1
        UNION ALL SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS DOUBLE), NULL FROM part WHERE p_partkey % 2 = 0""",
    ),
    "sample_members": (sample_members, "SELECT least(count(*), 100)::INTEGER AS n, least(count(*), 100)::INTEGER AS n_known, true AS repeats, true AS differs FROM documents"),
    "select_named": (
        select_named,
        """SELECT s_nationkey, string_agg(s_name || '=10.0.0.' || s_suppkey, ',' ORDER BY s_name) AS list FROM supplier
        WHERE s_suppkey % 3 > 0 AND s_name IN (SELECT 'Supplier#' || lpad(n::VARCHAR, 9, '0') FROM range(0, 1000, 2) t(n)) GROUP BY 1""",
    ),
}
