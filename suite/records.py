"""Queries on integrity, catalogs, schema evolution, loading, time series, the ledger and plan records."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaykit.functions import sqltypes
from relaykit.functions.naming import identifier
from relaykit.operators import catalog, integrity, ledger, series
from relaykit.session import work_dir
from relaykit.sources import loading
from relaykit.sources.documents import filter_documents, sample_documents
from suite.inputs import ORDER_OID, money, order_documents, table


def on(name, make):
    return lambda spark, sf_dir: make(table(spark, sf_dir, name))


# ---- integrity ----------------------------------------------------------------------------------------------------

CHECKS = {"total": "o_totalprice < 300000", "priority": "o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')", "status": "length(o_orderstatus) = 1"}


def fk_orphans(spark, sf_dir):
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
             ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
    found = None
    for child, column, parent, key in links:
        parents = table(spark, sf_dir, parent).filter(F.col(key) % 10 != 3)
        part = integrity.orphans(table(spark, sf_dir, child).select(column), parents, [column], [key])
        part = part.select(F.lit(f"{child}.{column}").alias("link"), F.col(column).cast("bigint").alias("key")).groupBy("link", "key").agg(F.count(F.lit(1)).alias("n"))
        found = part if found is None else found.union(part)
    return found


def _orphan_sql(child, column, parent, key):
    return f"SELECT '{child}.{column}' AS link, {column}::BIGINT AS key, count(*) AS n FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {key} % 10 <> 3) GROUP BY 2"


def cascade_delete(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    links = [("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"])]
    victims = tables["customer"].filter("c_custkey % 7 = 0").select("c_custkey")
    left = integrity.delete_cascading(tables, links, "customer", victims, ["c_custkey"])
    out = None
    for name, column in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        part = left[name].groupBy(F.lit(name).alias("part"), (F.col(column) % 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


# ---- catalogs -----------------------------------------------------------------------------------------------------

TYPES = [*sqltypes.SOURCE_TYPES, "geography"]


def catalog_rows(spark, sf_dir):
    types = ", ".join(f"'{t}'" for t in TYPES)
    return table(spark, sf_dir, "part").selectExpr(
        "concat('Table-', p_size) as table_name", "p_partkey as ordinal_position",
        "case when p_partkey % 50 = 0 then '__' else concat(' ', p_brand, '/', p_type, ' ') end as column_name",
        f"element_at(array({types}), cast(p_partkey % {len(TYPES)} as int) + 1) as data_type",
        "case when p_partkey % 3 > 0 then cast(p_partkey % 30 + 1 as int) end as numeric_precision", "case when p_partkey % 3 = 2 then cast(p_size % 5 as int) end as numeric_scale",
        "case when p_partkey % 2 = 0 then 'YES' else 'NO' end as is_nullable",
    )


_NAME = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '^_+', ''), '_+$', '')"
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sqltypes.SOURCE_TYPES.items())
CATALOG = f"""WITH r AS (
    SELECT 'Table-' || p_size AS table_name, p_partkey AS ordinal_position, CASE WHEN p_partkey % 50 = 0 THEN '__' ELSE ' ' || p_brand || '/' || p_type || ' ' END AS column_name,
           [{', '.join(f"'{t}'" for t in TYPES)}][(p_partkey % {len(TYPES)})::INT + 1] AS data_type,
           CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 30 + 1 END AS pr, CASE WHEN p_partkey % 3 = 2 THEN p_size % 5 END AS sc,
           CASE WHEN p_partkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable FROM part),
c AS (SELECT *, coalesce(nullif({_NAME.format('column_name')}, ''), 'unnamed_column') AS plain, coalesce(CASE lower(data_type) {_CASES} END, 'STRING') AS mapped FROM r),
d AS (
    SELECT *, CASE WHEN k = 1 THEN plain ELSE plain || '_' || k END AS target_name,
           CASE WHEN mapped = 'DECIMAL' AND pr IS NOT NULL THEN 'DECIMAL(' || pr || CASE WHEN sc IS NOT NULL THEN ',' || sc ELSE '' END || ')' ELSE mapped END AS target_type
    FROM (SELECT *, row_number() OVER (PARTITION BY table_name, plain ORDER BY ordinal_position, column_name) AS k FROM c))
"""


def schema_diff(spark, sf_dir):
    base = table(spark, sf_dir, "part").selectExpr("concat('t', p_size) as table_name", "concat('c', p_partkey) as column_name", "p_brand as kind", "cast(p_partkey % 40 as int) as size", "cast(0 as int) as scale", "p_partkey as k")
    old = base.filter("k % 7 <> 0").drop("k")
    new = base.filter("k % 5 <> 0").withColumn("size", F.expr("cast(case when k % 3 = 0 then size + 5 else size end as int)")).withColumn("kind", F.expr("case when k % 11 = 0 then 'other' else kind end")).drop("k")
    return catalog.schema_diff(old, new)


def evolve_frames(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 2 = 0").selectExpr("p_partkey", "cast(p_retailprice as decimal(12,1)) as price")
    new = part.filter("p_partkey % 2 = 1").selectExpr("p_partkey", "cast(p_retailprice as decimal(14,2)) as price", "p_brand as brand")
    return old, new


def evolved(mode):
    def query(spark, sf_dir):
        return catalog.evolve(*evolve_frames(spark, sf_dir), mode).withColumn("price", F.col("price").cast("double"))

    return query


EVOLVED = """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS DECIMAL(12,1)) ELSE {} END AS DOUBLE) AS price,
    CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS brand FROM part"""

# ---- loading ------------------------------------------------------------------------------------------------------


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "1L as version")


def changed_customers(spark, sf_dir):
    """An update of every fifth key, its replay, a stale version, and new keys."""
    base = customers(spark, sf_dir)
    update = base.filter("c_custkey % 5 = 0").selectExpr("c_custkey", "concat(c_name, ' new') as c_name", "3L as version")
    stale = base.filter("c_custkey % 10 = 0").selectExpr("c_custkey", "'stale' as c_name", "2L as version")
    fresh = base.filter("c_custkey % 50 = 0").selectExpr("-c_custkey - 1 as c_custkey", "c_name", "1L as version")
    return update.union(update).union(stale).union(fresh).withColumn("ignored", F.lit(1))


UPSERTED = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' new' ELSE c_name END AS c_name, c_mktsegment,
    CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS version FROM customer
    UNION ALL SELECT -c_custkey - 1, c_name, NULL, 1::BIGINT FROM customer WHERE c_custkey % 50 = 0"""


def quarantine_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    good, bad = loading.quarantine(events, {"value is low": "value >= 5", "type is error": "event_type <> 'error'"})
    return good.selectExpr("event_id", "cast(null as string) as reason").union(
        bad.select(F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"), "reason")
    )


def csv_round_trip(spark, sf_dir):
    path = work_dir(spark, "csv")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    loading.export_csv(orders, path, loading.range_folder(F.col("o_custkey") % 1000, 950))
    read = loading.import_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, folder bigint")
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "folder")


def manifest_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    expected = orders.select((F.col("o_custkey") % 500).alias("part"), "o_orderpriority").distinct()
    return loading.missing_parts(expected, orders.filter("o_orderkey % 3 = 0").select((F.col("o_custkey") % 500).alias("part"), "o_orderpriority").distinct(), ["part", "o_orderpriority"])


def cdc_apply(spark, sf_dir):
    base = customers(spark, sf_dir).drop("version", "c_mktsegment")
    events = table(spark, sf_dir, "events").selectExpr(
        "user_id as c_custkey", "concat('name ', event_id) as c_name", "event_id as position", "case when event_type = 'error' then 'delete' when event_type = 'signup' then 'insert' else 'update' end as op"
    )
    return loading.apply_changes(base, events, ["c_custkey"], "position", "op")


# ---- time series --------------------------------------------------------------------------------------------------

def responses(spark, sf_dir):
    """Range-query responses, one per day, from the sums of events in steps of 15 seconds."""
    points = table(spark, sf_dir, "events").selectExpr(
        "event_type as metric", "case when user_id % 2 = 0 then 'node' else 'db' end as job", "cast(user_id % 3 as string) as user", "floor(unix_timestamp(ts) / 15) * 15 as at", f"{money('value')} as v"
    ).groupBy("metric", "job", "user", "at").agg(F.sum("v").alias("v"))
    rows = points.groupBy("metric", "job", "user", F.floor(F.col("at") / 86400).alias("day")).agg(
        F.sort_array(F.collect_list(F.array(F.col("at").cast("string"), F.col("v").cast("string")))).alias("values")
    )
    one = F.struct(F.create_map(F.lit("__name__"), "metric", F.lit("job"), "job", F.lit("instance"), F.lit("i1"), F.lit("user"), "user").alias("metric"), F.col("values"))
    return rows.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(one).alias("result")).alias("data"))).alias("response"))


def long(spark, sf_dir):
    return series.matrix_to_long(responses(spark, sf_dir)).withColumn("label_key", F.col("labels")["user"])


POINTS = f"""WITH x AS (
    SELECT event_type AS metric, CASE WHEN user_id % 2 = 0 THEN 'node' ELSE 'db' END AS job, (user_id % 3)::VARCHAR AS label_key,
           make_timestamp((floor(epoch(ts) / 15) * 15)::BIGINT * 1000000) AS ts, CAST(sum({money('value')}) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3, 4)
"""
NUMBERED = POINTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY metric, job ORDER BY label_key) AS series_no,
        metric || '_' || job || '_' || row_number() OVER (PARTITION BY metric, job ORDER BY label_key) || CASE WHEN row_number() OVER (PARTITION BY metric ORDER BY job, label_key) = 1 THEN '$' ELSE '' END AS field
    FROM (SELECT DISTINCT metric, job, label_key FROM x))
"""
FIELDS = ["click_db_1$", "click_db_2", "click_node_1", "view_db_1$", "error_node_3"]


def m_grid(spark, sf_dir):
    points = long(spark, sf_dir).select("metric", "job", "label_key", "ts", "value")
    bounds = points.agg(F.min("ts").cast("string").alias("a"), F.max("ts").cast("string").alias("b")).first()
    return series.regular_grid(points, ["metric", "job", "label_key"], bounds["a"], bounds["b"])


def monitor(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('host', user_id % 4) as actorHostname", "event_type as sourceName", "concat('to ', event_type) as destinationName", "user_id as queuedCount",
        "event_type = 'error' and user_id % 2 = 0 as isBackPressureEnabled", "user_id % 3 as connectedNodeCount", "2L as totalNodeCount",
        "unix_millis(cast(ts as timestamp)) as flowStartDate", "unix_millis(cast(ts as timestamp)) + cast(value as bigint) as flowCompletion",
        "to_json(struct(case event_type when 'error' then 'ERROR' when 'click' then 'WARNING' else 'INFO' end as bulletinLevel, concat('m ', event_id) as bulletinMessage)) as content",
    )


# ---- ledger -------------------------------------------------------------------------------------------------------


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as run_id", "case o_orderstatus when 'F' then 'finished' when 'O' then 'running' else 'pending' end as status", "o_orderdate as started_at",
        "case when o_orderstatus = 'F' then o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 5000) end as finished_at",
    )


RUNS = """WITH r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_orderdate AS started_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 5000) END AS finished_at FROM orders)
"""
def statements(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as run_id", "case when l_linenumber % 2 = 0 then 'post' else 'pre' end as phase",
        "case l_returnflag when 'R' then 'error' else 'applied' end as status", "l_suppkey % 3 as retries", "l_shipdate as started_at",
        "l_shipdate + make_dt_interval(0, 0, 0, l_partkey % 100) as finished_at",
    )


def snapshots(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as run_id", "case l_linestatus when 'O' then 'running' else 'done' end as status", "cast(l_quantity as bigint) as rows_copied", "l_shipdate as started_at",
        "l_shipdate + make_dt_interval(0, 0, 0, l_partkey % 100) as updated_at",
    )


def states(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as run_id", "l_suppkey % 5 as object", "case when l_linenumber % 2 = 0 then 'after' else 'before' end as side", "l_returnflag as state", "l_shipdate as noted_at"
    )


def streams(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 10 as run_id", "event_type as stream", "event_type <> 'error' as active", "1L as n_events", "cast(length(props) as bigint) as n_bytes", "event_id as position", "ts as high_watermark"
    )


def log(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id % 10 as run_id", "event_id", "ts", "case event_type when 'error' then 'error' when 'click' then 'warning' else 'info' end as level")


QUERIES = {
    "fk_orphans": (fk_orphans, " UNION ALL ".join([
        _orphan_sql("orders", "o_custkey", "customer", "c_custkey"), _orphan_sql("lineitem", "l_orderkey", "orders", "o_orderkey"), _orphan_sql("lineitem", "l_partkey", "part", "p_partkey"),
        _orphan_sql("lineitem", "l_suppkey", "supplier", "s_suppkey"), _orphan_sql("customer", "c_nationkey", "nation", "n_nationkey")])),
    "unique_violations": (
        on("lineitem", lambda t: integrity.duplicates(t, ["l_orderkey", "l_linenumber"])),
        "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "constraint_violations": (
        on("orders", lambda t: integrity.violations(t, CHECKS, ["o_orderkey"])),
        " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule FROM orders WHERE NOT ({c})" for n, c in CHECKS.items()),
    ),
    "cascade_delete": (
        cascade_delete,
        """SELECT 'customer' AS part, c_custkey % 100 AS bucket, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 2
        UNION ALL SELECT 'orders', o_orderkey % 100, count(*) FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 2
        UNION ALL SELECT 'lineitem', l_orderkey % 100, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 7 <> 0 GROUP BY 2""",
    ),
    "cat_identifiers": (lambda s, d: catalog_rows(s, d).select("ordinal_position", identifier(F.col("column_name")).alias("name")), CATALOG + "SELECT ordinal_position, plain AS name FROM d"),
    "cat_dedupe": (lambda s, d: catalog.add_target_names(catalog_rows(s, d)).select("table_name", "ordinal_position", "target_name"), CATALOG + "SELECT table_name, ordinal_position, target_name FROM d"),
    "cat_type_map": (lambda s, d: catalog.add_target_types(catalog_rows(s, d)).select("ordinal_position", "data_type", "target_type"), CATALOG + "SELECT ordinal_position, data_type, target_type FROM d"),
    "cat_table_ddl": (
        lambda s, d: catalog.table_ddl(catalog.add_target_types(catalog.add_target_names(catalog_rows(s, d)))),
        CATALOG + r"""SELECT table_name, 'CREATE TABLE IF NOT EXISTS ' || replace(lower(table_name), '-', '_') || E' (\n' || string_agg('  ' || target_name || ' ' || target_type || CASE WHEN is_nullable = 'NO' THEN ' NOT NULL' ELSE '' END,
            E',\n' ORDER BY ordinal_position) || E'\n);' AS ddl FROM d GROUP BY table_name""",
    ),
    "schema_diff": (
        schema_diff,
        """SELECT 't' || p_size AS table_name, 'c' || p_partkey AS column_name, CASE WHEN p_partkey % 7 = 0 THEN 'add' WHEN p_partkey % 5 = 0 THEN 'extra' WHEN p_partkey % 11 = 0 THEN 'conflict'
            WHEN p_partkey % 3 = 0 THEN 'widen' ELSE 'keep' END AS action FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 5 = 0)""",
    ),
    "evolve_additive": (evolved("apply_new_only"), EVOLVED.format("CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS DECIMAL(12,1))")),
    "evolve_widen": (evolved("apply_and_update_existing"), EVOLVED.format("CAST(p_retailprice AS DECIMAL(14,2))")),
    "doc_filter": (
        lambda s, d: filter_documents(order_documents(s, d), {"status": {"$in": ["NEW", "PAID"]}, "amounts.total": {"$gt": 200000}, "createdAt": {"$gte": {"$date": "1996-01-01T02:00:00+02:00"}}}).select("_id"),
        f"""SELECT {ORDER_OID} AS _id FROM orders LEFT JOIN (SELECT l_orderkey AS k, sum({money('l_extendedprice')}) AS sub FROM lineitem GROUP BY 1) ON k = o_orderkey
        WHERE o_orderkey % 5 < 2 AND o_orderdate >= TIMESTAMP '1996-01-01' AND coalesce(CAST(sub AS DECIMAL(18,2)), 0) + CAST(round(coalesce(CAST(sub AS DECIMAL(18,2)), 0) * 0.08, 2) AS DECIMAL(18,2)) + CASE WHEN sub > 100 THEN 0 ELSE 5.99 END > 200000""",
    ),
    "sample_prefix": (lambda s, d: sample_documents(order_documents(s, d), 1000, "prefix").select("_id"), f"SELECT {ORDER_OID} AS _id FROM orders ORDER BY 1 LIMIT 1000"),
    "sample_time_window": (
        on("orders", lambda t: sample_documents(t, 500, "time_window", time_col="o_orderdate", window=("1996-01-01", "1997-01-01"), id_col="o_orderkey").select("o_orderkey")),
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' ORDER BY 1 LIMIT 500",
    ),
    "sample_random": (lambda s, d: sample_documents(order_documents(s, d), 1000, "random", seed=7).select("_id"), None),
    "incremental_load": (
        on("customer", lambda t: loading.read_incremental(t, {"c_custkey": 40}, ["c_custkey", "c_name"])), "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40"
    ),
    "upsert_merge": (lambda s, d: loading.upsert(customers(s, d), changed_customers(s, d), ["c_custkey"], "version"), UPSERTED),
    "quarantine_split": (
        quarantine_split,
        "SELECT event_id, CASE WHEN NOT coalesce(value >= 5, false) THEN 'value is low' WHEN event_type = 'error' THEN 'type is error' END AS reason FROM events",
    ),
    "epoch_millis_repair": (
        on("events", lambda t: t.selectExpr("event_id", "case event_id % 3 when 0 then cast(unix_millis(cast(ts as timestamp)) as string) when 1 then date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") else event_type end as w")
           .select("event_id", loading.repair_epoch_millis(F.col("w")).alias("ts"))),
        "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('milliseconds', ts) END AS ts FROM events",
    ),
    "range_partition_assign": (
        on("orders", lambda t: t.select("o_orderkey", loading.range_folder(F.col("o_custkey") % 1000, 950).alias("folder"))),
        "SELECT o_orderkey, CAST(least(ceil((o_custkey % 1000) / 100) * 100, 950) AS BIGINT) AS folder FROM orders",
    ),
    "csv_round_trip": (csv_round_trip, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(least(ceil((o_custkey % 1000) / 100) * 100, 950) AS BIGINT) AS folder FROM orders"),
    "manifest_missing": (
        manifest_missing,
        "SELECT DISTINCT o_custkey % 500 AS part, o_orderpriority FROM orders EXCEPT SELECT o_custkey % 500, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0",
    ),
    "table_stats": (
        on("orders", lambda t: loading.table_statistics(t, ["o_custkey", "o_orderstatus", "o_orderpriority"], exact=True)),
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_nulls, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM orders"
                           for c in ("o_custkey", "o_orderstatus", "o_orderpriority")),
    ),
    "json_path_extract": (
        on("events", lambda t: t.select("event_id", *loading.json_parameters(F.col("props"), {"k": "$.k", "absent": "$.a.b"}))),
        "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS absent FROM events",
    ),
    "cdc_apply_final": (
        cdc_apply,
        """WITH e AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e) UNION ALL SELECT user_id, 'name ' || event_id FROM e WHERE event_type <> 'error'""",
    ),
    "m_long": (lambda s, d: long(s, d).select("metric", "job", "label_key", "ts", "value"), POINTS + "SELECT * FROM x"),
    "m_series_no": (
        lambda s, d: series.number_series(long(s, d)).select("metric", "job", "label_key", "ts", "series_no", "field"),
        NUMBERED + "SELECT metric, job, label_key, ts, series_no::INTEGER AS series_no, field FROM x JOIN n USING (metric, job, label_key)",
    ),
    "m_pivot": (
        lambda s, d: series.long_to_wide(series.number_series(long(s, d)), FIELDS),
        NUMBERED + "SELECT ts, " + ", ".join(f"max(value) FILTER (field = '{f}') AS \"{f}\"" for f in FIELDS) + " FROM x JOIN n USING (metric, job, label_key) GROUP BY ts",
    ),
    "m_labels": (
        lambda s, d: series.label_columns(series.matrix_to_long(responses(s, d)), ["user"], scenario="base", test=1),
        POINTS + "SELECT metric, job, ts, value, label_key AS \"user\", 'base' AS scenario, 1 AS test FROM x",
    ),
    "m_grid": (
        m_grid,
        POINTS + """, b AS (SELECT floor(epoch(min(ts)) / 15)::BIGINT * 15 AS a, floor(epoch(max(ts)) / 15)::BIGINT * 15 AS z FROM x),
        k AS (SELECT DISTINCT metric, job, label_key FROM x), g AS (SELECT metric, job, label_key, unnest(range(a, z + 15, 15)) AS step FROM k, b),
        p AS (SELECT metric, job, label_key, floor(epoch(ts) / 15)::BIGINT * 15 AS step, max_by(value, ts) AS value FROM x GROUP BY ALL)
        SELECT g.metric, g.job, g.label_key, make_timestamp(g.step * 1000000) AS ts, last_value(value IGNORE NULLS) OVER (PARTITION BY g.metric, g.job, g.label_key ORDER BY g.step) AS value
        FROM g LEFT JOIN p USING (metric, job, label_key, step)""",
    ),
    "alert_latency": (lambda s, d: series.slow_records(monitor(s, d), "flowStartDate", "flowCompletion").select("event_id", "millis"), "SELECT event_id, CAST(trunc(value) AS BIGINT) AS millis FROM events WHERE trunc(value) > 50"),
    "alert_back_pressure": (
        lambda s, d: series.back_pressure(monitor(s, d)).select("event_id", "message"),
        "SELECT event_id, 'host' || user_id % 4 || ': ' || event_type || ' to to ' || event_type || ' holds ' || user_id AS message FROM events WHERE event_type = 'error' AND user_id % 2 = 0",
    ),
    "alert_node_down": (lambda s, d: series.nodes_down(monitor(s, d)).select("event_id", "connectedNodeCount"), 'SELECT event_id, user_id % 3 AS "connectedNodeCount" FROM events WHERE user_id % 3 <> 2'),
    "alert_bulletin": (
        lambda s, d: series.bulletins(monitor(s, d).select("event_id", "content")),
        """SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS "bulletinLevel", 'm ' || event_id AS "bulletinMessage", NULL::VARCHAR AS "bulletinTimestamp" FROM events WHERE event_type IN ('error', 'click')""",
    ),
    "split_records": (
        on("events", lambda t: series.split_records(t.selectExpr("event_id", "case when event_id % 2 = 0 then concat('[', props, ',', props, ']') else props end as j"), "j", ["event_id"]).select("event_id", "position", F.get_json_object("record", "$.k").cast("bigint").alias("k"))),
        "SELECT event_id, 0 AS position, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, 1, CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_id % 2 = 0",
    ),
    "rate_cap": (
        on("events", lambda t: series.rate_cap(t.select("event_id", "ts", "event_type"), ["event_type"], seconds=600)),
        "SELECT event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 600) ORDER BY ts, event_id) = 1",
    ),
    "ledger_runs": (lambda s, d: ledger.runs_by_status(runs(s, d), ["running", "pending"]).select("run_id", "status", "started_at"), RUNS + "SELECT run_id, status, started_at FROM r WHERE status <> 'finished'"),
    "ledger_finished": (lambda s, d: ledger.finished_runs(runs(s, d)).select("run_id", "seconds"), RUNS + "SELECT run_id, (run_id % 5000)::BIGINT AS seconds FROM r WHERE status = 'finished'"),
    "ledger_statements": (
        lambda s, d: ledger.statement_outcome(statements(s, d)),
        """SELECT l_orderkey AS run_id, CASE WHEN l_linenumber % 2 = 0 THEN 'post' ELSE 'pre' END AS phase, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS applied, sum(l_suppkey % 3)::BIGINT AS retries,
        count(*) FILTER (l_returnflag = 'R') AS errors, (epoch(max(l_shipdate + to_seconds(l_partkey % 100))) - epoch(min(l_shipdate)))::BIGINT AS seconds FROM lineitem GROUP BY 1, 2""",
    ),
    "ledger_objects": (
        lambda s, d: ledger.changed_objects(states(s, d)),
        """WITH s AS (SELECT l_orderkey AS run_id, l_suppkey % 5 AS object, max_by(l_returnflag, (l_shipdate, l_returnflag)) FILTER (l_linenumber % 2 = 1) AS before,
            max_by(l_returnflag, (l_shipdate, l_returnflag)) FILTER (l_linenumber % 2 = 0) AS after FROM lineitem GROUP BY 1, 2) SELECT * FROM s WHERE before IS DISTINCT FROM after""",
    ),
    "ledger_snapshots": (
        lambda s, d: ledger.active_snapshots(snapshots(s, d)),
        """WITH s AS (SELECT l_orderkey AS run_id, count(*) AS n_snapshots, sum(l_quantity::BIGINT)::BIGINT AS rows_copied, sum(l_partkey % 100)::BIGINT AS seconds FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
        SELECT *, CASE WHEN seconds > 0 THEN rows_copied / seconds END AS rate FROM s""",
    ),
    "ledger_cdc": (
        lambda s, d: ledger.stream_progress(streams(s, d)),
        """WITH h AS (SELECT user_id % 10 AS run_id, max(ts) AS high FROM events GROUP BY 1)
        SELECT run_id, event_type AS stream, count(*) AS n_events, sum(length(props))::BIGINT AS n_bytes, max(event_id) AS resume_at, (floor(epoch(any_value(high))) - floor(epoch(max(ts))))::BIGINT AS lag_seconds
        FROM events JOIN h ON run_id = user_id % 10 WHERE event_type <> 'error' GROUP BY 1, 2""",
    ),
    "ledger_events": (
        lambda s, d: ledger.newest_events(log(s, d), ["error", "warning"]).select("run_id", "event_id", "level"),
        """SELECT user_id % 10 AS run_id, event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS level FROM events WHERE event_type IN ('error', 'click')
        QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) <= 20""",
    ),
    "map_to_rows": (
        on("events", lambda t: series.map_to_rows(t, ["event_id"], F.from_json("props", "map<string,string>"), "name", "value")),
        "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events",
    ),
    "list_to_rows": (
        on("documents", lambda t: series.list_to_rows(t.selectExpr("doc_id", "source", "concat_ws(',', lang, source) as parts"), ["doc_id"], "parts", "source")),
        "SELECT doc_id, source, source || '-0' AS item, lang AS value FROM documents UNION ALL SELECT doc_id, source, source || '-1', source FROM documents",
    ),
    "rows_to_list": (
        on("orders", lambda t: series.rows_to_list(t, ["o_custkey"], "o_orderpriority")),
        "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS list FROM orders GROUP BY 1",
    ),
    "select_instances": (
        on("supplier", lambda t: t.filter("s_suppkey % 4 > 0").selectExpr("s_nationkey", "concat(s_name, '=', case when s_suppkey % 3 > 0 then concat('10.0.0.', s_suppkey) end) as item")
           .filter("item is not null").transform(lambda x: series.rows_to_list(x, ["s_nationkey"], "item"))),
        "SELECT s_nationkey, string_agg(DISTINCT s_name || '=10.0.0.' || s_suppkey, ',' ORDER BY s_name || '=10.0.0.' || s_suppkey) AS list FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 3 > 0 GROUP BY 1",
    ),
}
