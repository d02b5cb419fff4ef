"""Schema inference and validation on order, event and mixed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaykit.operators import infer, validate
from suite.inputs import ORDER_OID, article_documents, order_documents, order_structs, table
from suite.schemas import ARTICLE_SCHEMA, ORDER_SCHEMA

# Paths of an order document that every document has once, with their labels.
ORDER_PATHS = {
    "_id": "objectId", "orderId": "string", "customer": "object", "customer.id": "string", "customer.email": "string",
    "customer.name": "string", "customer.loyaltyTier": "string", "items": "array", "currency": "string", "amounts": "object",
    "amounts.subtotal": "decimal", "amounts.tax": "decimal", "amounts.shipping": "decimal", "amounts.total": "decimal",
    "status": "string", "shipping": "object", "shipping.address": "object", "shipping.address.line1": "string",
    "shipping.address.city": "string", "shipping.address.region": "string", "shipping.address.country": "string",
    "shipping.address.postalCode": "string", "shipping.location": "object", "shipping.location.type": "string",
    "shipping.location.coordinates": "array", "tags": "array", "metadata": "object", "metadata.source": "string",
    "metadata.ip": "string", "payment": "object", "payment.method": "string", "createdAt": "date", "updatedAt": "date",
    "version": "int32",
}
ITEM_PATHS = {"items[]": "object", "items[].sku": "string", "items[].name": "string", "items[].qty": "int32", "items[].unitPrice": "decimal"}


def _rows(paths: dict[str, str]) -> str:
    return ", ".join(f"('{p}', '{label}')" for p, label in paths.items())


ORDER_LABELS = f"""SELECT p AS path, lb AS label, n AS n_docs, n AS n_nodes FROM (VALUES {_rows(ORDER_PATHS)}) v(p, lb), (SELECT count(*) AS n FROM orders)
    UNION ALL SELECT p, lb, d, n FROM (VALUES {_rows(ITEM_PATHS)}) v(p, lb), (SELECT count(DISTINCT l_orderkey) AS d, count(*) AS n FROM lineitem)
    UNION ALL SELECT 'items[].discount', CASE WHEN l_discount > 0 THEN 'decimal' ELSE 'null' END, count(DISTINCT l_orderkey), count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'shipping.address.line2', CASE WHEN o_orderkey % 5 = 0 THEN 'string' ELSE 'null' END, count(*), count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'payment.last4', CASE WHEN o_orderkey % 3 = 0 THEN 'string' ELSE 'null' END, count(*), count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'shipping.location.coordinates[]', 'double', count(*), 2 * count(*) FROM orders
    UNION ALL SELECT 'tags[]', 'string', count(*), count(*) FROM orders WHERE o_orderpriority = '1-URGENT'"""

SQL_TYPES = """CASE label WHEN 'objectId' THEN 'STRING(24)' WHEN 'string' THEN 'STRING(1024)' WHEN 'bool' THEN 'BOOL' WHEN 'int32' THEN 'INT4'
    WHEN 'int64' THEN 'INT8' WHEN 'double' THEN 'REAL' WHEN 'decimal' THEN 'DECIMAL(38,9)' WHEN 'date' THEN 'TIMESTAMP' ELSE 'JSON' END"""

# One document per event, whose fields change type from row to row. Text is the same JSON in both engines.
MIXED = """concat('{"ints":', if(event_id % 2 = 0, '2147483647', '2147483648'), ',"num_str":', if(event_id % 7 = 0, '"x"', '1.5'),
    ',"date_str":', if(event_id % 3 = 0, '"2024-01-01T00:00:00Z"', '"later"'), ',"bool_str":', if(event_id % 3 = 1, 'true', '"no"'),
    ',"flag":true,"nothing":null,"wide":', if(event_id % 2 = 0, '{"$numberDecimal":"9.50"}', '1e3'),
    ',"box":', if(event_id % 4 = 0, '{}', if(event_id % 4 = 1, '[]', '3')), ',"list":[[1],', if(event_id % 2 = 0, '"671f00000000000000000000"', 'null'), ']',
    if(event_id % 5 = 0, ',"sometimes":7', ''), '}')"""


def mixed_documents(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("_id"), F.try_parse_json(F.expr(MIXED)).alias("doc"))


MIXED_LABELS = """SELECT 'ints' AS path, CASE WHEN event_id % 2 = 0 THEN 'int32' ELSE 'int64' END AS label, event_id AS id FROM events
    UNION ALL SELECT 'num_str', CASE WHEN event_id % 7 = 0 THEN 'string' ELSE 'double' END, event_id FROM events
    UNION ALL SELECT 'date_str', CASE WHEN event_id % 3 = 0 THEN 'date' ELSE 'string' END, event_id FROM events
    UNION ALL SELECT 'bool_str', CASE WHEN event_id % 3 = 1 THEN 'bool' ELSE 'string' END, event_id FROM events
    UNION ALL SELECT 'flag', 'bool', event_id FROM events UNION ALL SELECT 'nothing', 'null', event_id FROM events
    UNION ALL SELECT 'wide', CASE WHEN event_id % 2 = 0 THEN 'decimal' ELSE 'double' END, event_id FROM events
    UNION ALL SELECT 'box', CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' ELSE 'int32' END, event_id FROM events
    UNION ALL SELECT 'list', 'array', event_id FROM events UNION ALL SELECT 'list[]', 'array', event_id FROM events
    UNION ALL SELECT 'list[]', CASE WHEN event_id % 2 = 0 THEN 'objectId' ELSE 'null' END, event_id FROM events
    UNION ALL SELECT 'sometimes', 'int32', event_id FROM events WHERE event_id % 5 = 0"""

# Strings of all label kinds, whole texts included.
STRINGS = """case cast(doc_id % 6 as int) when 0 then lower(lpad(hex(doc_id), 24, 'a')) when 1 then concat('2024-01-', lpad(doc_id % 28 + 1, 2, '0'))
    when 2 then concat('2024-01-01T10:00:00.', doc_id % 1000000, '+02:00') when 3 then concat('2024-01-01 10:00:00 ', doc_id)
    when 4 then text else lang end"""
STRINGS_SQL = """CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN lower(lpad(to_hex(doc_id), 24, 'a')) WHEN 1 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')
    WHEN 2 THEN '2024-01-01T10:00:00.' || (doc_id % 1000000) || '+02:00' WHEN 3 THEN '2024-01-01 10:00:00 ' || doc_id WHEN 4 THEN text ELSE lang END"""

WRAPPED = """concat('{"v":', case cast(event_id % 9 as int) when 0 then concat('{"$oid":"', lower(lpad(hex(event_id), 24, '0')), '"}')
    when 1 then '{"$date":{"$numberLong":"1700000000000"}}' when 2 then '{"$timestamp":{"t":1,"i":2}}' when 3 then '{"$numberInt":"5"}'
    when 4 then '{"$numberLong":"5"}' when 5 then '{"$numberDouble":"5.5"}' when 6 then concat('{"$numberDecimal":"', value, '"}')
    when 7 then '{"$oid":"short"}' else '{"$numberDecimal":5,"more":1}' end, ',"a":[{"$numberLong":"', event_id, '"}]}')"""


def wrapper_documents(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.try_parse_json(F.expr(WRAPPED)).alias("doc"))


def broken_orders(spark, sf_dir):
    """Order documents with rules broken on purpose; orders without lines break the item minimum by themselves."""
    key = F.conv(F.substring("_id", 13, 12), 16, 10).cast("bigint")
    doc = F.col("doc")
    item = lambda x, i: F.when((key % 11 == 2) & (i == 0), x.withField("qty", F.lit(0))).otherwise(x)
    changed = (
        doc.withField("currency", F.when(key % 11 == 0, "XXX").otherwise(doc["currency"]))
        .withField("customer.email", F.when(key % 11 == 1, "no-mail").otherwise(doc["customer"]["email"]))
        .withField("items", F.transform(doc["items"], item))
        .withField("version", F.when(key % 11 == 3, "one").otherwise(F.lit("1")))
        .withField("shipping.location.coordinates", F.when(key % 11 == 4, F.array(F.lit(1.5))).otherwise(doc["shipping"]["location"]["coordinates"]))
    )
    text = F.regexp_replace(F.to_json(changed, {"ignoreNullFields": "false"}), '"version":"1"', '"version":1')
    text = F.when(key % 11 == 5, F.regexp_replace(text, r"\}$", ',"extra":1}')).when(key % 11 == 6, F.regexp_replace(text, '"status":"[A-Z]+",', "")).otherwise(text)
    return order_structs(spark, sf_dir).select("_id", F.parse_json(text).alias("doc"))


def validate_docs(spark, sf_dir):
    return validate.violations(broken_orders(spark, sf_dir), ORDER_SCHEMA)


def validate_split(spark, sf_dir):
    return validate.outcomes(broken_orders(spark, sf_dir), ORDER_SCHEMA).select("_id", "outcome")


def validate_articles(spark, sf_dir):
    """Every fourth article lacks its title; all name their order by plain text where an object id is declared."""
    docs = article_documents(spark, sf_dir)
    bad = docs.withColumn("doc", F.when(F.conv(F.right("_id", F.lit(12)), 16, 10).cast("bigint") % 4 == 0, F.parse_json(F.regexp_replace(F.to_json("doc"), '"title":"Article', '"name":"Article'))).otherwise(F.col("doc")))
    return validate.violations(bad, ARTICLE_SCHEMA).groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


BROKEN = f"""SELECT {ORDER_OID} AS _id, path, rule FROM (
    SELECT *, 'items' AS path, 'minItems' AS rule FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT *, 'currency', 'enum' FROM orders WHERE o_orderkey % 11 = 0
    UNION ALL SELECT *, 'customer.email', 'pattern' FROM orders WHERE o_orderkey % 11 = 1
    UNION ALL SELECT *, 'items[0].qty', 'minimum' FROM orders WHERE o_orderkey % 11 = 2 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT *, 'version', 'bsonType' FROM orders WHERE o_orderkey % 11 = 3
    UNION ALL SELECT *, 'shipping.location.coordinates', 'minItems' FROM orders WHERE o_orderkey % 11 = 4
    UNION ALL SELECT *, 'extra', 'additionalProperties' FROM orders WHERE o_orderkey % 11 = 5
    UNION ALL SELECT *, 'status', 'required' FROM orders WHERE o_orderkey % 11 = 6)"""

MERGE_SQL = """SELECT path, CASE WHEN bool_or(label = 'object') THEN 'object' WHEN bool_or(label = 'array') THEN 'array' WHEN bool_or(label = 'decimal') THEN 'decimal'
    WHEN bool_or(label = 'double') THEN 'double' WHEN bool_or(label = 'int64') THEN 'int64' WHEN bool_or(label = 'int32') THEN 'int32'
    WHEN bool_or(label = 'objectId') THEN 'objectId' WHEN bool_or(label = 'date') THEN 'date'
    WHEN bool_and(label = 'bool') FILTER (label <> 'null') THEN 'bool' ELSE 'string' END AS label"""

QUERIES = {
    "infer_paths": (lambda spark, sf_dir: infer.path_labels(infer.document_paths(order_documents(spark, sf_dir))), ORDER_LABELS),
    "infer_paths_capped": (
        lambda spark, sf_dir: infer.path_labels(infer.document_paths(order_documents(spark, sf_dir), element_cap=5)),
        ORDER_LABELS.replace("FROM lineitem", "FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) <= 5)"),
    ),
    "infer_paths_props": (
        lambda spark, sf_dir: infer.path_labels(
            infer.document_paths(table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.try_parse_json("props").alias("doc")))
        ),
        "SELECT 'k' AS path, 'int32' AS label, count(*) AS n_docs, count(*) AS n_nodes FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    ),
    "infer_string_patterns": (
        lambda spark, sf_dir: infer.document_paths(
            table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.try_parse_json(F.to_json(F.struct(F.expr(STRINGS).alias("s")))).alias("doc"))
        ).select("_id", "path", "label"),
        f"""SELECT doc_id AS _id, 's' AS path, CASE WHEN regexp_full_match(s, '[0-9a-fA-F]{{24}}') THEN 'objectId'
            WHEN length(s) <= 35 AND regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?(Z|[+-]\\d{{2}}:\\d{{2}}|[+-]\\d{{4}})?)?') THEN 'date' ELSE 'string' END AS label
            FROM (SELECT doc_id, {STRINGS_SQL} AS s FROM documents)""",
    ),
    "infer_wrappers": (
        lambda spark, sf_dir: infer.path_labels(infer.document_paths(wrapper_documents(spark, sf_dir))),
        """SELECT path, label, count(*) AS n_docs, count(*) AS n_nodes FROM (
             SELECT 'v' AS path, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'objectId' WHEN 1 THEN 'date' WHEN 2 THEN 'int32' WHEN 3 THEN 'int32' WHEN 4 THEN 'int64'
                    WHEN 5 THEN 'double' WHEN 6 THEN 'decimal' ELSE 'object' END AS label FROM events
             UNION ALL SELECT 'v.$oid', 'string' FROM events WHERE event_id % 9 = 7
             UNION ALL SELECT unnest(['v.$numberDecimal', 'v.more']), 'int32' FROM events WHERE event_id % 9 = 8
             UNION ALL SELECT 'a', 'array' FROM events UNION ALL SELECT 'a[]', 'int64' FROM events) GROUP BY 1, 2""",
    ),
    "infer_merge": (
        lambda spark, sf_dir: infer.infer_schema(infer.document_paths(mixed_documents(spark, sf_dir))),
        f"{MERGE_SQL} FROM ({MIXED_LABELS}) GROUP BY path",
    ),
    "infer_sql_types": (
        lambda spark, sf_dir: infer.sql_types(
            infer.infer_schema(infer.document_paths(mixed_documents(spark, sf_dir))), overrides={"double": "REAL"}, time_default="TIMESTAMP"
        ),
        f"SELECT *, {SQL_TYPES} AS sql_type FROM ({MERGE_SQL} FROM ({MIXED_LABELS}) GROUP BY path)",
    ),
    "infer_conflicts": (
        lambda spark, sf_dir: infer.path_report(infer.document_paths(mixed_documents(spark, sf_dir))),
        f"""SELECT path, count(DISTINCT id) AS n_docs, count(*) AS n_nodes, count(*) FILTER (label = 'null') AS n_null,
                   coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'null'), '') AS labels,
                   count(DISTINCT label) FILTER (label <> 'null') > 1 AS conflict FROM ({MIXED_LABELS}) GROUP BY path""",
    ),
    "infer_strategy": (
        lambda spark, sf_dir: infer.shape_profile(infer.document_paths(order_documents(spark, sf_dir))).select(
            "path", "n_arrays", "n_objects", "n_elements", "max_length", "mean_length", "id_share", "suggestion"
        ),
        f"""SELECT p AS path, 0 AS n_arrays, n AS n_objects, 0 AS n_elements, CAST(NULL AS INTEGER) AS max_length, CAST(NULL AS DOUBLE) AS mean_length,
                   CAST(NULL AS DOUBLE) AS id_share, 'columnize' AS suggestion
            FROM (VALUES {_rows({p: l for p, l in ORDER_PATHS.items() if l == 'object'})}) v(p, lb), (SELECT count(*) AS n FROM orders)
            UNION ALL SELECT 'items', (SELECT count(*) FROM orders), 0, count(*), (SELECT CAST(max(n) AS INTEGER) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)),
                   round(count(*) / (SELECT count(*) FROM orders), 4), 0.0, 'child_table' FROM lineitem
            UNION ALL SELECT 'shipping.location.coordinates', count(*), 0, 2 * count(*), 2, 2.0, 0.0, 'jsonb' FROM orders
            UNION ALL SELECT 'tags', count(*), 0, count(*) FILTER (o_orderpriority = '1-URGENT'), 1, round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 4), 0.0, 'jsonb' FROM orders""",
    ),
    "validate_docs": (validate_docs, BROKEN),
    "validate_articles": (
        validate_articles,
        "SELECT 'title' AS path, 'required' AS rule, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 0 UNION ALL SELECT 'orderRef', 'bsonType', count(DISTINCT conv_id) FROM conversations",
    ),
    "validate_split": (
        validate_split,
        f"SELECT {ORDER_OID} AS _id, CASE WHEN {ORDER_OID} IN (SELECT _id FROM ({BROKEN})) THEN 'rejected' ELSE 'accepted' END AS outcome FROM orders",
    ),
}
