"""Documents to tables: queries D1 to D19 over the order, article and mixed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaykit.functions.naming import column_name, rename_columns
from relaykit.operators import shape
from suite.inference import ITEM_PATHS, ORDER_PATHS
from suite.inputs import LINES_CTE, ORDER_OID, article_documents, money, order_documents, table

LABELS = ORDER_PATHS | ITEM_PATHS | {
    "items[].discount": "decimal", "shipping.address.line2": "string", "payment.last4": "string", "shipping.location.coordinates[]": "double", "tags[]": "string",
}
JSONB = {"defaultStrategy": "jsonb", "arrayStrategy": "jsonb"}
WITH = f"WITH {LINES_CTE} "
OID = f"{ORDER_OID} AS id"


def ids(strategy, **more):
    return {"tableDefaults": {"id": {"idStrategy": strategy, **more}}}


def cut(config: dict, name: str, *columns: str, labels: dict | None = None, docs=order_documents, collection: str = "orders"):
    """Query: one planned table of a collection, some of its columns."""

    def query(spark, sf_dir) -> DataFrame:
        mapping = shape.plan_tables(labels or LABELS, collection, config)
        return shape.table_rows(docs(spark, sf_dir), mapping, mapping.table(name)).selectExpr(*columns)

    return query


def d_payload(spark, sf_dir):
    rows = shape.payload_rows(order_documents(spark, sf_dir), {"status": ("status", "STRING(20)"), "version": ("version", "INT4")})
    return rows.select("id", "status", "version", F.get_json_object("payload", "$.orderId").alias("order_id"))


def d_junction(spark, sf_dir):
    labels = {"_id": "objectId", "faqRefs": "array", "faqRefs[]": "objectId"}
    mapping = shape.plan_tables(labels, "articles", {"tableOverrides": [{"path": "faqRefs[]", "mode": "junction_table", "fk": {"childColumns": "faqRefs[]", "parentTable": "faqs"}}]})
    refs = shape.table_rows(article_documents(spark, sf_dir), mapping, mapping.tables[1])
    link, target = "articles_id", next(c.name for c in mapping.tables[1].columns if c.path == "")
    # The target entity: every object id of an even number.
    faqs = table(spark, sf_dir, "conversations").selectExpr("lower(lpad(hex(conv_id * 14), 24, '0')) as id").distinct()
    return shape.junction_rows(refs, faqs, link, target, "id").select(F.col(link).alias("article"), F.col(target).alias("faq"))


def d_keys(strategy):
    return cut(ids(strategy), "orders", "id", "order_id")


def references(spark, sf_dir):
    """Articles that name an order by its source id; orders with a smaller set of keys."""
    articles = table(spark, sf_dir, "conversations").selectExpr("conv_id", "conv_id * 7 as order_ref").distinct()
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 3")
    # A legacy id that stands twice must not multiply the children.
    parents = orders.selectExpr("o_orderkey as legacy", "o_orderkey + 1000000 as id").union(orders.filter("o_orderkey % 4 = 0").selectExpr("o_orderkey", "o_orderkey + 2000000"))
    return shape.resolve_references(articles, parents, "order_ref", "legacy", "id", "order_id")


def d_naming(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as customerId", "c_name as `customer.name`", "c_name as customer_name", f"c_custkey as `{'veryLongName.' * 8}x`")
    return rename_columns(rows)


def d_vertical_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = shape.vertical_split(orders, ["o_orderkey"], {"hot": ["o_orderstatus"], "cold": ["o_orderpriority", "o_orderdate"]})
    return parts["hot"].join(parts["cold"], "o_orderkey").join(parts["rest"], "o_orderkey")


def d_summary(spark, sf_dir):
    config = {"flattenDepth": 2}
    mapping = shape.plan_tables(LABELS, "orders", config)
    tables = shape.shape_documents(order_documents(spark, sf_dir), mapping)
    return shape.conversion_summary(tables, mapping, config).select("table_name", "kind", "n_columns", "n_rows")


# Documents whose box is an object, an array, a number or absent, and whose two unit prices share a column name.
BOXES = """concat('{', case cast(event_id % 4 as int) when 0 then concat('"box":{"a":', event_id, '},') when 1 then concat('"box":[', user_id, ',"x"],') when 2 then concat('"box":', event_id, ',') else '' end,
    if(event_id % 3 = 0, '', concat('"unitPrice":', event_id % 100, ',')), if(event_id % 5 = 0, '', concat('"unit_price":', 1000 + event_id % 100, ',')), '"n":1}')"""


def d_mixed_paths(spark, sf_dir):
    """A path that is an object, an array or a number, and two paths with one column name: no value is lost."""
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.parse_json(F.expr(BOXES)).alias("doc"))
    labels = {"box": "object", "box.a": "int32", "box[]": "string", "unitPrice": "int32", "unit_price": "int32", "n": "int32"}
    mapping = shape.plan_tables(labels, "mixed", {"arrayStrategy": "jsonb"})
    rows = shape.table_rows(docs, mapping, mapping.base)
    return rows.select("id", "box", "unit_price", "unit_price_2")


def d_shared_conflicts(spark, sf_dir):
    """Customers whom their orders name in two ways."""
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey as _id", "parse_json(concat('{\"customer\":{\"id\":\"c', o_custkey, '\",\"name\":\"', if(o_orderkey % 7 = 0, 'A', 'B'), '\"}}')) as doc")
    mapping = shape.plan_tables({"customer": "object", "customer.id": "string", "customer.name": "string"}, "orders", REVERSE)
    shared = mapping.table("customer")
    return shape.shared_conflicts(shape.table_rows(docs, mapping, shared, every=True), shared.key).select("id", "n_rows")


def d_keys_unique(spark, sf_dir):
    rows = cut(ids("rowid"), "orders", "id", "order_id")(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("order_id").alias("n_orders"), F.count_if(F.col("id").isNull()).alias("n_null"))


REVERSE = {"tableOverrides": [{"path": "customer", "mode": "normalize", "fk": {"reverseSpec": {"childPkPath": "id", "baseColumnName": "customer_ref"}}}]}
NORMALIZED = {"tableOverrides": [{"path": "shipping", "mode": "normalize"}], "flattenDepth": 2}
LOCATION = {"tableOverrides": [{"path": "shipping.location", "mode": "normalize"}], "flattenDepth": 3}
OVERRIDES = {
    "ignorePaths": ["metadata"],
    "columnOverrides": [{"path": "orderId", "name": "number"}, {"path": "version", "type": "INT8"}, {"path": "status", "default": "'NONE'"}, {"path": "currency", "generated": {"expr": "lower(currency)"}}],
}
AMOUNTS = f"""sums AS (SELECT o_orderkey AS k, CAST(coalesce(sum({money('l_extendedprice')}), 0) AS DECIMAL(18,2)) AS sub FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""

QUERIES = {
    "d_child_table": (
        cut({"flattenDepth": 2}, "items", "orders_id", "elem_idx", "sku", "name", "qty", "cast(unit_price as double) as unit_price", "cast(discount as double) as discount"),
        WITH + f"""SELECT oid AS orders_id, elem_idx::INTEGER AS elem_idx, 'SKU-' || l_partkey AS sku, 'Part ' || l_partkey AS name, l_quantity::INTEGER AS qty, unit_price::DOUBLE AS unit_price,
            CASE WHEN l_discount > 0 THEN {money('l_discount')}::DOUBLE END AS discount FROM ordered_lines""",
    ),
    "d_flat": (
        cut(JSONB, "orders", "id", "order_id", "currency", "status", "version", "created_at"),
        f"""SELECT {OID}, 'ORD-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 10, '0') AS order_id, ['USD','EUR','GBP'][(o_orderkey % 3)::INT + 1] AS currency,
            ['NEW','PAID','SHIPPED','DELIVERED','CANCELLED'][(o_orderkey % 5)::INT + 1] AS status, 1::INTEGER AS version, date_trunc('second', o_orderdate) AS created_at FROM orders""",
    ),
    "d_columnize": (
        cut({"flattenDepth": 1}, "orders", "id", "customer_email", "cast(amounts_subtotal as double) as amounts_subtotal", "get_json_object(shipping_address, '$.city') as city", "get_json_object(shipping_location, '$.coordinates[0]') as x"),
        f"WITH {AMOUNTS} " + f"""SELECT {OID}, 'cust-' || o_custkey || '@example.com' AS customer_email, sub::DOUBLE AS amounts_subtotal, 'Wayne' AS city,
            CASE WHEN (-74.25 + o_orderkey % 8 * 0.0625) % 1 = 0 THEN (-74.25 + o_orderkey % 8 * 0.0625)::INT::VARCHAR ELSE rtrim((-74.25 + o_orderkey % 8 * 0.0625)::VARCHAR, '0') END AS x FROM orders JOIN sums ON k = o_orderkey""",
    ),
    "d_jsonb": (
        cut(JSONB, "orders", "id", "get_json_object(customer, '$.id') as customer", "get_json_object(shipping, '$.address.line1') as line1"),
        f"SELECT {OID}, 'CUST-' || o_custkey AS customer, (o_orderkey % 9999 + 1) || ' Main St' AS line1 FROM orders",
    ),
    "d_payload": (
        d_payload,
        f"""SELECT {OID}, ['NEW','PAID','SHIPPED','DELIVERED','CANCELLED'][(o_orderkey % 5)::INT + 1] AS status, 1::INTEGER AS version,
            'ORD-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 10, '0') AS order_id FROM orders""",
    ),
    "d_normalize": (
        cut(NORMALIZED, "shipping", "id", "get_json_object(shipping_address, '$.postalCode') as postal"),
        f"SELECT {OID}, lpad((o_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS postal FROM orders",
    ),
    "d_reverse_fk": (
        cut(REVERSE, "customer", "id", "customer_email", "customer_loyalty_tier"),
        "SELECT DISTINCT 'CUST-' || o_custkey AS id, 'cust-' || o_custkey || '@example.com' AS customer_email, ['BRONZE','SILVER','GOLD','PLATINUM'][(o_custkey % 4)::INT + 1] AS customer_loyalty_tier FROM orders",
    ),
    "d_reverse_fk_base": (cut(REVERSE, "orders", "id", "customer_ref"), f"SELECT {OID}, 'CUST-' || o_custkey AS customer_ref FROM orders"),
    "d_shared_conflicts": (d_shared_conflicts, "SELECT 'c' || o_custkey AS id, count(DISTINCT o_orderkey % 7 = 0) AS n_rows FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 7 = 0) > 1"),
    "d_array_json": (
        cut(JSONB, "orders", "id", "json_array_length(items) as n_items", "get_json_object(tags, '$[0]') as tag"),
        WITH + f"""SELECT {OID}, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INTEGER AS n_items, CASE WHEN o_orderpriority = '1-URGENT' THEN 'priority' END AS tag FROM orders""",
    ),
    "d_nested_array": (
        cut(LOCATION, "shipping_location_coordinates", "shipping_location_id", "elem_idx", "value"),
        f"""SELECT {ORDER_OID} AS shipping_location_id, 0::INTEGER AS elem_idx, (-74.25 + o_orderkey % 8 * 0.0625)::DOUBLE AS value FROM orders
            UNION ALL SELECT {ORDER_OID}, 1, (40.5625 + o_custkey % 4 * 0.0625)::DOUBLE FROM orders""",
    ),
    "d_overrides": (
        cut(OVERRIDES, "orders", "id", "number", "version", "status", "currency"),
        f"""SELECT {OID}, 'ORD-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 10, '0') AS number, 1::BIGINT AS version, ['NEW','PAID','SHIPPED','DELIVERED','CANCELLED'][(o_orderkey % 5)::INT + 1] AS status,
            ['usd','eur','gbp'][(o_orderkey % 3)::INT + 1] AS currency FROM orders""",
    ),
    "d_keys": (d_keys("use_objectid"), f"SELECT {OID}, 'ORD-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 10, '0') AS order_id FROM orders"),
    "d_keys_uuid": (
        d_keys("uuid"),
        f"""SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS id, order_id
        FROM (SELECT sha256({ORDER_OID}) AS h, 'ORD-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, 10, '0') AS order_id FROM orders)""",
    ),
    "d_keys_rowid": (d_keys("rowid"), None),
    "d_keys_rowid_unique": (d_keys_unique, "SELECT count(*) AS n, count(*) AS n_ids, count(DISTINCT o_orderkey) AS n_orders, 0::BIGINT AS n_null FROM orders"),
    "d_legacy_id": (cut(ids("uuid", preserveSourceId=True), "orders", "legacy_id", "version"), f"SELECT {ORDER_OID} AS legacy_id, 1::INTEGER AS version FROM orders"),
    "d_oid_ts": (
        cut({"objectId": {"derive": {"timestamp": True}}}, "orders", "id", "id_ts"),
        f"SELECT {OID}, date_trunc('second', o_orderdate) AS id_ts FROM orders",
    ),
    "d_child_key": (
        cut(ids("uuid"), "items", "elem_idx", "length(id) as key_length", "sku"),
        WITH + "SELECT elem_idx::INTEGER AS elem_idx, 36::INTEGER AS key_length, 'SKU-' || l_partkey AS sku FROM ordered_lines",
    ),
    "d_junction": (
        d_junction,
        """WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (
            SELECT conv_id, conv_id * 7 AS t FROM c UNION SELECT conv_id, conv_id * 7 + 1 FROM c)
        SELECT lower('660000000000' || lpad(to_hex(conv_id), 12, '0')) AS article, lower(lpad(to_hex(t), 24, '0')) AS faq FROM r WHERE t IN (SELECT conv_id * 14 FROM c)""",
    ),
    "d_fk_lookup": (
        references,
        """SELECT DISTINCT conv_id, conv_id * 7 AS order_ref, CASE WHEN conv_id * 7 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) THEN conv_id * 7 + 1000000 END AS order_id FROM conversations""",
    ),
    "d_naming": (
        d_naming,
        f"""SELECT c_custkey AS customer_id, c_name AS customer_name, c_name AS customer_name_2, c_custkey AS "{column_name('veryLongName.' * 8 + 'x')}" FROM customer""",
    ),
    "d_vertical_split": (d_vertical_split, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"),
    "d_mixed_paths": (
        d_mixed_paths,
        """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"a":' || event_id || '}' WHEN 1 THEN '[' || user_id || ',"x"]' WHEN 2 THEN event_id::VARCHAR END AS box,
            CASE WHEN event_id % 3 <> 0 THEN (event_id % 100)::INTEGER END AS unit_price, CASE WHEN event_id % 5 <> 0 THEN (1000 + event_id % 100)::INTEGER END AS unit_price_2 FROM events""",
    ),
    "d_summary": (
        d_summary,
        """SELECT 'orders' AS table_name, 'base' AS kind, 26::INTEGER AS n_columns, (SELECT count(*) FROM orders) AS n_rows
        UNION ALL SELECT 'items', 'array', 7, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'shipping_location_coordinates', 'array', 3, (SELECT 2 * count(*) FROM orders)
        UNION ALL SELECT 'tags', 'array', 3, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')""",
    ),
}
