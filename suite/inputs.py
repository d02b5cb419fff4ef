"""Inputs of the registered queries, built from the driver tables, and the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(col: str) -> str:
    return f"cast({col} as decimal(18,2))"


def object_id(ts: str, key: str) -> str:
    """24 hex digits: seconds, zeros, key."""
    return f"lower(concat(lpad(hex(unix_timestamp({ts})), 8, '0'), '0000', lpad(hex({key}), 12, '0')))"


def object_id_sql(ts: str, key: str) -> str:
    return f"lower(lpad(to_hex(epoch({ts})::BIGINT), 8, '0') || '0000' || lpad(to_hex({key}), 12, '0'))"


UNIT_PRICE = "cast(cast(floor(round(l_extendedprice * 100) / l_quantity) as decimal(18,0)) * 0.01 as decimal(18,2))"

STATUS = "element_at(array('NEW','PAID','SHIPPED','DELIVERED','CANCELLED'), cast(o_orderkey % 5 as int) + 1)"
TIER = "element_at(array('BRONZE','SILVER','GOLD','PLATINUM'), cast(o_custkey % 4 as int) + 1)"


def order_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per order document: ``_id`` text and a ``doc`` struct with customer, items and amounts.

    The lines of an order are one array, so an order must fit into a row, as any document must.
    """
    lines = table(spark, sf_dir, "lineitem")
    item = F.expr(
        f"""struct(
            concat('SKU-', l_partkey) as sku,
            concat('Part ', l_partkey) as name,
            cast(l_quantity as int) as qty,
            struct(cast({UNIT_PRICE} as string) as `$numberDecimal`) as unitPrice,
            case when l_discount > 0 then struct(cast({money('l_discount')} as string) as `$numberDecimal`) end as discount)"""
    )
    # ``sort_array`` and the field of an array are compiled code; ``array_sort`` and ``transform`` are not.
    ordered = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, item.alias("item"))))
    items = (
        lines.groupBy("l_orderkey")
        .agg(
            ordered["item"].alias("items"),
            F.sum(F.expr(money("l_extendedprice"))).alias("subtotal"),
        )
        .withColumnRenamed("l_orderkey", "o_orderkey")
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(items, "o_orderkey", "left")
        .withColumn("subtotal", F.expr("coalesce(cast(subtotal as decimal(18,2)), 0.00)"))
        .withColumn("tax", F.expr("cast(round(subtotal * 0.08, 2) as decimal(18,2))"))
        .withColumn("ship", F.expr("cast(case when subtotal > 100 then 0 else 5.99 end as decimal(18,2))"))
    )
    oid = object_id("o_orderdate", "o_orderkey")
    return joined.selectExpr(
        f"{oid} as _id",
        f"""struct(
            struct({oid} as `$oid`) as _id,
            concat('ORD-', year(o_orderdate), '-', lpad(o_orderkey, 10, '0')) as orderId,
            struct(concat('CUST-', o_custkey) as id,
                   concat('cust-', o_custkey, '@example.com') as email,
                   concat('Customer ', o_custkey) as name,
                   {TIER} as loyaltyTier) as customer,
            coalesce(items, array()) as items,
            element_at(array('USD','EUR','GBP'), cast(o_orderkey % 3 as int) + 1) as currency,
            struct(struct(cast(subtotal as string) as `$numberDecimal`) as subtotal,
                   struct(cast(tax as string) as `$numberDecimal`) as tax,
                   struct(cast(ship as string) as `$numberDecimal`) as shipping,
                   struct(cast(subtotal + tax + ship as string) as `$numberDecimal`) as total) as amounts,
            {STATUS} as status,
            struct(struct(concat(o_orderkey % 9999 + 1, ' Main St') as line1,
                          case when o_orderkey % 5 = 0 then concat('Apt ', o_orderkey % 50 + 1) end as line2,
                          'Wayne' as city, 'NJ' as region, 'US' as country,
                          lpad(o_custkey % 90000 + 10000, 5, '0') as postalCode) as address,
                   struct('Point' as type,
                          array(-74.25 + o_orderkey % 8 * 0.0625D, 40.5625 + o_custkey % 4 * 0.0625D) as coordinates) as location) as shipping,
            case when o_orderpriority = '1-URGENT' then array('priority') else array() end as tags,
            struct('seed' as source, concat('10.0.', o_orderkey % 256, '.', o_custkey % 256) as ip) as metadata,
            struct(element_at(array('CARD','PAYPAL','WIRE'), cast(o_orderkey % 3 as int) + 1) as method,
                   case when o_orderkey % 3 = 0 then lpad(o_custkey % 10000, 4, '0') end as last4) as payment,
            struct(date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") as `$date`) as createdAt,
            struct(date_format(o_orderdate + make_dt_interval(0, cast(o_orderkey % 6 as int)), "yyyy-MM-dd'T'HH:mm:ss'Z'") as `$date`) as updatedAt,
            1 as version) as doc""",
    )


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents as ``[_id STRING, doc VARIANT]``.

    The values are those that the JSON text of the struct would have, where numbers with a point are decimals.
    """
    coordinates = F.col("doc")["shipping"]["location"]["coordinates"].cast("array<decimal(18,4)>")
    doc = F.col("doc").withField("shipping.location.coordinates", coordinates)
    return order_structs(spark, sf_dir).select("_id", F.to_variant_object(doc).alias("doc"))


ORDER_OID = object_id_sql("o_orderdate", "o_orderkey")

LINES_CTE = f"""ordered_lines AS (
    SELECT l.*, {ORDER_OID} AS oid, o_orderkey, o_custkey, o_orderdate,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS elem_idx,
           CAST(CAST(floor(round(l_extendedprice * 100) / l_quantity) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS unit_price
    FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"""

AMOUNTS_CTE = """sums AS (
    SELECT o_orderkey AS k, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DECIMAL(18,2)) AS subtotal
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
amounts AS (
    SELECT k, subtotal, CAST(round(subtotal * 0.08, 2) AS DECIMAL(18,2)) AS tax,
           CAST(CASE WHEN subtotal > 100 THEN 0 ELSE 5.99 END AS DECIMAL(18,2)) AS ship FROM sums)"""


def article_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article documents as ``[_id STRING, doc VARIANT]``: one per conversation, its turns as mixed elements.

    The turns of a conversation are one array, so a conversation must fit into a row.
    """
    turns = table(spark, sf_dir, "conversations")
    element = F.expr(
        """struct(turn,
            case role when 'user' then 'rich-text' when 'assistant' then 'toggle' else 'image' end as type,
            case role when 'user' then cast(turn as string) end as id,
            case role when 'assistant' then lower(lpad(hex(conv_id * 1000 + turn), 24, '0')) end as ref,
            case role when 'user' then text end as html,
            case role when 'assistant' then text end as title,
            case when role not in ('user', 'assistant') then length(text) end as width)"""
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(element)).alias("elements"))
    built = grouped.selectExpr(
        "lower(concat('660000000000', lpad(hex(conv_id), 12, '0'))) as _id",
        """concat(
             '{"title":"Article ', conv_id, '","elements":',
             to_json(elements), ',"orderRef":"', lower(lpad(hex(conv_id * 7), 24, '0')),
             '","published":', cast(conv_id % 5 <> 0 as string),
             ',"lastEditedAt":{"$date":"2024-01-01T00:00:00Z"},"faqRefs":["',
             lower(lpad(hex(conv_id * 7), 24, '0')), '","', lower(lpad(hex(conv_id * 7), 24, '0')), '","',
             lower(lpad(hex(conv_id * 7 + 1), 24, '0')), '"],"team":null}') as json""",
    )
    return built.select("_id", F.parse_json("json").alias("doc"))


ARTICLE_OID = "lower('66000000' || '0000' || lpad(to_hex(conv_id), 12, '0'))"
