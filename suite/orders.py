"""Order-entry queries W1 to W14, on tables derived from orders, lineitem, customer, part and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relaykit.operators import orders as w
from relaykit.operators.skew import number_in_group
from suite.inputs import LINE_ORDER, money, table


def tables(spark, sf_dir) -> dict:
    source = lambda name: table(spark, sf_dir, name)
    raw = source("orders").selectExpr(
        "o_orderkey as o_key", "o_custkey % 5 + 1 as w_id", "o_orderkey % 10 + 1 as d_id", "o_custkey as c_id", "o_orderdate as o_entry_d", "o_orderstatus"
    )
    orders = number_in_group(raw, ["w_id", "d_id"], "o_key", name="o_id")
    place = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = (
        source("lineitem").withColumn("ol_number", F.row_number().over(place)).join(orders, F.col("l_orderkey") == F.col("o_key"))
        .selectExpr("o_key", "w_id", "d_id", "c_id", "o_id", "ol_number", "l_partkey as i_id", "cast(l_quantity as bigint) as ol_quantity",
                    f"{money('l_extendedprice')} as ol_amount", "case when l_suppkey % 10 = 0 then w_id % 5 + 1 else w_id end as supply_w_id")
    )
    stock = lines.select("w_id", "i_id").distinct().withColumn("s_quantity", F.expr("10 + (i_id * 7 + w_id * 13) % 90"))
    customers = source("customer").selectExpr(
        "c_custkey as c_id", "c_custkey % 5 + 1 as w_id", "c_custkey % 10 + 1 as d_id", "c_mktsegment as c_last", f"{money('c_acctbal')} as c_balance",
        "case when c_custkey % 10 = 0 then 'BC' else 'GC' end as c_credit", "c_name as c_data",
    )
    payments = source("events").filter("event_type = 'purchase'").selectExpr(
        "event_id as p_id", "user_id as c_id", "user_id % 5 + 1 as c_w_id", "user_id % 10 + 1 as c_d_id",
        "event_id % 5 + 1 as w_id", "event_id % 10 + 1 as d_id", "ts as h_date", f"{money('value')} as amount",
    )
    new_orders = orders.filter("o_orderstatus = 'O'").select("w_id", "d_id", "o_id")
    items = source("part").selectExpr("p_partkey as i_id", f"{money('p_retailprice')} as i_price")
    return dict(orders=orders, lines=lines, stock=stock, customers=customers, payments=payments, new_orders=new_orders, items=items)


BASE = f"""WITH o AS (
    SELECT o_orderkey AS o_key, o_custkey % 5 + 1 AS w_id, o_orderkey % 10 + 1 AS d_id, o_custkey AS c_id, o_orderdate AS o_entry_d, o_orderstatus,
           row_number() OVER (PARTITION BY o_custkey % 5, o_orderkey % 10 ORDER BY o_orderkey) AS o_id FROM orders),
l AS (
    SELECT o_key, w_id, d_id, c_id, o_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS ol_number, l_partkey AS i_id,
           CAST(l_quantity AS BIGINT) AS ol_quantity, {money('l_extendedprice')} AS ol_amount, CASE WHEN l_suppkey % 10 = 0 THEN w_id % 5 + 1 ELSE w_id END AS supply_w_id
    FROM lineitem JOIN o ON l_orderkey = o_key),
s AS (SELECT DISTINCT w_id, i_id, 10 + (i_id * 7 + w_id * 13) % 90 AS s_quantity FROM l),
c AS (
    SELECT c_custkey AS c_id, c_custkey % 5 + 1 AS w_id, c_custkey % 10 + 1 AS d_id, c_mktsegment AS c_last, {money('c_acctbal')} AS c_balance,
           CASE WHEN c_custkey % 10 = 0 THEN 'BC' ELSE 'GC' END AS c_credit, c_name AS c_data FROM customer),
p AS (
    SELECT event_id AS p_id, user_id AS c_id, user_id % 5 + 1 AS c_w_id, user_id % 10 + 1 AS c_d_id, event_id % 5 + 1 AS w_id, event_id % 10 + 1 AS d_id,
           ts AS h_date, {money('value')} AS amount FROM events WHERE event_type = 'purchase'),
n AS (SELECT w_id, d_id, o_id FROM o WHERE o_orderstatus = 'O'),
due AS (SELECT w_id, d_id, min(o_id) AS o_id FROM n GROUP BY w_id, d_id)
"""




def doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def w_apply_delivery(spark, sf_dir):
    t = tables(spark, sf_dir)
    after = w.apply_deliveries(t["new_orders"], t["orders"], t["lines"], t["customers"], 7, "2024-01-01 00:00:00")
    count = lambda name, condition: after[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count_if(F.expr(condition)).alias("changed"), F.lit(0.0).alias("amount"))
    money_part = after["customers"].agg(
        F.lit("customers").alias("part"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_delivery_cnt") > 0).alias("changed"), F.sum("c_balance").cast("double").alias("amount")
    )
    return (
        count("new_orders", "false").union(count("orders", "o_carrier_id = 7")).union(count("lines", "ol_delivery_d is not null")).union(money_part)
    )


def w_line_price(spark, sf_dir):
    t = tables(spark, sf_dir)
    taxes = t["orders"].select("w_id", "d_id").distinct().selectExpr("w_id", "d_id", "w_id / 128D as w_tax", "d_id / 256D as d_tax")
    discounts = t["customers"].selectExpr("c_id", "c_id % 20 / 64D as c_discount")
    items = t["items"].selectExpr("i_id", "cast(i_price as double) as i_price")
    priced = w.price_lines(t["lines"], items, taxes, discounts)
    return doubles(priced.groupBy("o_key").agg((F.sum(F.expr("cast(floor(amount * 10000 + 0.5D) as bigint)")) / 10000).alias("amount")), "amount")


def w_assign_order_ids(spark, sf_dir):
    t = tables(spark, sf_dir)
    requests = t["orders"].filter("o_orderstatus <> 'O'").select("o_key", "w_id", "d_id")
    counters = t["new_orders"].groupBy("w_id", "d_id").agg((F.max("o_id") + 1).alias("next_o_id"))
    return w.assign_order_ids(requests, counters)


def w_reject_orders(spark, sf_dir):
    t = tables(spark, sf_dir)
    known = t["items"].filter("i_id % 97 <> 0")
    return w.reject_orders(t["orders"].select("o_key", "w_id", "d_id"), t["lines"], known)


def one(make):
    return lambda spark, sf_dir: make(tables(spark, sf_dir))


QUERIES = {
    "w_low_stock": (
        one(lambda t: w.low_stock(t["orders"], t["lines"], t["stock"])),
        BASE + """, m AS (SELECT w_id, d_id, max(o_id) + 1 AS nx FROM o GROUP BY ALL)
        SELECT l.w_id, l.d_id, count(DISTINCT l.i_id) AS n_items FROM l JOIN m USING (w_id, d_id) JOIN s ON s.w_id = l.w_id AND s.i_id = l.i_id
        WHERE l.o_id >= nx - 20 AND s_quantity < 50 GROUP BY ALL""",
    ),
    "w_order_status": (
        one(lambda t: w.order_status(t["orders"], t["lines"])),
        BASE + """, r AS (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY o_entry_d DESC, o_key DESC) AS k FROM o)
        SELECT r.c_id, r.o_key, r.o_entry_d, ol_number::INTEGER AS ol_number, i_id, ol_quantity FROM r JOIN l USING (o_key) WHERE k = 1""",
    ),
    "w_customer_by_name": (
        one(lambda t: w.customer_by_name(t["customers"])),
        BASE + "SELECT w_id, d_id, c_last, min(c_id) AS c_id, count(*) AS n_named FROM c GROUP BY ALL",
    ),
    "w_next_delivery": (one(lambda t: w.next_delivery(t["new_orders"])), BASE + "SELECT * FROM due"),
    "w_order_total": (
        one(lambda t: doubles(w.order_totals(t["lines"]), "total")),
        BASE + "SELECT o_key, CAST(sum(ol_amount) AS DOUBLE) AS total, count(*) AS n_lines FROM l GROUP BY o_key",
    ),
    "w_apply_delivery": (
        w_apply_delivery,
        BASE + """, g AS (SELECT o_key, o.c_id FROM o JOIN due USING (w_id, d_id, o_id))
        SELECT 'new_orders' AS part, (SELECT count(*) FROM n) - (SELECT count(*) FROM due) AS n, 0::BIGINT AS changed, 0.0::DOUBLE AS amount
        UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM g), 0.0
        UNION ALL SELECT 'lines', (SELECT count(*) FROM l), (SELECT count(*) FROM l JOIN g USING (o_key)), 0.0
        UNION ALL SELECT 'customers', (SELECT count(*) FROM c), (SELECT count(DISTINCT g.c_id) FROM g JOIN l USING (o_key)),
            ((SELECT sum(c_balance) FROM c) + (SELECT sum(ol_amount) FROM l JOIN g USING (o_key)))::DOUBLE""",
    ),
    "w_apply_payment": (
        one(lambda t: doubles(w.apply_payments(t["payments"], t["customers"])["customers"].select("c_id", "c_balance", "c_ytd_payment", "c_payment_cnt"), "c_balance", "c_ytd_payment")),
        BASE + """, a AS (SELECT c_id, sum(amount) AS paid, count(*) AS k FROM p GROUP BY c_id)
        SELECT c_id, CAST(c_balance - coalesce(paid, 0) AS DOUBLE) AS c_balance, CAST(coalesce(paid, 0) AS DOUBLE) AS c_ytd_payment, coalesce(k, 0) AS c_payment_cnt
        FROM c LEFT JOIN a USING (c_id)""",
    ),
    "w_apply_payment_ytd": (
        one(lambda t: doubles(w.apply_payments(t["payments"], t["customers"])["districts"], "ytd")),
        BASE + "SELECT w_id, d_id, CAST(sum(amount) AS DOUBLE) AS ytd FROM p GROUP BY ALL",
    ),
    "w_bad_credit": (
        one(lambda t: w.bad_credit_notes(t["payments"], t["customers"])),
        BASE + """SELECT c_id, substring(string_agg(p.c_id || ' ' || p.d_id || ' ' || p.w_id || ' ' || amount, '|' ORDER BY h_date DESC, p_id DESC) || '|' || any_value(c_data), 1, 500) AS c_data
        FROM p JOIN c USING (c_id) WHERE c_credit = 'BC' GROUP BY c_id""",
    ),
    "w_assign_order_ids": (
        w_assign_order_ids,
        BASE + """, k AS (SELECT w_id, d_id, max(o_id) + 1 AS nx FROM n GROUP BY ALL)
        SELECT o_key, w_id, d_id, nx + row_number() OVER (PARTITION BY w_id, d_id ORDER BY o_key) - 1 AS o_id FROM o JOIN k USING (w_id, d_id) WHERE o_orderstatus <> 'O'""",
    ),
    "w_reject_orders": (
        w_reject_orders,
        BASE + "SELECT o_key, w_id, d_id FROM o WHERE o_key NOT IN (SELECT o_key FROM l WHERE i_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 97 <> 0))",
    ),
    "w_line_price": (
        w_line_price,
        BASE + f"""SELECT o_key, sum(CAST(floor((ol_quantity * CAST({money('p_retailprice')} AS DOUBLE) * (1 + l.w_id / 128.0::DOUBLE + l.d_id / 256.0::DOUBLE)
            * (1 - l.c_id % 20 / 64.0::DOUBLE)) * 10000 + 0.5) AS BIGINT))::BIGINT / 10000 AS amount
        FROM l JOIN part ON p_partkey = i_id JOIN c ON c.c_id = l.c_id GROUP BY o_key""",
    ),
    "w_stock_update": (
        one(lambda t: w.update_stock(t["lines"], t["stock"])),
        BASE + """, q AS (SELECT w_id, i_id, list(ol_quantity ORDER BY o_key, ol_number) AS qs, count(*) AS k, count(*) FILTER (supply_w_id <> w_id) AS r FROM l GROUP BY ALL)
        SELECT s.w_id, s.i_id, list_reduce(list_prepend(s_quantity, qs), lambda a, x: CASE WHEN a - x < 10 THEN a - x + 90 ELSE a - x END)::BIGINT AS s_quantity,
            list_sum(qs)::BIGINT AS s_ytd, k AS s_order_cnt, r AS s_remote_cnt FROM s JOIN q USING (w_id, i_id)""",
    ),
    "w_remote_lines": (
        one(lambda t: w.remote_lines(t["lines"]).select("o_key", "ol_number", "w_id", "supply_w_id", "same_block")),
        BASE + "SELECT o_key, ol_number::INTEGER AS ol_number, w_id, supply_w_id, ceil(supply_w_id / 100) = ceil(w_id / 100) AS same_block FROM l WHERE supply_w_id <> w_id",
    ),
    "w_remote_payments": (
        one(lambda t: w.remote_payments(t["payments"])),
        BASE + "SELECT w_id, count(*) FILTER (w_id <> c_w_id OR d_id <> c_d_id) AS n_remote, count(*) AS n FROM p GROUP BY w_id",
    ),
}
