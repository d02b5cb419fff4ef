"""Order entry in batch: what single transactions look up or change, for all districts, orders and customers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaykit.operators.skew import number_in_group

DISTRICT = ["w_id", "d_id"]
# Length of a customer's note, refill and least stock, warehouses in a block.
NOTE_CHARS, REFILL, LEAST_STOCK, BLOCK_WAREHOUSES = 500, 90, 10, 100


def low_stock(orders: DataFrame, lines: DataFrame, stock: DataFrame, last: int = 20, below: int = 50) -> DataFrame:
    """Distinct items of each district's last orders whose stock at the warehouse is below the threshold."""
    newest = orders.groupBy(*DISTRICT).agg((F.max("o_id") + 1).alias("next_id"))
    recent = lines.join(newest, DISTRICT).filter(F.col("o_id") >= F.col("next_id") - last)
    items = recent.select(*DISTRICT, "i_id").distinct()
    scarce = stock.filter(F.col("s_quantity") < below).select("w_id", "i_id")
    return items.join(scarce, ["w_id", "i_id"], "left_semi").groupBy(*DISTRICT).agg(F.count(F.lit(1)).alias("n_items"))


def order_status(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each customer's latest order. Latest by entry time, then key: a maximum, so no sort by customer."""
    latest = orders.groupBy("c_id").agg(F.max(F.struct("o_entry_d", "o_key")).alias("m")).select("c_id", "m.o_key", "m.o_entry_d")
    return latest.join(lines.select("o_key", "ol_number", "i_id", "ol_quantity"), "o_key")


def customer_by_name(customers: DataFrame) -> DataFrame:
    """The lowest customer of each last name in a district."""
    return customers.groupBy(*DISTRICT, "c_last").agg(F.min("c_id").alias("c_id"), F.count(F.lit(1)).alias("n_named"))


def next_delivery(new_orders: DataFrame) -> DataFrame:
    return new_orders.groupBy(*DISTRICT).agg(F.min("o_id").alias("o_id"))


def order_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("o_key").agg(F.sum("ol_amount").alias("total"), F.count(F.lit(1)).alias("n_lines"))


def apply_deliveries(
    new_orders: DataFrame, orders: DataFrame, lines: DataFrame, customers: DataFrame, carrier: int, at: str
) -> dict[str, DataFrame]:
    """Delivers the oldest new order of each district: the tables after it."""
    due = next_delivery(new_orders)
    done = orders.join(due, [*DISTRICT, "o_id"], "left_semi").select("o_key", "c_id")
    amounts = order_totals(lines.join(done, "o_key", "left_semi")).join(done, "o_key").groupBy("c_id").agg(
        F.sum("total").alias("_amount"), F.count(F.lit(1)).alias("_deliveries")
    )
    marked = done.select("o_key", F.lit(True).alias("_done"))
    stamp = F.when(F.col("_done"), F.to_timestamp(F.lit(at)))
    return {
        "new_orders": new_orders.join(due, [*DISTRICT, "o_id"], "left_anti"),
        "orders": orders.join(marked, "o_key", "left").withColumn("o_carrier_id", F.when(F.col("_done"), F.lit(carrier))).drop("_done"),
        "lines": lines.join(marked, "o_key", "left").withColumn("ol_delivery_d", stamp).drop("_done"),
        "customers": customers.join(amounts, "c_id", "left")
        .withColumn("c_balance", F.col("c_balance") + F.coalesce("_amount", F.lit(0)))
        .withColumn("c_delivery_cnt", F.coalesce("_deliveries", F.lit(0))).drop("_amount", "_deliveries"),
    }


def apply_payments(payments: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Year-to-date sums of warehouses and districts, and the customers after their payments."""
    paid = payments.groupBy("c_id").agg(F.sum("amount").alias("_paid"), F.count(F.lit(1)).alias("_n"))
    return {
        "warehouses": payments.groupBy("w_id").agg(F.sum("amount").alias("ytd")),
        "districts": payments.groupBy(*DISTRICT).agg(F.sum("amount").alias("ytd")),
        "customers": customers.join(paid, "c_id", "left")
        .withColumn("c_balance", F.col("c_balance") - F.coalesce("_paid", F.lit(0)))
        .withColumn("c_ytd_payment", F.coalesce("_paid", F.lit(0)))
        .withColumn("c_payment_cnt", F.coalesce("_n", F.lit(0))).drop("_paid", "_n"),
    }


def bad_credit_notes(payments: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer data of bad-credit customers with a note before it for each payment, newest first, cut to its length.

    A note has at least one character, so no more of the newest notes than ``NOTE_CHARS`` can show; the rest is left
    out before notes are gathered, which keeps a very active customer small.
    """
    newest = Window.partitionBy("c_id").orderBy(F.desc("h_date"), F.desc("p_id"))
    kept = payments.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= NOTE_CHARS)
    note = F.concat_ws(" ", "c_id", "d_id", "w_id", F.col("amount").cast("string"))
    notes = kept.groupBy("c_id").agg(F.sort_array(F.collect_list(F.struct("_place", note.alias("note")))).alias("notes"))
    text = F.concat(F.array_join(F.transform("notes", lambda n: n["note"]), "|"), F.lit("|"), F.col("c_data"))
    return customers.filter("c_credit = 'BC'").join(notes, "c_id").select("c_id", F.substring(text, 1, NOTE_CHARS).alias("c_data"))


def reject_orders(requests: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Requests of which every line names a known item."""
    unknown = lines.join(items.select("i_id"), "i_id", "left_anti").select("o_key").distinct()
    return requests.join(unknown, "o_key", "left_anti")


def assign_order_ids(requests: DataFrame, counters: DataFrame, order: str = "o_key") -> DataFrame:
    """Order ids from each district's counter, in request order; numbered by ranges, as a district may be very busy."""
    numbered = number_in_group(requests, DISTRICT, order, name="_place")
    return numbered.join(counters, DISTRICT).withColumn("o_id", F.col("next_o_id") + F.col("_place") - 1).drop("_place", "next_o_id")


def price_lines(lines: DataFrame, items: DataFrame, taxes: DataFrame, discounts: DataFrame) -> DataFrame:
    """Quantity x price x (1 + taxes) x (1 - discount) of each line."""
    amount = F.col("ol_quantity") * F.col("i_price") * (1 + F.col("w_tax") + F.col("d_tax")) * (1 - F.col("c_discount"))
    return lines.join(items, "i_id").join(taxes, DISTRICT).join(discounts, "c_id").withColumn("amount", amount)


def update_stock(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock after all lines: quantity, year-to-date, orders and remote orders.

    Each line takes its quantity and refills by ``REFILL`` whenever less than ``LEAST_STOCK`` is left. With stock in
    10..99 and quantities in 0..90 that keeps the stock in the range, so the order of lines does not matter and the
    result is a remainder of the sum. Rows outside of these ranges raise an error.
    """
    taken = lines.groupBy("w_id", "i_id").agg(
        F.sum("ol_quantity").alias("_taken"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("supply_w_id") != F.col("w_id")).alias("_remote"),
        F.max("ol_quantity").alias("_most"), F.min("ol_quantity").alias("_least"),
    )
    bad = ~F.col("s_quantity").between(LEAST_STOCK, LEAST_STOCK + REFILL - 1) | (F.col("_most") > REFILL) | (F.col("_least") < 0)
    left = F.lit(LEAST_STOCK) + F.pmod(F.col("s_quantity") - LEAST_STOCK - F.coalesce("_taken", F.lit(0)), F.lit(REFILL))
    return stock.join(taken, ["w_id", "i_id"], "left").select(
        "w_id", "i_id",
        F.when(bad, F.raise_error(F.lit("stock or quantity is out of range"))).otherwise(left).cast("bigint").alias("s_quantity"),
        F.coalesce("_taken", F.lit(0)).alias("s_ytd"), F.coalesce("_n", F.lit(0)).alias("s_order_cnt"), F.coalesce("_remote", F.lit(0)).alias("s_remote_cnt"),
    )


def remote_lines(lines: DataFrame) -> DataFrame:
    """Lines supplied by another warehouse, and whether that lies in the same block of warehouses."""
    block = lambda c: F.ceil(F.col(c) / BLOCK_WAREHOUSES)
    return lines.filter("supply_w_id <> w_id").withColumn("same_block", block("supply_w_id") == block("w_id"))


def remote_payments(payments: DataFrame) -> DataFrame:
    """Payments made at another warehouse or district than the customer's, per paying warehouse, with their number."""
    remote = (F.col("w_id") != F.col("c_w_id")) | (F.col("d_id") != F.col("c_d_id"))
    return payments.groupBy("w_id").agg(F.count_if(remote).alias("n_remote"), F.count(F.lit(1)).alias("n"))
