"""Queries on stored tables that streams and repeated fetches load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaykit.operators import series
from relaykit.session import work_dir
from relaykit.sources.tables import StoredTable
from relaykit.streaming import alerts, loading
from suite.inputs import table
from suite.records import customers, monitor

CUSTOMER = "c_custkey bigint, c_name string, c_mktsegment string, version bigint"


def run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stored(spark, folder, schema, key, order):
    return StoredTable.create(spark, f"{folder}/table", spark.createDataFrame([], schema).schema, key, order, buckets=16)


def stream_upsert_final(spark, sf_dir):
    """First load, an update of every fifth key without all columns, a stale one and a replay: four batches of files, the stream started for each."""
    folder = work_dir(spark, "stream-upsert")
    target = stored(spark, folder, CUSTOMER, ["c_custkey"], "version")
    base = customers(spark, sf_dir)
    update = base.filter("c_custkey % 5 = 0").selectExpr("c_custkey", "concat(c_name, ' new') as c_name", "3L as version")
    stale = base.filter("c_custkey % 10 = 0").selectExpr("c_custkey", "'stale' as c_name", "c_mktsegment", "2L as version")
    for name, rows in (("all", base), ("some", update), ("all", stale), ("some", update), ("all", base)):
        rows.write.mode("append").parquet(f"{folder}/{name}")
        schema = CUSTOMER if name == "all" else "c_custkey bigint, c_name string, version bigint"
        run(loading.upsert_stream(loading.file_stream(spark, f"{folder}/{name}", schema), target, name, f"{folder}/state-{name}"))
    return target.read()


def cdc_stream_final(spark, sf_dir):
    """Change events in three batches of which the second holds the oldest events; the last one comes twice."""
    folder = work_dir(spark, "stream-changes")
    target = stored(spark, folder, "c_custkey bigint, c_name string, position bigint", ["c_custkey"], "position")
    target.upsert(customers(spark, sf_dir).selectExpr("c_custkey", "c_name", "-1L as position"))
    events = table(spark, sf_dir, "events").selectExpr(
        "user_id as c_custkey", "concat('name ', event_id) as c_name", "event_id as position",
        "case when event_type = 'error' then 'delete' when event_type = 'signup' then 'insert' else 'update' end as op", "event_id % 3 as part",
    )
    for part in (1, 0, 2, 2):
        events.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/events")
        rows = loading.file_stream(spark, f"{folder}/events", "c_custkey bigint, c_name string, position bigint, op string")
        run(loading.change_stream(rows, target, "op", "events", f"{folder}/state"))
    return target.read().select("c_custkey", "c_name", "position")


def incremental_fetches(spark, sf_dir):
    """Events fetched by (hour, type), many of which are equal, into a table; with the number of fetches' rows and the position."""
    folder = work_dir(spark, "fetches")
    events = table(spark, sf_dir, "events").select("event_id", F.date_trunc("day", "ts").alias("day"), "event_type", F.lit(1).alias("version"))
    target = stored(spark, folder, "event_id bigint, event_type string, version int", ["event_id"], "version")
    size = max(1000, events.count() // 4)
    loading.fetch_all(events, target, "events", ["day", "event_type"], ["event_id", "event_type", "version"], size)
    ledger = target.ledger().select("n_rows", F.array_join("position", " ").alias("position"))
    return target.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total")).join(F.broadcast(ledger))


def alert_streams(spark, sf_dir):
    """The alert rules over streams of the events' files."""
    folder = work_dir(spark, "alerts")
    monitor(spark, sf_dir).write.parquet(f"{folder}/records")
    schema = spark.read.parquet(f"{folder}/records").schema
    records = spark.readStream.schema(schema).parquet(f"{folder}/records")
    rules = {
        "latency": series.slow_records(records, "flowStartDate", "flowCompletion"), "back_pressure": series.back_pressure(records),
        "node_down": series.nodes_down(records), "bulletin": series.bulletins(records.select("event_id", "content")),
    }
    for name, found in rules.items():
        run(alerts.write_alerts(found.select("event_id"), name, f"{folder}/out", f"{folder}/state-{name}"))
    return reduce(DataFrame.unionByName, [spark.read.schema("event_id bigint, alert string").parquet(f"{folder}/out/{name}") for name in rules])


def rate_cap_stream(spark, sf_dir):
    """The first event of each type and ten minutes, from five batches whose events come in no order."""
    folder = work_dir(spark, "rate")
    target = stored(spark, folder, "event_type string, window_start timestamp, event_id bigint, ts timestamp, version bigint", ["event_type", "window_start"], "version")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for part in range(5):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == part).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        capped = alerts.rate_cap_updates(stream, ["event_type"], "ts", "event_id", 600, lateness="3650 days")
        run(loading.summary_stream(capped, target, "rate", f"{folder}/state"))
    return target.read().select("event_id", "ts", "event_type")


QUERIES = {
    "stream_upsert_final": (
        stream_upsert_final,
        """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' new' ELSE c_name END AS c_name, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS version FROM customer""",
    ),
    "cdc_stream_final": (
        cdc_stream_final,
        """WITH e AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        SELECT c_custkey, c_name, -1::BIGINT AS position FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e)
        UNION ALL SELECT user_id, 'name ' || event_id, event_id FROM e WHERE event_type <> 'error'""",
    ),
    "incremental_fetches": (
        incremental_fetches,
        """WITH l AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') || ' ' || event_type AS position FROM events ORDER BY date_trunc('day', ts) DESC, event_type DESC LIMIT 1)
        SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS total, (SELECT count(*) FROM events) AS n_rows, (SELECT position FROM l) AS position FROM events GROUP BY 1""",
    ),
    "alert_streams": (
        alert_streams,
        """SELECT event_id, 'latency' AS alert FROM events WHERE trunc(value) > 50 UNION ALL SELECT event_id, 'back_pressure' FROM events WHERE event_type = 'error' AND user_id % 2 = 0
        UNION ALL SELECT event_id, 'node_down' FROM events WHERE user_id % 3 <> 2 UNION ALL SELECT event_id, 'bulletin' FROM events WHERE event_type IN ('error', 'click')""",
    ),
    "rate_cap_stream": (
        rate_cap_stream,
        "SELECT event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 600) ORDER BY ts, event_id) = 1",
    ),
}
