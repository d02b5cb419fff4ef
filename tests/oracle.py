"""Side-by-side run of the registered queries: Spark against the SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return ("f", value + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, dt.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, frame, sql: str | None) -> str:
    """Empty text when both agree, else what differs."""
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want = normal([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    odd = {n: t for n, t in types.items() if "HUGEINT" in t or "DECIMAL" in t or "WITH TIME ZONE" in t}
    if odd:
        return f"types {odd}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            return f"first difference\n   spark {g}\n   sql   {w}"
    return "" if got[1] else "EMPTY"


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from relaykit.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(con, query(spark, sf_dir), sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += bool(problem)
        print(f"@@ {'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in sqls else '(rows)'} {problem}", flush=True)
    print(f"@@ {bad} failed")


if __name__ == "__main__":
    main()
