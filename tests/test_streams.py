"""Stored tables under writers that fail, meet or come again, and streams that load them."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from relaykit.operators import series
from relaykit.sources import tables
from relaykit.sources.loading import read_incremental, upsert
from relaykit.sources.tables import StoredTable
from relaykit.streaming import alerts, loading

SCHEMA = "k int, a string, b string, v long"


def make(spark, path, buckets=8):
    return StoredTable.create(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["k"], "v", buckets)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def run(query):
    query.awaitTermination()
    return query


def test_versions_and_partial_columns(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    assert rows(table.read()) == [] and not table.version().folders
    table.upsert(frame(spark, [(i, f"a{i}", "b", 1) for i in range(40)] + [(None, "n", "b", 1), (None, "m", "b", 2)]))
    first, seen = table.version(), table.read()
    with pytest.warns(UserWarning, match=r"only: \['x'\]; of the table only: \['b'\]"):
        table.upsert(frame(spark, [(3, "new", 2, 0), (3, "newer", 3, 0), (4, None, 2, 0), (5, "stale", 0, 0), (6, "equal", 1, 0), (99, "z", None, 0), (None, "o", 1, 0)], "k int, a string, v long, x int"))
    after = {r["k"]: tuple(r)[1:] for r in table.read().collect()}
    assert after[3] == ("newer", "b", 3) and after[4] == (None, "b", 2) and after[5] == ("a5", "b", 1) and after[6] == ("a6", "b", 1)
    assert after[99] == ("z", None, None) and after[None] == ("m", "b", 2) and len(after) == 42
    # Who began to read before sees the old rows; buckets that no change touched keep their folder.
    assert rows(seen) == rows(table.read(first.number)) and (3, "a3", "b", 1) in rows(seen)
    touched = {b for b, f in table.version().folders.items() if f != first.folders.get(b)}
    want = frame(spark, [(k,) for k in (3, 4, 5, 6, 99, None)], "k int").select(tables.bucket(["k"], 8)).distinct().collect()
    assert touched == {r[0] for r in want} and len(touched) < 8
    with pytest.raises(ValueError):
        table.upsert(frame(spark, [(1, "x")], "k int, a string"))
    with pytest.raises(ValueError):
        make(spark, tmp_path / "t")
    with pytest.raises(ValueError):
        StoredTable(spark, str(tmp_path / "none")).read()


def test_batch_upsert_keeps_absent_columns(spark):
    target = frame(spark, [(1, "a", "b", 1), (2, "a", "b", 5), (None, "a", "b", 1)])
    changes = frame(spark, [(1, None, 2), (2, "late", 5), (3, "c", 1), (3, "d", 2), (None, "e", 2)], "k int, a string, v long")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = rows(upsert(target, changes, ["k"], "v"))
    assert got == sorted([(1, None, "b", 2), (2, "a", "b", 5), (3, "d", None, 2), (None, "e", "b", 2)], key=repr)


def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    table = make(spark, tmp_path / "t")
    table.upsert(frame(spark, [(1, "a", "b", 1)]), "s", 0)
    before = rows(table.read())
    put = tables._Folder.put_if_absent

    def crash(self, name, text):
        raise OSError("lost")

    monkeypatch.setattr(tables._Folder, "put_if_absent", crash)
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, "x", "y", 2)]), "s", 1)
    monkeypatch.setattr(tables._Folder, "put_if_absent", put)
    assert rows(StoredTable(spark, table.path).read()) == before and table.progress("s").batch == 0
    assert table.upsert(frame(spark, [(1, "x", "y", 2)]), "s", 1) and not table.upsert(frame(spark, [(1, "z", "z", 9)]), "s", 1)
    assert rows(table.read()) == [(1, "x", "y", 2)] and table.progress("s") == tables.Progress(1, None, 2)
    table.forget("s")
    assert table.progress("s") is None and table.upsert(frame(spark, [(1, "z", "z", 9)]), "s", 0)
    table.remove_old(1)
    assert rows(table.read()) == [(1, "z", "z", 9)] and table._numbers() == [table.version().number]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    table, other = make(spark, tmp_path / "t", 1), StoredTable(spark, str(tmp_path / "t"))
    put, met = tables._Folder.put_if_absent, []

    def late(self, name, text):
        # Another writer commits between this one's read and its commit.
        if not met:
            met.append(name)
            other.upsert(frame(spark, [(1, "other", "o", 5), (2, "other", "o", 5)]))
        return put(self, name, text)

    monkeypatch.setattr(tables._Folder, "put_if_absent", late)
    table.upsert(frame(spark, [(1, "mine", "m", 1), (3, "mine", "m", 1)]))
    assert rows(table.read()) == [(1, "other", "o", 5), (2, "other", "o", 5), (3, "mine", "m", 1)]


def test_events_in_any_order(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    event = "k int, a string, v long, op string"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        table.apply_events(frame(spark, [(1, "x", 10, "insert"), (2, "x", 11, "insert"), (1, None, 12, "delete")], event), "op", "e", 0, ["v"])
        # Older ones that come late, and one that brings a key back.
        table.apply_events(frame(spark, [(1, "old", 9, "update"), (2, "y", 13, "update"), (3, None, 5, "delete")], event), "op", "e", 1, ["v"])
        assert rows(table.read()) == [(2, "y", None, 13)] and table.progress("e") == tables.Progress(1, ["13"], 6)
        table.apply_events(frame(spark, [(1, "back", 14, "insert"), (3, "late", 4, "insert")], event), "op", "e", 2, ["v"])
        table.apply_events(frame(spark, [(2, "z", 3, "update")], event), "op", "e", 3, ["v"])
    assert rows(table.read()) == [(1, "back", None, 14), (2, "y", None, 13)]
    assert rows(table.ledger()) == [("e", 3, ["14"], 9)]


def test_fetches_with_ties(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    data = [(i, i // 7 % 3, i % 4, 1) for i in range(50)] + [(90, None, 1, 1)]
    source = frame(spark, data, "k int, a int, b int, v long")
    typed = source.select("k", F.col("a").alias("x"), F.col("b").alias("y"), "v")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        counts = []
        while n := loading.fetch_new(typed, table, "f", ["x", "y"], ["k", "v"], 5):
            counts.append(n)
    assert sum(counts) == 50 and min(counts) >= 3 and sorted(r[0] for r in rows(table.read())) == list(range(50)) and table.progress("f").position == ["2", "3"]
    pairs = sorted((a, b) for _, a, b, _ in data if a is not None)
    got = read_incremental(typed, {"x": 1, "y": 2}).select("x", "y")
    assert rows(got) == [p for p in pairs if p > (1, 2)]
    assert read_incremental(typed, {"x": None, "y": None}, batch=1).count() == pairs.count(pairs[0])
    assert read_incremental(typed.limit(0), {"x": None}, batch=5).count() == 0


def test_a_stream_killed_between_commits_resumes(spark, tmp_path):
    table, calls = make(spark, tmp_path / "t"), []
    stream = lambda: loading.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    for n in range(4):
        frame(spark, [(i, f"n{n}", "b", n) for i in range(n, 10)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    real = StoredTable.upsert

    class Crashing(StoredTable):
        def upsert(self, changes, stream=None, batch=None, position=()):
            done = real(self, changes, stream, batch, position)
            calls.append((batch, done))
            # The data are committed, the stream's own progress is not.
            if len(calls) in (1, 3):
                raise OSError("killed")
            return done

    failing = Crashing(spark, table.path)
    for _ in range(3):
        try:
            run(loading.upsert_stream(stream(), failing, "s", str(tmp_path / "state"), ["v"]))
        except Exception as e:
            assert "killed" in str(e)
    assert calls == [(0, True), (0, False), (1, True), (1, False), (2, True), (3, True)]
    assert rows(table.read()) == [(i, f"n{min(i, 3)}", "b", min(i, 3)) for i in range(10)]
    assert table.progress("s") == tables.Progress(3, ["3"], 34)


def test_rate_cap_on_a_stream_equals_the_batch(spark, tmp_path):
    schema = "event_id long, t string, at long"
    base = [(i, "ab"[i % 2], i * 3) for i in range(60)]
    late = [(100, "a", 1), (101, "b", 171)]
    # In no order within each file; a later file holds events 30 seconds older; the last one closes all windows.
    files = [base[20:40][::-1], base[:20] + late, base[40:], [(999, "z", 100_000)], [(1000, "a", 0)]]
    for part in files:
        frame(spark, part, schema).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
        capped = alerts.rate_cap(stream, ["t"], seconds=10, lateness="200 seconds")
        run(capped.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start())
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("event_id", "t", "at"))
    whole = frame(spark, base + late, schema).withColumn("ts", F.timestamp_seconds("at"))
    assert got == rows(series.rate_cap(whole, ["t"]).select("event_id", "t", "at")) == rows(alerts.rate_cap(whole, ["t"]).select("event_id", "t", "at"))
