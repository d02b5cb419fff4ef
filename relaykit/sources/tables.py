"""Stored tables that change by key: hash buckets, versions, and what was loaded, committed together.

A version is a small file under ``_versions`` that names the folder of each bucket, and how far each stream has been
applied. Readers take the newest version and keep it, so they never see half of a write. A write replaces the buckets
that its changes touch, in new folders, and then puts the next version in place by one rename that fails if another
writer was first. Data and progress become visible together; a batch that comes again is known by its number.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, MapType, StructField, StructType, VariantType

DELETED = "_deleted"
_RETRIES = 5


class _Folder:
    """Small files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.path = spark._jvm, spark.sparkContext._gateway, path
        self.conf = spark._jsc.hadoopConfiguration()
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def at(self, name: str):
        return self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def names(self) -> list[str]:
        root = self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(self.path))
        return [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """The whole file appears at once, or nothing does; False if there is one already."""
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self.context.rename(self.at(draft), self.at(name), how)
            return True
        except Py4JJavaError as e:
            self.fs.delete(self.at(draft), False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass(frozen=True)
class Progress:
    """How far a stream was applied: its last batch, the greatest position so far (texts of its columns), and the rows."""

    batch: int
    position: list[str] | None = None
    n_rows: int = 0


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    key: list[str]
    order: str
    buckets: int
    # Folder of each bucket that holds rows.
    folders: dict[int, str] = field(default_factory=dict)
    progress: dict[str, Progress] = field(default_factory=dict)

    def to_json(self) -> str:
        body = {"number": self.number, "schema": self.schema.jsonValue(), "key": self.key, "order": self.order, "buckets": self.buckets, "folders": self.folders}
        return json.dumps(body | {"progress": {name: vars(p) for name, p in self.progress.items()}})

    @staticmethod
    def from_json(text: str) -> Version:
        body = json.loads(text)
        progress = {name: Progress(**p) for name, p in body.pop("progress").items()}
        folders = {int(b): f for b, f in body.pop("folders").items()}
        return Version(schema=StructType.fromJson(body.pop("schema")), folders=folders, progress=progress, **body)


class StoredTable:
    """A table under ``path`` whose rows are told apart by ``key``, of which the one with the highest ``order`` counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = _Folder(spark, f"{self.path}/_versions")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], order: str, buckets: int = 64) -> StoredTable:
        """An empty table; ``buckets`` should let one bucket fit into a task."""
        missing = [c for c in (*key, order) if c not in schema.names]
        if missing or DELETED in schema.names:
            raise ValueError(f"no columns {missing}" if missing else f"{DELETED} is a reserved name")
        table = cls(spark, path)
        whole = StructType([*schema.fields, StructField(DELETED, BooleanType())])
        if not table._versions.put_if_absent("0", Version(0, whole, list(key), order, buckets).to_json()):
            raise ValueError(f"there is a table in {path}")
        return table

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._versions.names() if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, the newest one by default."""
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"no table in {self.path}")
        return Version.from_json(self._versions.read(str(numbers[-1] if number is None else number)))

    def progress(self, stream: str) -> Progress | None:
        return self.version().progress.get(stream)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of one version, fixed when this is called."""
        version = self.version(number)
        return self._rows(version, list(version.folders)).filter(~F.col(DELETED)).drop(DELETED)

    def _rows(self, version: Version, buckets: Sequence[int]) -> DataFrame:
        folders = [f"{self.path}/{version.folders[b]}" for b in buckets if b in version.folders]
        if not folders:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*folders)

    def upsert(self, changes: DataFrame, stream: str | None = None, batch: int | None = None, position: Sequence[str] = ()) -> bool:
        """Inserts or updates by key, and says whether anything was committed.

        A change counts if its ``order`` is higher than the stored row's, so stale and repeated changes do nothing.
        Columns that the table lacks are ignored, those that ``changes`` lacks keep their stored values; both are
        warned of. With ``stream`` and ``batch`` a batch that is not above the last committed one is left out. The
        greatest value of the columns ``position`` (compared in their order) is kept as the stream's position.
        """
        return self._apply(changes, F.lit(False), stream, batch, position, [])

    def apply_events(self, events: DataFrame, op: str, stream: str | None = None, batch: int | None = None, position: Sequence[str] = ()) -> bool:
        """Like ``upsert``, with an operation (insert, update, delete) for each event; the table's order is the position.

        A deleted key is remembered, so that an older event that comes later does not bring it back.
        """
        return self._apply(events, F.coalesce(F.col(op) == "delete", F.lit(False)), stream, batch, position, [op])

    def _apply(self, changes: DataFrame, deletes: Column, stream: str | None, batch: int | None, position: Sequence[str], used: Sequence[str]) -> bool:
        version = self.version()
        if self._is_done(version, stream, batch):
            return False
        names = [c for c in version.schema.names if c != DELETED]
        ignored, absent = [c for c in changes.columns if c not in {*names, *position, *used}], [c for c in names if c not in changes.columns]
        if set(absent) & {*version.key, version.order}:
            raise ValueError(f"changes lack {sorted(set(absent) & {*version.key, version.order})}")
        if ignored or absent:
            warnings.warn(f"columns of changes only: {ignored}; of the table only: {absent}", stacklevel=3)
        given = [c for c in names if c not in absent]
        typed = [F.col(f"`{c}`").cast(version.schema[c].dataType).alias(c) for c in given]
        columns = [F.col(f"`{c}`") for c in position]
        place = F.struct(*columns, *[c.cast("string").alias(f"_text_{i}") for i, c in enumerate(columns)]) if position else F.lit(None).cast("string")
        place = reduce(lambda found, c: F.when(c.isNotNull(), found), columns, place)
        rows = changes.select(*typed, deletes.alias(DELETED), place.alias("_position"), bucket(version.key, version.buckets).alias("_bucket"))
        # Repeated changes of a key are reduced before anything meets the stored rows.
        ranks = [c for c in (version.order, *given) if not isinstance(version.schema[c].dataType, (MapType, VariantType))]
        latest = F.max_by(F.struct(*given, DELETED), F.struct(*ranks, DELETED)).alias("change")
        few = rows.groupBy("_bucket", *version.key).agg(latest, F.max("_position").alias("_position"), F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = few.groupBy("_bucket").agg(F.max("_position").alias("position"), F.sum("_n").alias("n")).collect()
            seen = max((r["position"] for r in found if r["position"] is not None), default=None)
            kinds = {c: changes.schema[c].dataType for c in position}
            for _ in range(_RETRIES):
                folders = self._merged(version, few.select("_bucket", "change"), given, [r["_bucket"] for r in found]) if found else {}
                after = replace(version, number=version.number + 1, folders={**version.folders, **folders})
                if stream is not None and batch is not None:
                    before = version.progress.get(stream, Progress(-1))
                    texts = list(seen)[len(kinds) :] if seen else None
                    done = Progress(batch, self._later(before.position, texts, kinds), before.n_rows + sum(r["n"] for r in found))
                    after = replace(after, progress={**version.progress, stream: done})
                if self._versions.put_if_absent(str(after.number), after.to_json()):
                    return True
                # Another writer was first: its buckets are merged anew.
                version = self.version()
                if self._is_done(version, stream, batch):
                    return False
            raise RuntimeError(f"other writers of {self.path} were first {_RETRIES} times")
        finally:
            few.unpersist()

    def _later(self, a: list[str] | None, b: list[str] | None, kinds: dict[str, DataType]) -> list[str] | None:
        if not a or not b:
            return a or b
        x, y = (F.struct(*[F.lit(t).cast(k) for t, k in zip(texts, kinds.values())]) for texts in (a, b))
        return b if self.spark.range(1).select(y > x).first()[0] else a

    def ledger(self) -> DataFrame:
        """``stream, batch, position, n_rows`` of every stream that was applied."""
        rows = [(n, p.batch, p.position, p.n_rows) for n, p in self.version().progress.items()]
        return self.spark.createDataFrame(rows, "stream string, batch long, position array<string>, n_rows long")

    @staticmethod
    def _is_done(version: Version, stream: str | None, batch: int | None) -> bool:
        return stream is not None and batch is not None and stream in version.progress and batch <= version.progress[stream].batch

    def _merged(self, version: Version, few: DataFrame, given: Sequence[str], touched: Sequence[int]) -> dict[int, str]:
        """Writes the touched buckets with their changes to a new folder."""
        names = version.schema.names
        stored = self._rows(version, touched).select(bucket(version.key, version.buckets).alias("_bucket"), F.struct(*names).alias("old"), F.lit(None).cast(few.schema["change"].dataType).alias("change"))
        both = stored.unionByName(few.withColumn("old", F.lit(None).cast(stored.schema["old"].dataType)))
        keys = [F.coalesce(F.col("old")[k], F.col("change")[k]).alias(f"_key_{k}") for k in version.key]
        # Dealt by bucket, which also groups the keys: one shuffle, one file a bucket.
        dealt = both.select("*", *keys).repartition(len(touched), "_bucket")
        pairs = dealt.groupBy("_bucket", *[f"_key_{k}" for k in version.key]).agg(F.first("old", ignorenulls=True).alias("old"), F.first("change", ignorenulls=True).alias("change"))
        old, change = F.col("old")[version.order], F.col("change")[version.order]
        newer = F.col("change").isNotNull() & (F.col("old").isNull() | F.coalesce(change > old, old.isNull() & change.isNotNull()))
        kept = lambda c: F.when(newer & F.col(f"old.{DELETED}"), None).otherwise(F.col("old")[c])
        fields = [F.when(newer, F.col("change")[c]).otherwise(F.col("old")[c]).alias(c) if c in given or c == DELETED else kept(c).alias(c) for c in names]
        folder = f"data/{version.number + 1}-{uuid.uuid4().hex}"
        pairs.withColumn("_keep", newer).select("_bucket", *fields).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {b: f"{folder}/_bucket={b}" for b in touched}

    def forget(self, stream: str) -> None:
        """Drops a stream's progress: its batches count anew, as a reload needs."""
        while True:
            version = self.version()
            left = {n: p for n, p in version.progress.items() if n != stream}
            if self._versions.put_if_absent(str(version.number + 1), replace(version, number=version.number + 1, progress=left).to_json()):
                return

    def remove_old(self, keep: int = 2) -> None:
        """Removes versions before the last ``keep`` and the folders that none of the others names; no reader may still use them."""
        numbers = self._numbers()
        named = {f.split("/")[1] for n in numbers[-keep:] for f in self.version(n).folders.values()}
        newest = max(numbers, default=0)
        for n in numbers[:-keep]:
            self._versions.remove(str(n))
        data = _Folder(self.spark, f"{self.path}/data")
        for name in data.names():
            # Folders of writes under way have a higher number.
            if name not in named and int(name.split("-")[0]) <= newest:
                data.remove(name)


def bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int")
