"""Metric files ``scenario/test<i>/<instance>.csv.gz`` as a data source to write to.

    dealt(metrics).write.format("metric_files").option("path", folder).mode("append").save()

Each task writes whole files to a staging folder; the commit moves them into place, an abort removes them, so a job
that fails leaves nothing behind. The folder may be in any file system that pyarrow reaches.
"""

from __future__ import annotations

import csv
import gzip
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

if TYPE_CHECKING:
    from pyarrow import RecordBatch

PLACE = ("scenario", "test", "instance")


def dealt(metrics: DataFrame) -> DataFrame:
    """The rows of each file in one task, in order of time; a file holds one instance's metrics of one test."""
    return metrics.repartition(*PLACE).sortWithinPartitions(*PLACE, *(["ts"] if "ts" in metrics.columns else []))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    # Staged file and its place, relative to the folder.
    files: list[tuple[str, str]]


class MetricFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        self.folder, self.names, self.overwrite = folder, schema.names, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        missing = [c for c in PLACE if c not in self.names]
        if missing:
            raise ValueError(f"metrics need the columns {missing}")

    def write(self, batches: Iterator[RecordBatch]) -> Written:
        system, root = _open(self.folder)
        stage = f"{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(posixpath.join(root, stage), recursive=True)
        columns = [c for c in self.names if c not in PLACE]
        files: list[tuple[str, str]] = []
        seen: set[str] = set()
        place, out = None, None
        for batch in batches:
            values = dict(zip(self.names, (column.to_pylist() for column in batch.columns)))
            done = 0
            for spot, run in groupby(zip(*[values[c] for c in PLACE])):
                now, first = f"{spot[0]}/test{spot[1]}/{spot[2]}.csv.gz", done
                done += sum(1 for _ in run)
                if now != place:
                    if out:
                        out.close()
                    if now in seen or None in spot:
                        raise ValueError(f"rows of {now} must have a place, and stand together: use dealt()")
                    seen.add(now)
                    place = now
                    files.append((f"{stage}/{len(files)}", now))
                    out = io.TextIOWrapper(gzip.GzipFile(fileobj=system.open_output_stream(posixpath.join(root, files[-1][0])), mode="wb", compresslevel=6, mtime=0), "utf-8", newline="")
                    lines = csv.writer(out, lineterminator="\n")
                    lines.writerow(columns)
                lines.writerows(zip(*[values[c][first:done] for c in columns]) if columns else [()] * (done - first))
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.folder)
        files = [f for m in messages if m for f in m.files]
        places = [place for _, place in files]
        twice = {p for p in places if places.count(p) > 1} if len(places) != len(set(places)) else set()
        if twice:
            self._clear()
            raise ValueError(f"several tasks wrote {sorted(twice)[:3]}: use dealt()")
        if self.overwrite:
            for info in system.get_file_info(_selector(root)):
                if not info.base_name.startswith("_staging-"):
                    (system.delete_dir if info.type.name == "Directory" else system.delete_file)(info.path)
        for staged, place in files:
            target = posixpath.join(root, place)
            system.create_dir(posixpath.dirname(target), recursive=True)
            system.move(posixpath.join(root, staged), target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _open(self.folder)
        try:
            system.delete_dir(posixpath.join(root, self.staging))
        except FileNotFoundError:
            pass


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True)


class MetricFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metric_files"

    def writer(self, schema: StructType, overwrite: bool) -> MetricFilesWriter:
        return MetricFilesWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetricFiles)


def write_metrics(metrics: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A gzip CSV file for each scenario, test and instance; files of the same place are replaced."""
    register(metrics.sparkSession)
    # Written by Spark, times are those of the session's zone.
    texts = {f.name: F.col(f"`{f.name}`").cast("string") for f in metrics.schema.fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))}
    dealt(metrics).withColumns(texts).write.format("metric_files").option("path", folder).mode("overwrite" if overwrite else "append").save()


def read_metrics(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The columns of ``schema`` with ``scenario, test, instance`` from the files' places."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz").csv(folder).withColumn("_file", F.input_file_name())
    part = lambda n: F.url_decode(F.regexp_extract("_file", r"([^/]+)/test([^/]+)/([^/]+)\.csv\.gz$", n))
    return rows.select("*", part(1).alias("scenario"), part(2).cast("int").alias("test"), part(3).alias("instance")).drop("_file")
