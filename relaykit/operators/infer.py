"""Schema inference over VARIANT documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaykit.functions import sqltypes
from relaykit.functions.variant_arrays import LABELS, OBJECT, T_ARRAY, T_OBJECT, Run, distinct, runs

# Order in which labels win when one path carries several; numbers are widened within their group.
NUMERIC_LABELS = ["decimal", "double", "int64", "int32"]
NODE = T.StructType([T.StructField("path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("size", T.IntegerType())])


def document_paths(
    docs: DataFrame, id_col: str = "_id", doc: str = "doc", max_depth: int | None = None, element_cap: int | None = None
) -> DataFrame:
    """One row per node: ``[id, path, label, size]``; ``size`` is the length of an array.

    Documents are read once, and all open nodes of a run of documents are closed together, level by level, until none is left.
    Elements stand under ``path[]``; arrays inside arrays are labelled but not entered. A container at ``max_depth``
    is labelled as such and not entered. ``max_depth`` 0 or None: all levels.
    """
    given = docs.select(F.col(id_col), F.col(doc).alias("_doc"))
    schema = T.StructType([given.schema.fields[0], *NODE.fields])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = batch.column(1)
            for start, end in runs(documents):
                ids = batch.column(0).slice(start, end - start)
                for row, path, label, size in _nodes(Run(documents.slice(start, end - start)), max_depth, element_cap):
                    yield pa.RecordBatch.from_arrays([ids.take(row), path, label, size], names=schema.names)

    return given.mapInArrow(walked, schema)


def _nodes(run: Run, max_depth: int | None, element_cap: int | None, most: int = 100_000) -> Iterator[tuple[pa.Array, ...]]:
    """Nodes of all documents of a run, at most ``most`` at once: document row, path, label, size."""
    labels = pa.array(LABELS)
    paths: list[str] = []
    whole: dict[str, int] = {}  # number of each path in ``paths``

    def numbered(found: list[str]) -> np.ndarray:
        for path in found:
            if path not in whole:
                whole[path] = len(paths)
                paths.append(path)
        return np.array([whole[path] for path in found], np.int64)

    def inside(row: np.ndarray, path: np.ndarray, at: np.ndarray, under: bool) -> tuple[np.ndarray, ...]:
        parent, name, child = run.members(at, row)
        names = run.names
        first, second, which = distinct(path[parent], name, len(names))
        below = numbered([f"{paths[p]}.{names[n]}" if under else names[n] for p, n in zip(first.tolist(), second.tolist())])
        return row[parent], below[which], child

    roots = run.types(run.starts) == T_OBJECT
    row = run.rows[roots]
    todo = [(0, *inside(row, np.zeros_like(row), run.starts[roots], False))]
    while todo:
        level, row, path, at = todo.pop()
        if len(at) > most:
            todo += [(level, row[k : k + most], path[k : k + most], at[k : k + most]) for k in range(0, len(at), most)]
            continue
        if not len(at):
            continue
        last = bool(max_depth) and level >= max_depth
        types = run.types(at)
        label = run.scalar_labels(at, types)
        objects, arrays = np.flatnonzero(types == T_OBJECT), np.flatnonzero(types == T_ARRAY)
        size = np.full(len(at), -1, np.int32)
        if not last:
            # A container that is not entered is not looked into either.
            label[objects] = run.wrappers(at[objects], row[objects], types[objects])[0]
            objects = objects[label[objects] == OBJECT]
            size[arrays] = run.sizes(at[arrays], False)
            todo.append((level + 1, *inside(row[objects], path[objects], at[objects], True)))
            entered = np.array([not p.endswith("[]") for p in paths], bool)
            arrays = arrays[entered[path[arrays]]]
            parent, _, child = run.elements(at[arrays], element_cap)
            first, _, which = distinct(path[arrays][parent], np.zeros(len(parent), np.int64), 1)
            todo.append((level + 1, row[arrays][parent], numbered([f"{paths[p]}[]" for p in first.tolist()])[which], child))
        yield pa.array(row), pa.array(paths, pa.string()).take(pa.array(path)), labels.take(pa.array(label)), pa.array(size, mask=size < 0)


def _per_document(nodes: DataFrame, id_col: str, *keys: str, **counts: Column) -> DataFrame:
    """Counts nodes by ``keys``, keeping documents apart only where a path can repeat within one document.

    A path outside arrays occurs once per document, so those rows collapse on the map side; only paths under
    an array are shuffled by document, after a partial count.
    """
    repeats = F.when(F.col("path").contains("[]"), F.col(id_col))
    sums = {"n_nodes": F.count(F.lit(1)), **counts}
    return nodes.groupBy(repeats.alias("_doc"), *keys).agg(*[c.alias(n) for n, c in sums.items()])


def _documents() -> Column:
    return F.sum(F.when(F.col("_doc").isNull(), F.col("n_nodes")).otherwise(1))


def path_labels(nodes: DataFrame, id_col: str = "_id") -> DataFrame:
    """Documents and nodes per (path, label) of ``document_paths`` rows: ``[path, label, n_docs, n_nodes]``."""
    return (
        _per_document(nodes, id_col, "path", "label")
        .groupBy("path", "label")
        .agg(_documents().alias("n_docs"), F.sum("n_nodes").alias("n_nodes"))
    )


def merged_label(labels: Column) -> Column:
    """One label for a set of labels: containers, then the widest number, objectId, date, lone bool, string."""
    known = F.array_remove(labels, "null")
    merged = F.when(F.array_contains(labels, "object"), "object").when(F.array_contains(labels, "array"), "array")
    for name in [*NUMERIC_LABELS, "objectId", "date"]:
        merged = merged.when(F.array_contains(known, name), name)
    return merged.when((F.size(known) == 1) & F.array_contains(known, "bool"), "bool").otherwise("string")


def infer_schema(nodes: DataFrame) -> DataFrame:
    """Merged label per path of ``document_paths`` (or ``path_labels``) rows: ``[path, label]``."""
    return nodes.groupBy("path").agg(merged_label(F.collect_set("label")).alias("label"))


def sql_types(schema: DataFrame, overrides: dict[str, str] | None = None, **defaults) -> DataFrame:
    """Adds ``sql_type`` to ``[path, label]``; overrides and defaults are resolved once per label."""
    table = {label: sqltypes.label_type(label, overrides, **defaults) for label in sqltypes.LABEL_TYPES}
    return schema.withColumn("sql_type", F.coalesce(sqltypes.lookup(F.col("label"), table), F.lit("STRING")))


def path_report(nodes: DataFrame, id_col: str = "_id") -> DataFrame:
    """Presence, nulls and label conflicts per path of ``document_paths`` rows.

    ``n_docs`` documents hold the path, ``n_null`` of its nodes are null, ``conflict`` marks two or more labels.
    """
    found = _per_document(
        nodes, id_col, "path", nulls=F.count_if(F.col("label") == "null"), found=F.collect_set("label")
    )
    return (
        found.groupBy("path")
        .agg(
            _documents().alias("n_docs"),
            F.sum("n_nodes").alias("n_nodes"),
            F.sum("nulls").alias("n_null"),
            F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_set("found"))), "null")).alias("labels"),
        )
        .withColumn("conflict", F.size("labels") > 1)
        .withColumn("labels", F.array_join("labels", ","))
    )


def path_summary(nodes: DataFrame, id_col: str = "_id") -> DataFrame:
    """What inference keeps of a set of documents: ``[path, label, n_docs, n_nodes]``, with a null label for the whole path.

    Summaries of different documents add up (``merge_summaries``), so new documents are folded in without reading the
    old ones. Its size is that of the schema, not of the documents.
    """
    once = _per_document(nodes, id_col, "path", "label")
    by_path = once.groupBy("_doc", "path").agg(F.collect_list(F.struct("label", "n_nodes")).alias("labels"), F.sum("n_nodes").alias("n_nodes"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), "n_nodes"))
    every = by_path.select("_doc", "path", F.inline(F.concat(whole, "labels")))
    return every.groupBy("path", "label").agg(_documents().alias("n_docs"), F.sum("n_nodes").alias("n_nodes"))


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    """One summary for the documents of all; no document may be in two of them."""
    return reduce(DataFrame.unionByName, summaries).groupBy("path", "label").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_nodes").alias("n_nodes"))


def report_of(summary: DataFrame) -> DataFrame:
    """``path_report`` from a summary."""
    whole, null = F.col("label").isNull(), F.col("label") == "null"
    labels = F.array_sort(F.collect_set(F.when(~null, F.col("label"))))
    found = summary.groupBy("path").agg(
        F.max(F.when(whole, F.col("n_docs"))).alias("n_docs"), F.max(F.when(whole, F.col("n_nodes"))).alias("n_nodes"),
        F.coalesce(F.max(F.when(null, F.col("n_nodes"))), F.lit(0)).alias("n_null"), labels.alias("labels"),
    )
    return found.withColumn("conflict", F.size("labels") > 1).withColumn("labels", F.array_join("labels", ","))


def schema_of(summary: DataFrame) -> DataFrame:
    """``infer_schema`` from a summary."""
    return infer_schema(summary.filter("label is not null"))


def shape_profile(nodes: DataFrame, id_share: float = 0.9, small_array: int = 8) -> DataFrame:
    """Object and array paths with lengths, share of id-like elements and the suggested table shape.

    Arrays with at least ``id_share`` ids become junction tables; scalar arrays of at most ``small_array`` stay JSON.
    """
    # Nodes are counted by whole paths first: those of elements are cut for each path, not for each node.
    counted = nodes.groupBy("path").agg(
        *[F.count_if(F.col("label") == label).alias(label) for label in ("array", "object", "objectId")], F.count(F.lit(1)).alias("n"), F.max("size").alias("size")
    )
    element = F.col("path").endswith("[]")
    total = lambda where, name: F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0))
    per_path = counted.groupBy(F.regexp_replace("path", r"\[\]$", "").alias("path")).agg(
        total(~element, "array").alias("n_arrays"),
        total(~element, "object").alias("n_objects"),
        total(element, "n").alias("n_elements"),
        F.max(F.when(~element, F.col("size"))).alias("max_length"),
        total(element, "objectId").alias("n_ids"),
        total(element, "object").alias("n_element_objects"),
    )
    ids = F.col("n_ids") / F.nullif(F.col("n_elements"), F.lit(0))
    return (
        per_path.filter("n_arrays + n_objects > 0")
        .withColumn("mean_length", F.round(F.col("n_elements") / F.nullif(F.col("n_arrays"), F.lit(0)), 4))
        .withColumn("id_share", F.round(ids, 4))
        .withColumn(
            "suggestion",
            F.when(F.col("n_arrays") == 0, "columnize")
            .when(ids >= id_share, "junction_table")
            .when(F.col("n_element_objects") > 0, "child_table")
            .when(F.coalesce("max_length", F.lit(0)) <= small_array, "jsonb")
            .otherwise("child_table"),
        )
    )


def collect_labels(schema: DataFrame, most: int = 100_000) -> dict[str, str]:
    """The merged schema on the driver, one entry per path.

    More than ``most`` paths raise ValueError: then field names are data (ids as names), and such an object should be
    read as a map.
    """
    rows = schema.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} paths: some object uses its field names as data")
    return {row["path"]: row["label"] for row in rows}
