"""Exact top-k by inner product: a Voronoi kNN join over angles.

Queries and data join the cell of their nearest pivot by angle; the pivots are spherical means of a bounded sample,
and their number grows with the root of the data. Summaries of the cells (farthest query; farthest and longest data
row, the largest few lower bounds) and the scores of each query against the sample give, for each query cell, a score
per unit of query length that k rows surely reach. As angles obey the triangle inequality, a row at angle ``a`` from
its pivot is at least ``gap - far - a`` from any query of a cell, so its score per unit is at most its length times the
cosine of that. A row is sent only to groups of queries that it may matter to; scores of the survivors are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaykit.llm.common import cut

# Slack for rounding in the bounds, as a share of the longest row; the scores themselves are exact.
SLACK = 1e-6
# Two groups become one if together they need at most this share of what they need apart.
SHARED = 0.75
# Float64 sums of integer products are exact below this.
EXACT = 2.0**53


@dataclass(frozen=True)
class Sizes:
    """Production parameters: none of them changes the result."""

    # At most so many pivots; below, the root of the number of rows. Bounds what the driver holds.
    pivots: int = 1024
    # Rows that pivots are fitted to and that queries are scored against for a first bound.
    sample: int = 4096
    # Groups of query cells; each holds at most so many queries, more groups are made for more queries.
    groups: int = 8
    group_queries: int = 4096
    block_rows: int = 32_768


def scaled(vector: Column, factor: int = 1024) -> Column:
    """``floor(factor * x)`` of each component, as longs; null for a null vector or one with a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(factor)))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, short ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _angles(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ pivots.T, -1.0, 1.0))


def _fit_pivots(sample: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """``number`` unit vectors: farthest-first starts, then rounds of spherical means over the sample."""
    points = np.unique(_unit(sample), axis=0)
    points = points[points.any(axis=1)]
    if not len(points):
        return np.eye(1, sample.shape[1])
    chosen, closest = [0], points @ points[0]
    while len(chosen) < min(number, len(points)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, points @ points[chosen[-1]])
    pivots = points[chosen]
    for _ in range(rounds):
        sums = np.zeros_like(pivots)
        np.add.at(sums, (points @ pivots.T).argmax(axis=1), points)
        pivots = np.where(sums.any(axis=1, keepdims=True), _unit(sums), pivots)
    return pivots


def _chain(cells: np.ndarray, gaps: np.ndarray) -> list[int]:
    """Cells in an order in which each is followed by the nearest one left."""
    left, at, out = set(cells.tolist()), int(cells[0]), []
    while left:
        left.discard(at)
        out.append(at)
        rest = np.array(sorted(left), np.int64)
        if len(rest):
            at = int(rest[gaps[at, rest].argmin()])
    return out


def _plan(pivots: np.ndarray, queries: pd.DataFrame, cells: pd.DataFrame, near: pd.DataFrame, k: int, sizes: Sizes, slack: float):
    """Which rows of a data cell a group of queries needs, and where queries go: see ``top_k``.

    ``queries``: cell, n, far, reach (a score per unit of length that k candidates of each of its queries reach).
    ``cells``: cell, n, far, norm of the data. ``near``: cell, d, norm of the k + 1 data rows nearest to each pivot (one
    more, as a query's own row does not count). Bounded by the number of pivots, whatever the data.
    First result: group, data_cell, least (angle), enough (score per unit). Second: cell, part, parts, group.
    """
    gaps = _angles(pivots, pivots)
    np.fill_diagonal(gaps, 0.0)
    at, turn, length = near["cell"].to_numpy(np.int64), near["d"].to_numpy(), near["norm"].to_numpy()
    data_cell, spread, longest = cells["cell"].to_numpy(np.int64), cells["far"].to_numpy(), cells["norm"].to_numpy()
    held = cells["n"].to_numpy(np.int64)
    facts = {}
    for cell, n, far, reach in queries.itertuples(index=False):
        sure = -np.sort(-length * np.cos(np.minimum(np.pi, far + gaps[cell, at] + turn)))
        facts[int(cell)] = (int(n), far, max(reach, sure[k] if len(sure) > k else -np.inf))
    limit = max(1, min(sizes.group_queries, -(-sum(n for n, _, _ in facts.values()) // sizes.groups)))

    def bounds(members: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
        """Least angle to each data cell, the score that is reached, and which data cells may hold something."""
        least = np.min([gaps[c, data_cell] - facts[c][1] for c in members], axis=0)
        reach = min(facts[c][2] for c in members)
        return least, reach, longest * np.cos(np.clip(least - spread, 0.0, np.pi)) >= reach - slack

    def asked(members: list[int]) -> int:
        return sum(facts[c][0] for c in members)

    groups: list[list[int]] = []
    for cell in _chain(queries["cell"].to_numpy(np.int64), gaps):
        if groups and asked(groups[-1]) + facts[cell][0] <= limit:
            groups[-1].append(cell)
        else:
            groups.append([cell])
    # Neighbours that need mostly the same cells share one copy of them.
    merged: list[list[int]] = []
    for members in groups:
        if merged and asked(merged[-1]) + asked(members) <= sizes.group_queries:
            apart = sum(held[bounds(m)[2]].sum() for m in (merged[-1], members))
            if held[bounds(merged[-1] + members)[2]].sum() <= SHARED * apart:
                merged[-1] = merged[-1] + members
                continue
        merged.append(members)
    wanted, homes, group = [], [], 0
    for members in merged:
        # A cell beyond the limit makes several groups of its own.
        parts = max(1, -(-asked(members) // sizes.group_queries))
        least, reach, useful = bounds(members)
        for part in range(parts):
            homes += [(cell, part, parts, group + part) for cell in members]
            wanted += [(group + part, int(c), float(x), float(reach)) for c, x in zip(data_cell[useful], least[useful])]
        group += parts
    return (
        pd.DataFrame(wanted, columns=["group", "data_cell", "least", "enough"]),
        pd.DataFrame(homes, columns=["cell", "part", "parts", "group"]),
    )


def _facts(rows: DataFrame):
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.agg(
        F.max(square).alias("norm"), F.max(F.size("v")).alias("width"),
        F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("asked"),
    ).first()


def replicate(rows: DataFrame, k: int, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """Queries (``group, block, query_id, query``) and the data that they need (``group, block, id, v``).

    ``rows``: id, v, is_query, without nulls, at least one of them a query.
    """
    facts = _facts(rows)
    spark, width = rows.sparkSession, facts["width"]
    norm = float(np.sqrt(facts["norm"]))
    slack = SLACK * (1.0 + norm)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sizes.sample).select("id", "v").toArrow().combine_chunks()
    sample_ids = drawn.column("id").to_numpy()
    sample = _matrix(drawn.column("v").combine_chunks(), width)
    pivots = _fit_pivots(sample, min(sizes.pivots, max(1, int(np.sqrt(facts["n"])))))
    # At most ``sizes.sample`` rows and ``sizes.pivots`` vectors.
    shared = spark.sparkContext.broadcast((sample_ids, sample, pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_ids, sample, pivots = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                points, ids = _matrix(batch.column(1), width), batch.column(0).to_numpy()
                lengths = np.linalg.norm(points, axis=1)
                turns = _angles(_unit(points), pivots)
                cell = turns.argmin(axis=1)
                # Score per unit of length that k rows of the sample reach, for queries; a zero query takes any row.
                reach = np.full(len(points), -norm)
                asks = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False) & (lengths > 0))
                if len(asks) and len(sample_ids) > k:
                    scores = points[asks] @ sample.T
                    scores[ids[asks, None] == sample_ids[None, :]] = -np.inf
                    reach[asks] = np.maximum(-norm, -np.partition(-scores, k - 1, axis=1)[:, k - 1] / lengths[asks])
                # No angle is known of a zero row: it may be anywhere.
                turn = np.where(lengths > 0, turns[np.arange(len(points)), cell], np.pi)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(turn), pa.array(lengths), pa.array(reach)],
                    ["id", "v", "is_query", "cell", "d", "norm", "reach"],
                )

    placed = cut(
        rows.mapInArrow(assign, "id bigint, v array<bigint>, is_query boolean, cell int, d double, norm double, reach double")
    )
    asked = placed.filter("is_query")
    by_query_cell = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far"), F.min("reach").alias("reach"))
    by_cell = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far"), F.max("norm").alias("norm"))
    # Spark keeps the first k + 1 of each cell in each task before the shuffle, so a cell with many rows is no hot window.
    closest = Window.partitionBy("cell").orderBy("d", F.desc("norm"))
    near = placed.select("cell", "d", "norm", F.row_number().over(closest).alias("place")).filter(F.col("place") <= k + 1)
    wanted, homes = _plan(
        pivots, by_query_cell.toPandas(), by_cell.toPandas(), near.select("cell", "d", "norm").toPandas(), k, sizes, slack
    )

    asked = asked.select(F.col("cell").alias("home"), F.col("id").alias("query_id"), F.col("v").alias("query"))
    blocks = int(-(-facts["n"] // sizes.block_rows))
    # At most groups x pivots rows, and one row for each cell and part.
    wanted = F.broadcast(spark.createDataFrame(wanted, "group int, data_cell int, least double, enough double"))
    homes = F.broadcast(spark.createDataFrame(homes, "cell int, part int, parts int, group int"))
    most = F.col("norm") * F.cos(F.greatest(F.lit(0.0), F.col("least") - F.col("d")))
    sent = (
        placed.join(wanted, F.col("cell") == F.col("data_cell"))
        .filter(most >= F.col("enough") - slack)
        .select("group", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    )
    asking = (
        asked.join(homes, (F.col("home") == F.col("cell")) & (F.pmod(F.xxhash64("query_id"), "parts") == F.col("part")))
        .select("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query_id", "query")
    )
    return asking, sent


def top_k(
    data: DataFrame, queries: Column, k: int, row_id: str = "vec_id", vector: str = "vector", sizes: Sizes = Sizes()
) -> DataFrame:
    """``query_id, rank, <row_id>, score``: the ``k`` rows of largest inner product for each row of ``data`` where ``queries`` holds.

    ``vector`` holds whole numbers (``scaled``). A query's own id is no candidate; ties go to the smaller id; fewer
    candidates give fewer rows. Rows with a null id or vector take no part. An id that occurs repeatedly counts
    once, with its largest vector. A shorter vector counts as filled with zeros. Empty tables give no rows. Other
    columns are not read. Raises ValueError where products may leave the exact range of float64.
    """
    spark = data.sparkSession
    rows = data.filter(queries | F.lit(True)).select(
        F.col(row_id).alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")
    )
    rows = cut(rows.filter("id is not null and v is not null").groupBy("id").agg(F.max("v").alias("v"), F.max("is_query").alias("is_query")))
    facts = _facts(rows)
    result = f"query_id bigint, rank int, {row_id} bigint, score bigint"
    if not facts["asked"] or facts["n"] < 2:
        return spark.createDataFrame([], result)
    if facts["norm"] >= EXACT:
        raise ValueError("components are too large for exact products")
    width = facts["width"]
    asking, sent = replicate(rows, k, sizes)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, points = ids[order], _matrix(right.column("v").combine_chunks(), width)[order]
            asking_ids, vectors = left.column("query_id").to_numpy(), _matrix(left.column("query").combine_chunks(), width)
            for at in range(0, len(asking_ids), 256):
                scores = vectors[at : at + 256] @ points.T
                own = asking_ids[at : at + 256, None] == ids[None, :]
                scores[own] = -np.inf
                # Ids rise, so a stable order of scores breaks ties by the smaller id.
                kept = min(k, scores.shape[1])
                least = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1]
                for row, (line, bound) in enumerate(zip(scores, least)):
                    close = np.flatnonzero((line >= bound) & (line > -np.inf))
                    best = close[np.argsort(-line[close], kind="stable")[:k]]
                    out.append((np.full(len(best), asking_ids[at + row]), ids[best], line[best].astype(np.int64)))
        columns = [np.concatenate(c) if out else np.array([], np.int64) for c in (zip(*out) if out else ((), (), ()))]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", row_id, "score"])

    found = (
        asking.groupBy("group", "block")
        .cogroup(sent.groupBy("group", "block"))
        .applyInArrow(solve, f"query_id bigint, {row_id} bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", row_id, "score")
    )
