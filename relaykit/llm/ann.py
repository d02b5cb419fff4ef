"""Approximate nearest neighbours by cosine: one robust-pruned directed graph per shard of the data.

Points join a shard's graph in batches. A greedy beam search proposes neighbours; pruning goes through them from the
nearest and drops whatever is, by a relaxed margin, closer to a kept neighbour than to the point, so that edges stay
few and diverse. Queries search every shard with a beam, and the shards' best are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaykit.llm.common import cut


@dataclass(frozen=True)
class Graph:
    """Production parameters. Measured recall at 5 of the registered query: see README."""

    shard_rows: int = 6000
    degree: int = 28
    # Edges a point may gather from later ones before it is pruned again.
    slack: int = 56
    build_beam: int = 64
    search_beam: int = 160
    # How much closer a kept neighbour must be before it makes another one needless (of distances, not squares).
    relaxed: float = 1.15
    # Points that every search starts from.
    entries: int = 32
    query_block: int = 2048


def _search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries side by side: ids and cosines, best first; -1 where a beam has no more points."""
    b, width = len(queries), max(beam, len(entries))
    rows = np.arange(b)[:, None]
    ids = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -np.inf, np.float32)
    ids[:, : len(entries)] = entries
    sims[:, : len(entries)] = queries @ points[entries].T
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    done = ids < 0
    seen = np.zeros((b, len(points) + 1), bool)
    seen[:, entries] = True
    seen[:, -1] = True
    active = np.arange(b)
    step = 4
    while len(active):
        # The best points of each beam that have not been expanded yet.
        pending = ~done[active]
        rank = np.cumsum(pending, axis=1)
        take = pending & (rank <= step)
        alive = take.any(axis=1)
        active, take = active[alive], take[alive]
        if not len(active):
            break
        r, c = np.nonzero(take)
        new = np.full((len(active), step), -1, np.int32)
        new[r, (rank[alive][r, c] - 1)] = ids[active[r], c]
        done[active[r], c] = True
        near = np.where(new[:, :, None] >= 0, edges[new], -1).reshape(len(active), -1)
        # Within a row a point may stand twice; only its first place counts.
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        width_used = int((near >= 0).sum(axis=1).max(initial=0))
        if not width_used:
            continue
        near = -np.sort(-near, axis=1)[:, :width_used]
        found = np.einsum("bkd,bd->bk", points[near], queries[active], optimize=False)
        found[near < 0] = -np.inf
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    return ids, sims


def _prune(points: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """For each point of ``own``, at most ``degree`` diverse ones of its candidates ``near`` (-1: none)."""
    near = np.where(near == own[:, None], -1, near)
    vectors = points[near]
    gap = 1 - np.einsum("bkd,bd->bk", vectors, points[own], optimize=False)
    gap[near < 0] = np.inf
    kept = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for place in range(degree):
        best = gap.argmin(axis=1)
        real = np.isfinite(gap[rows, best])
        if not real.any():
            break
        kept[real, place] = near[rows, best][real]
        between = 1 - np.einsum("bkd,bd->bk", vectors, vectors[rows, best], optimize=False)
        gap[(relaxed * relaxed * between <= gap) & real[:, None]] = np.inf
        gap[rows, best] = np.inf
    return kept


def build_graph(points: np.ndarray, how: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows of point numbers, -1 filled) and entry points of a graph over unit vectors."""
    n = len(points)
    chance = np.random.default_rng(n)
    order = chance.permutation(n).astype(np.int32)
    entries = order[: min(n, how.entries)]
    edges = np.full((n, how.slack), -1, np.int32)
    first = min(n, max(how.degree, 2 * how.entries))
    start = order[:first]
    edges[start, : how.degree] = _prune(points, start, np.tile(start, (first, 1)), how.degree, how.relaxed)
    at, size = first, 64
    while at < n:
        batch = order[at : at + size]
        at, size = at + len(batch), min(512, size * 2)
        found, _ = _search(points, edges, points[batch], entries, how.build_beam)
        chosen = _prune(points, batch, found, how.degree, how.relaxed)
        edges[batch, : how.degree] = chosen
        source, target = np.repeat(batch, how.degree), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(np.append(heads, len(target)))
        wide = counts.max(initial=0)
        coming = np.full((len(heads), wide), -1, np.int32)
        coming[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(heads, counts)] = source
        points_to = target[heads]
        merged = np.concatenate([edges[points_to], coming], axis=1)
        full = (merged >= 0).sum(axis=1) > how.slack
        merged_light = -np.sort(-merged[~full], axis=1)[:, : how.slack]
        edges[points_to[~full]] = merged_light
        for part in np.array_split(np.flatnonzero(full), max(1, full.sum() // 256)):
            if len(part):
                edges[points_to[part]] = -1
                edges[points_to[part], : how.degree] = _prune(points, points_to[part], merged[part], how.degree, how.relaxed)
    return edges, entries


def _matrix(lists: pd.Series) -> np.ndarray:
    width = max(map(len, lists))
    out = np.zeros((len(lists), width))
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def usable(vector: Column) -> Column:
    """``vector`` as doubles; null where it is null, holds a null or non-finite component, or is zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & F.exists(wide, lambda x: x != 0), wide)


def nearest(
    data: DataFrame, queries: Column, k: int, row_id: str = "vec_id", vector: str = "embedding", how: Graph = Graph()
) -> DataFrame:
    """``query_id, rank, <row_id>, score``: about the ``k`` rows of largest cosine for each row where ``queries`` holds.

    The score is exact (double precision, original vectors), the choice approximate. Every usable row is in the
    index. A query's own id is no candidate; equal scores go by the smaller id. Equal vectors are one point that
    keeps its ``k + 1`` smallest ids, which is all a query can need. Rows with a null id or an unusable vector take no
    part; an id that occurs repeatedly counts once, with its largest vector; shorter vectors are filled with zeros.
    Empty tables give no rows. Other columns are not read.
    """
    spark = data.sparkSession
    rows = data.select(F.col(row_id).alias("id"), usable(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = cut(rows.filter("id is not null and v is not null").groupBy("id").agg(F.max("v").alias("v"), F.max("asks").alias("asks")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("v")).alias("width")).first()
    result = f"query_id bigint, rank int, {row_id} bigint, score double"
    if not facts["asks"] or facts["n"] < 2:
        return spark.createDataFrame([], result)
    width = facts["width"]
    alike = Window.partitionBy("v").orderBy("id")
    firsts = rows.select("id", "v", F.row_number().over(alike).alias("place")).filter(F.col("place") <= k + 1)
    shards, blocks = -(-facts["n"] // how.shard_rows), -(-facts["asks"] // how.query_block)
    points = firsts.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).cast("int")
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ids", key=lambda s: s.str[0], kind="stable").reset_index(drop=True)
        edges, entries = build_graph(_unit(_matrix(group["v"])), how)
        starts = np.zeros(len(group), bool)
        starts[entries] = True
        links = [line[line >= 0] for line in edges]
        return pd.DataFrame(
            {"shard": group["shard"], "node": np.arange(len(group), dtype=np.int32), "ids": group["ids"], "v": group["v"], "links": links, "entry": starts}
        )

    graph = cut(
        points.groupBy("shard").applyInPandas(
            build, "shard int, node int, ids array<bigint>, v array<double>, links array<int>, entry boolean"
        )
    )
    asking = rows.filter("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").alias("query_id"), F.col("v").alias("query"),
    )
    index = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("node").reset_index(drop=True)
            own, asked = np.zeros((len(right), width)), np.zeros((len(left), width))
            for target, lists in ((own, right["v"]), (asked, left["query"])):
                for row, values in enumerate(lists):
                    target[row, : len(values)] = values
            edges = np.full((len(right), how.slack), -1, np.int32)
            for row, values in enumerate(right["links"]):
                edges[row, : len(values)] = values
            unit, ids = _unit(own), right["ids"].tolist()
            norms = np.linalg.norm(own, axis=1)
            entries = np.flatnonzero(right["entry"].to_numpy()).astype(np.int32)
            for at in range(0, len(left), 256):
                vectors = asked[at : at + 256]
                found, _ = _search(unit, edges, _unit(vectors), entries, how.search_beam)
                for query_id, vector, nodes in zip(left["query_id"].iloc[at : at + 256], vectors, found):
                    nodes = nodes[nodes >= 0][: 4 * k + 8]
                    scores = (own[nodes] * vector).sum(axis=1) / (norms[nodes] * np.linalg.norm(vector))
                    hits = [(-s, i) for node, s in zip(nodes, scores.tolist()) for i in ids[node] if i != query_id]
                    out += [(query_id, i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", row_id, "score"])

    found = asking.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(
        search, f"query_id bigint, {row_id} bigint, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", row_id, "score")
    )
