"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source is due the same number of copies: target over source size. The whole part is certain.
The fraction is an inclusion probability, rounded to 0 or 1 by walks in the null space of the balancing equations:
of three undecided documents, the one direction that changes neither their expected number nor their expected words
is followed until one of them is decided. Blocks of documents are walked side by side, each leaves at most two
undecided; these meet in the next level, until two are left for the whole source. Only they are landed off balance.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaykit.llm.common import cut, word_count

EDGE = 1e-9


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in order of their names, repeating; the mix has ``share`` times all words."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    # No source, and so no document, is taken more than so many times.
    most: float = 2.0
    # Documents walked in one task.
    block: int = 4096
    # The names and sizes of all sources are planned on the driver; more than this raise ValueError.
    sources: int = 200_000


def targets(sizes: Sequence[tuple[str | None, int]], mix: Mix = Mix()) -> dict[str | None, float]:
    """Words to take from each source: shares by weight, stopped at ``most`` times its size, the excess shared again."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: float(mix.weights[i % len(mix.weights)]) for i, (name, _) in enumerate(ordered)}
    limit = {name: mix.most * size for name, size in ordered}
    open_, found, rest = list(weight), {}, mix.share * sum(size for _, size in ordered)
    while open_:
        unit = rest / sum(weight[name] for name in open_)
        full = [name for name in open_ if unit * weight[name] > limit[name]]
        if not full:
            return found | {name: unit * weight[name] for name in open_}
        found |= {name: limit[name] for name in full}
        rest -= sum(limit[name] for name in full)
        open_ = [name for name in open_ if name not in found]
    return found


def _walk(rows: pd.DataFrame, land: bool) -> pd.Series:
    """New probabilities of the rows, all but two of them 0 or 1; with ``land`` all of them."""
    p, size = rows["p"].tolist(), rows["words"].astype(float).tolist()
    chance = random.Random(f"{rows['key'].iloc[0]}:{len(rows)}")
    held: list[int] = []
    for row in range(len(p)):
        held.append(row)
        if len(held) < 3:
            continue
        a, b, c = (size[i] for i in held)
        step = (b - c, c - a, a - b)
        if not any(step):
            step = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / s if s > 0 else p[i] / -s) for i, s in zip(held, step) if s)
        down = min((p[i] / s if s > 0 else (1 - p[i]) / -s) for i, s in zip(held, step) if s)
        length = up if chance.random() * (up + down) < down else -down
        for i, s in zip(held, step):
            p[i] += length * s
            p[i] = 0.0 if p[i] < EDGE else 1.0 if p[i] > 1 - EDGE else p[i]
        held = [i for i in held if 0 < p[i] < 1]
        if len(held) == 3:  # rounding left the decided one short of its end
            nearest = min(held, key=lambda i: min(p[i], 1 - p[i]))
            p[nearest] = float(round(p[nearest]))
            held.remove(nearest)
    if land and held:
        # The few ways to land: the nearest to the words due, then to the number due.
        def miss(ends: tuple[int, ...]) -> tuple[float, float]:
            off = [e - p[i] for i, e in zip(held, ends)]
            return abs(sum(o * size[i] for o, i in zip(off, held))), abs(sum(off))

        ways = [()]
        for _ in held:
            ways = [w + (e,) for w in ways for e in (0, 1)]
        for i, e in zip(held, min(ways, key=miss)):
            p[i] = float(e)
    return pd.Series(p, index=rows.index)


def _walker(land: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "words"], kind="stable").reset_index(drop=True)
        return group.assign(p=_walk(group, land)).drop(columns="block")

    return walk


def plan_mix(df: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", row_id: str = "doc_id") -> DataFrame:
    """``row_id, source, text_hash, rows, size, source_size, target, copies``: the decision for each distinct document.

    Size is the number of words; a null text has 0. Rows that agree in id, source and text are one document with
    ``rows`` rows and share a decision. A null source is a source of its own, last in order; a null id is an id. The
    choice depends on the rows alone, not on their order or partitions. An empty table gives no rows. Each source's
    words come within about its largest document of the target. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(row_id).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("text_hash"), word_count(F.col(text)).alias("size")
    )
    units = cut(
        rows.groupBy("source", "id", "text_hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    )
    by_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("words"), F.count(F.lit(1)).alias("units")
    ).limit(mix.sources + 1).collect()
    if len(by_source) > mix.sources:
        raise ValueError(f"more than {mix.sources} sources")
    due = targets([(r["source"], r["words"]) for r in by_source], mix)
    table = spark.createDataFrame(
        [(r["source"], r["words"], due[r["source"]], -(-r["units"] // mix.block)) for r in by_source],
        "name string, source_size bigint, target double, blocks bigint",
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = (
        units.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("rate", rate)
        .withColumn("whole", F.floor(F.col("rate") + EDGE))
        .withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
        .withColumn("p", F.when(F.col("p") < EDGE, F.lit(0.0)).otherwise(F.col("p")))
        .withColumn("key", F.xxhash64("source", "id", "text_hash"))
        .withColumn("words", F.col("size") * F.col("rows"))
        .select("id", "source", "text_hash", "rows", "size", "source_size", "target", "whole", "p", "key", "words", "blocks")
    )
    decided, open_ = state.filter("p <= 0 or p >= 1"), state.filter("p > 0 and p < 1")
    most = max((-(-r["units"] // mix.block) for r in by_source), default=0)
    while most:
        block = F.pmod(F.xxhash64("key", F.lit(most)), F.col("blocks"))
        walked = open_.withColumn("block", block).groupBy("source", "block").applyInPandas(_walker(most == 1), open_.schema)
        walked = cut(walked)
        decided = decided.union(walked.filter("p <= 0 or p >= 1"))
        # Each block of the level leaves two at most.
        open_ = walked.filter("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * 2 / F.lit(mix.block)).cast("long"))
        most = 0 if most == 1 else -(-2 * most // mix.block)
    return decided.select(
        F.col("id").alias(row_id), F.col("source"), "text_hash", "rows", "size", "source_size", "target",
        (F.col("whole") + F.col("p")).cast("long").alias("copies"),
    )


def mix_documents(df: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (none, once, twice), with all their columns and no new one."""
    plan = plan_mix(df, mix, text, source, row_id).select(
        F.col(row_id).alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("text_hash").alias("_mix_hash"), F.col("copies").alias("_mix_copies")
    ).filter("_mix_copies > 0")
    same = (
        df[row_id].eqNullSafe(F.col("_mix_id")) & df[source].eqNullSafe(F.col("_mix_source"))
        & (F.xxhash64(df[text]) == F.col("_mix_hash"))
    )
    taken = df.join(plan, same).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return taken.select(*[df[c] for c in df.columns])
