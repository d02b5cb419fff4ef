"""Near copies by the exact Jaccard similarity of word shingles, found by SimHash and completed by prefix filtering.

First come the links of SimHash fingerprints through the anchors of a covering code (``simhash``), each confirmed by whole
sets. Similar texts may have fingerprints further apart, so what SimHash left apart is completed by prefix filtering.

The shingles of each text are put into one order that holds for all texts. Of two sets with a similarity of at
least ``t``, the first ``n - ceil(t * n) + 1`` shingles (the prefix) of both have one in common. So texts meet at
the shingles of their prefixes, and each pair that meets is compared by its whole sets. No similar pair is lost,
whatever the order is; common shingles come last, which keeps the meetings small.

Where many meet at one shingle, each is compared with the first few only. Then rounds follow: in each, other members of the
shingle are drawn, and those of other components are compared with them, until little is left or little is gained. Only
what is not connected by then is compared pair by pair. Before whole sets are compared, 512 parities of each
set tell how far two sets must be apart at least: their differing bits never outnumber the shingles of just one set.
Whole sets are made again from the texts, for those alone that the parities leave in doubt.
So a large group of near copies is connected by a few comparisons a member, and what remains gives few pairs.
"""

from __future__ import annotations

import hashlib
import math
import operator
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaykit.llm import simhash
from relaykit.llm.common import cut, slices
from relaykit.llm.components import connected_components

# Shingles are counted by the highest bits of their hash. The counts only give the order.
SLOT_BITS = 18
# Whoever meets at a shingle is compared with this many first.
PIVOTS = 4
# More that meet at one shingle and are not connected are compared with so many drawn ones a round, until no more than
# FEW pairs for each of them are left, or a round leaves more than the share WORTH of the pairs. The rest goes by blocks.
DRAWN = 4
FEW = 4
WORTH = 0.7
BLOCK = 20_000
# Parities of a set are held in so many 64-bit words.
WORDS = 8
_PARITY = [f"w{i}" for i in range(WORDS)]
_KEYS = ["_key", "_second_key"]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles: words as in ``simhash.fingerprint``, a shorter text is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.array([], np.uint64)
    last = max(1, len(found) - words + 1)
    hashes = (xxhash.xxh64_intdigest(b" ".join(found[i : i + words])) for i in range(last))
    return np.unique(np.fromiter(hashes, np.uint64, last))


def _node(found: np.ndarray) -> int:
    """Name of a set: 64 bits of its MD5."""
    return int.from_bytes(hashlib.md5(found.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True)


def node(text: Column, words: int) -> Column:
    """Name of a text's set of shingles; equal for equal sets."""

    @F.arrow_udf("bigint")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_node(shingles(t, words)) for t in batch.to_pylist()], pa.int64())

    return named(text)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles fall into each slot; the table has one size for any input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, _slot(shingles(text, words)), 1)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["slot", "n"])

    found = texts.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def _may_reach(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets of these sizes can be similar if the shingle at these places is the first that they share."""
    a, b = n[i].astype(np.int64), n[j].astype(np.int64)
    common = np.minimum(a - place[i], b - place[j])
    return common * (least.numerator + least.denominator) >= least.numerator * (a + b)


def _meetings(texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """``shingle, node, n, place``: the prefix of each set, with the size of the set and the place in its order."""
    shared = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, words))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done = shared.value, set()
        for batch in batches:
            for part in slices(batch, 0):
                out = []
                for text in part.column(0).to_pylist():
                    found = shingles(text, words)
                    name = _node(found)
                    if len(found) and name not in done:
                        done.add(name)
                        order = np.lexsort((found, counts[_slot(found)]))
                        size = len(found)
                        prefix = found[order[: size - -(-size * least.numerator // least.denominator) + 1]]
                        out.append((prefix, np.full(len(prefix), name), np.full(len(prefix), size, np.int32), np.arange(len(prefix), dtype=np.int32)))
                if out:
                    shingle, names, sizes, places = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(names), pa.array(sizes), pa.array(places)], ["shingle", "node", "n", "place"])

    return texts.mapInArrow(spread, "shingle bigint, node bigint, n int, place int")


def _first_pairs(meetings: DataFrame, least: Fraction) -> DataFrame:
    """Everyone at a shingle with its first ``PIVOTS`` (``a, b``), and all others for themselves (``a`` and the rest, no ``b``)."""
    names = ["shingle", "a", "b", "n", "place"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first ones at the last shingle so far, and the last row.
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            # Copies in other tasks sent the same rows; they are neighbours.
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)
            if before is not None:
                fresh[0] = (columns[0][0], columns[1][0]) != before
            before = (columns[0][-1], columns[1][-1])
            columns = [c[fresh] for c in columns]
            old = 0
            if held is not None:
                old = len(held[0])
                columns = [np.concatenate(c) for c in zip(held, columns)]
            shingle, node, n, place = columns
            heads = np.flatnonzero(np.diff(shingle, prepend=~shingle[0]))
            start = np.repeat(heads, np.diff(np.append(heads, len(shingle))))
            rank = np.arange(len(shingle)) - start
            new = np.arange(len(shingle)) >= old
            for k in range(PIVOTS):
                i = np.flatnonzero(new & (rank > k))
                j = start[i] + k
                fits = _may_reach(n, place, i, j, least)
                i, j = i[fits], j[fits]
                if len(i):
                    none = pa.nulls(len(i), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(i), pa.int64()), pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), none, none], names
                    )
            i = np.flatnonzero(new & (rank >= PIVOTS))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(shingle[i]), pa.array(node[i]), pa.nulls(len(i), pa.int64()), pa.array(n[i]), pa.array(place[i])], names)
            last = heads[-1]
            held = [c[last : last + PIVOTS].copy() for c in columns]

    dealt = meetings.repartition("shingle").sortWithinPartitions("shingle", "node")
    return dealt.mapInArrow(pair, "shingle bigint, a bigint, b bigint, n int, place int")


def _parity(found: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in ``64 * WORDS`` slots, as signed words."""
    odd = np.bincount((found & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _marks(rows: DataFrame, words: int) -> DataFrame:
    """``id``, the name, fingerprint, size and parities of each text's set, and the keys: all in one pass by one worker a task."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = [shingles(t, words) for t in texts]
                prints = [simhash.text_fingerprint(t, words) for t in texts]
                parity = np.array([_parity(f) for f in found]).reshape(len(found), WORDS).T
                columns = [pa.array([_node(f) for f in found], pa.int64()), pa.array(prints, pa.int64()), pa.array([len(f) for f in found], pa.int32()), *map(pa.array, parity)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(2), part.column(3)], names)

    added = rows.sparkSession.createDataFrame([], "node bigint, fingerprint bigint, n int, " + ", ".join(f"{w} bigint" for w in _PARITY)).schema
    kind = StructType([rows.schema["id"], *added.fields, *[rows.schema[k] for k in _KEYS]])
    names = kind.names
    return rows.select("id", "text", *_KEYS).mapInArrow(mark, kind)


def _sets(nodes: DataFrame, rows: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """``node, found``: the whole sets of ``nodes``. ``rows`` has ``text`` and its keys, ``first`` the keys of one text of each node."""
    chosen = nodes.join(first, "node").select("node", "first._key", "first._second_key")
    # Rows of one key lie together after the join, so copies go without another shuffle of texts.
    texts = rows.join(chosen, _KEYS).dropDuplicates([*_KEYS, "node"]).select("text", "node")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingles(t, words).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.binary())], ["node", "found"])

    return cut(texts.mapInArrow(whole, "node bigint, found binary"))


def _similar(pairs: DataFrame, signs: DataFrame, whole: Callable[[DataFrame], DataFrame], least: Fraction) -> DataFrame:
    """The ``pairs`` whose whole sets are similar. ``whole`` makes the sets; only those that parities leave in doubt are made."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int(np.count_nonzero(large[at] == small))
                good.append(common * (least.numerator + least.denominator) >= least.numerator * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    near = cut(_near(pairs, signs, least))
    if near.isEmpty():
        return near
    sets = whole(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    both = near.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(compare, "a bigint, b bigint"))


def _near(pairs: DataFrame, signs: DataFrame, least: Fraction) -> DataFrame:
    """The ``pairs`` that parities do not rule out."""
    names = ["n", *_PARITY]
    side = lambda key, mark: signs.select(F.col("node").alias(key), *[F.col(c).alias(f"{mark}{c}") for c in names])
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(_may_agree("x", "y", least)).select("a", "b")


def _may_agree(x: str, y: str, least: Fraction) -> Column:
    differing = reduce(operator.add, [F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))) for w in _PARITY])
    return differing * (least.numerator + least.denominator) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (least.denominator - least.numerator)


def _drawn_pairs(members: DataFrame, turn: int, least: Fraction) -> DataFrame:
    """``a, b``: members of each shingle with some drawn ones of other components, unless sizes, places or parities rule it out."""
    names = ["node", "component", "n", "place", *_PARITY]
    draw = [F.min(F.struct(F.xxhash64(F.lit(turn * DRAWN + k), "node").alias("_rank"), *names)).alias(f"d{k}") for k in range(DRAWN)]
    drawn = members.groupBy("shingle").agg(*draw)
    drawn = drawn.select("shingle", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"d{k}.{c}").alias(c) for c in names]) for k in range(DRAWN)]))).alias("d"))
    met = members.join(drawn.select("shingle", *[F.col(f"d.{c}").alias(f"y{c}") for c in names]), "shingle").filter("component <> ycomponent")
    common = F.least(F.col("n") - F.col("place"), F.col("yn") - F.col("yplace"))
    reach = common * (least.numerator + least.denominator) >= (F.col("n") + F.col("yn")) * least.numerator
    return met.filter(reach & _may_agree("", "y", least)).select(F.least("node", "ynode").alias("a"), F.greatest("node", "ynode").alias("b")).distinct()


def _all_pairs(members: DataFrame, sizes: DataFrame, least: Fraction) -> DataFrame:
    """``a, b``: all members of each shingle that are of different components, unless sizes, places or parities rule it out."""
    open_rows = members.join(sizes.select("shingle", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "shingle")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keys = ["shingle", "low", "high"]
    dealt = open_rows.withColumn("block", own).withColumn("other", other).select(
        "shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component", "n", "place", *_PARITY
    )

    def pairs(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        node, component, n, place, *parity = (np.concatenate(c) for c in zip(*held))
        # Unsigned, as bits of negative numbers are counted on their absolute value.
        parity = np.stack(parity, axis=1).view(np.uint64)
        every = np.arange(len(node))
        out, size = [], 0
        for i in range(len(node) - 1):
            j = every[i + 1 :][component[i + 1 :] != component[i]]
            j = j[_may_reach(n, place, np.full(len(j), i), j, least)]
            differing = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype=np.int64)
            j = j[differing * (least.numerator + least.denominator) <= (n[j].astype(np.int64) + n[i]) * (least.denominator - least.numerator)]
            if len(j):
                out.append((np.minimum(node[j], node[i]), np.maximum(node[j], node[i])))
                size += len(j)
            if out and size > 100_000:
                a, b = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                out, size = [], 0
        if out:
            a, b = map(np.concatenate, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            at = np.stack([c.astype(np.int64) for c in columns[:3]], axis=1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
            for low, high in zip(edges, edges[1:]):
                if held and tuple(at[low]) != before:
                    yield from pairs(held)
                    held = []
                before = tuple(at[low])
                held.append([c[low:high] for c in columns[3:]])
        if held:
            yield from pairs(held)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a bigint, b bigint").distinct()


def _contracted(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after more links. The components alone are walked, which shrink from round to round."""
    ends = links.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    merged = connected_components(ends.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("_lower"))
    return cut(parts.join(merged, "component", "left").select("node", F.coalesce("_lower", "component").alias("component")))


def _near_fingerprints(first: DataFrame) -> DataFrame:
    """``a, b``: nodes whose SimHash fingerprints are equal or linked (``simhash.links``), enough of them to connect all such nodes."""
    heads = cut(first.groupBy("fingerprint").agg(F.min("node").alias("head")))
    equal = first.join(heads, "fingerprint").select("node", "head")
    end = lambda side: heads.select(F.col("fingerprint").alias(side), F.col("head").alias(f"_{side}"))
    linked = simhash.links(heads.select("fingerprint")).join(end("a"), "a").join(end("b"), "b").select("_a", "_b")
    return equal.union(linked).toDF("x", "y").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _connected(close: DataFrame, met: DataFrame, signs: DataFrame, whole: Callable[[DataFrame], DataFrame], least: Fraction) -> DataFrame:
    """``node, component`` of all nodes that met others, from all links among them; ``close`` are compared first.

    ``signs`` has the size and the parities of each of these nodes.
    """
    parts = signs.select("node", F.col("node").alias("component"))
    parts = _contracted(parts, _similar(close, signs, whole, least))
    # What SimHash has connected needs no other comparison.
    end = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    pairs = met.filter("b is not null").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b").filter("_a <> _b").select("a", "b")
    parts = _contracted(parts, _similar(pairs, signs, whole, least))
    rest = met.filter("b is null").select("shingle", F.col("a").alias("node"), "n", "place")
    rest = cut(rest.join(signs.select("node", *_PARITY), "node"))
    before, turn = math.inf, 0
    while True:
        members = rest.join(parts, "node")
        by_part = members.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
        sizes = by_part.groupBy("shingle").agg(F.sum("k").alias("count"), F.sum(F.col("k") * F.col("k")).alias("alike")).filter("count * count > alike")
        sizes = cut(sizes)
        left = sizes.agg(F.sum("count").alias("rows"), F.sum((F.col("count") * F.col("count") - F.col("alike")) / 2).alias("pairs")).first()
        if not left["rows"]:
            return parts
        members = members.join(sizes.select("shingle"), "shingle", "left_semi")
        draw = FEW * left["rows"] < left["pairs"] <= WORTH * before
        links = _similar(_drawn_pairs(members, turn, least) if draw else _all_pairs(members, sizes, least), signs, whole, least)
        if not links.isEmpty():
            parts = _contracted(parts, links)
        if not draw:
            return parts
        before, turn = left["pairs"], turn + 1


def deduplicate(df: DataFrame, least: Fraction = Fraction(4, 5), words: int = 5, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of ``df`` of each group of near copies, with all its columns: that of the smallest id.

    A group is what links connect; two texts are linked if the Jaccard similarity of their sets of word shingles is at
    least ``least``. Texts without words, or null, are one group. A null id counts as the largest; of equal ids the
    row with the smaller hash of its text stays; rows that agree in id and text are one. Rows are told apart by 96
    bits of hashes of both, sets by 64 bits, shingles by 64 bits.
    """
    keys = (F.xxhash64(row_id, text).alias("_key"), F.hash(text, row_id).alias("_second_key"))
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), *keys)
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("_key"), F.col("_second_key"))
    # Equal sets have equal sizes and parities.
    first = cut(_marks(rows, words).groupBy("node").agg(F.min(rank).alias("first"), *[F.min(c).alias(c) for c in ("fingerprint", "n", *_PARITY)]))
    rows = rows.drop("id")
    close = cut(_near_fingerprints(first))
    met = cut(_first_pairs(_meetings(rows.select("text"), words, least), least))
    wanted = reduce(DataFrame.union, [pairs.select(F.col(side).alias("node")) for pairs in (met, close) for side in ("a", "b")]).filter("node is not null").distinct()
    signs = cut(first.join(wanted, "node", "left_semi").select("node", "n", *_PARITY))
    parts = _connected(close, met, signs, lambda nodes: _sets(nodes, rows, first, words), least)
    named = first.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    chosen = named.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select("first._key", "first._second_key")
    kept = df.select("*", *keys).join(chosen, _KEYS, "left_semi")
    return kept.dropDuplicates(_KEYS).drop(*_KEYS)
