"""SimHash near duplicates: fingerprints linked through the anchors of a covering code.

The 64 bits are cut into three segments. Two fingerprints that differ in at most ``3 * t + 2`` bits differ in at
most ``t`` bits of some segment. A segment, padded to 23 bits, lies within 3 bits of exactly one word of the
binary Golay code: its home anchor. A fingerprint within ``t`` bits of it in that segment lies within ``3 + t``
of the same anchor. So each fingerprint is sent to every anchor within ``3 + t`` bits, and whoever shares an
anchor is compared over all 64 bits.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaykit.llm.common import cut
from relaykit.llm.components import connected_components

# Length, covering radius and generator polynomial of the binary Golay code.
GOLAY_BITS, GOLAY_RADIUS, GOLAY_POLYNOMIAL = 23, 3, 0b110001110101
# Lowest bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# More members of one anchor than this are compared in blocks.
BLOCK = 60_000


def text_fingerprint(text: str | None, words: int = 5, seed: int = 42) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 16384):
        shingles = [b" ".join(found[i : i + words]) for i in range(at, min(at + 16384, last))]
        hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 5, seed: int = 42) -> Column:
    """64-bit SimHash (signed long) of a text's word shingles.

    A-Z become a-z; words are runs without ASCII white space; shingles of ``words`` words, repeats included, are
    joined by one space; a shorter text is one shingle. A bit is set if it is set in over half of the XXH64 values
    of the shingles. A text without words, or a null, has fingerprint 0.
    """

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([text_fingerprint(t, words, seed) for t in batch.to_pylist()], pa.int64())

    return hashed(text)


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial: the syndrome, 0 for code words."""
    words = words.astype(np.int64)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY_POLYNOMIAL << (bit - 11)), words)
    return words


@functools.lru_cache(maxsize=4)
def anchor_offsets(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each remainder, what leads from a word to every anchor within ``reach`` bits: offsets, padded, and their number."""
    patterns = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in itertools.combinations(range(GOLAY_BITS), n)]
    patterns = np.array(patterns, np.int64)
    remainders = _remainder(patterns)
    counts = np.bincount(remainders, minlength=2048)
    table = np.full((2048, counts.max()), -1, np.int64)
    order = np.argsort(remainders, kind="stable")
    place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[remainders[order], place] = patterns[order]
    return table, counts


def anchors(fingerprints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchor keys (segment and code word) of each fingerprint, for links of at most ``most`` bits."""
    rows, keys = [], []
    table, counts = anchor_offsets(GOLAY_RADIUS + most // len(SEGMENTS))
    values = fingerprints.view(np.uint64)
    for number, (low, width) in enumerate(SEGMENTS):
        words = (values >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        remainders = _remainder(words)
        offsets = table[remainders]
        row, column = np.nonzero(offsets >= 0)
        rows.append(row)
        keys.append((number << GOLAY_BITS) | (words[row] ^ offsets[row, column]))
    return np.concatenate(rows), np.concatenate(keys)


def _forest(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever is connected among ``values`` by at most ``most`` differing bits: one per joined value.

    Grows a part from a seed: everything near a reached value is taken out of the rest, so dense groups shrink fast.
    """
    rest, ends, starts = values, [], []
    while len(rest) > 1:
        queue, rest = [rest[-1]], rest[:-1]
        while queue and len(rest):
            value = queue.pop()
            near = np.bitwise_count(rest ^ value) <= most
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                ends.append(found)
                starts.append(np.full(len(found), value, values.dtype))
    empty = np.array([], values.dtype)
    return (np.concatenate(ends), np.concatenate(starts)) if ends else (empty, empty)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """First column of sorted batches, one array for each run of equal remaining columns."""
    held, before = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values, *keys = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
        keys = np.stack([k.astype(np.int64) for k in keys], axis=1)
        starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if before is not None and (keys[0] != before).any():
            yield np.concatenate(held)
            held = []
        before = keys[-1]
        *whole, rest = np.split(values, starts)
        if whole:
            yield np.concatenate([*held, whole[0]])
            yield from whole[1:]
            held = []
        held.append(rest)
    if held:
        yield np.concatenate(held)


def links(fingerprints: DataFrame, most: int = 4) -> DataFrame:
    """``a, b``: enough pairs of distinct fingerprints (column ``fingerprint``) within ``most`` bits to connect all that are linked.

    The input must hold each value once. An anchor with more than ``BLOCK`` members is cut by hash into blocks,
    and every pair of its blocks is compared in a task of its own, so that no link is lost.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4_000):
                part = values[at : at + 4_000]
                row, key = anchors(part, most)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key)], ["fingerprint", "anchor"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _whole_groups(batches):
            # Unsigned: numpy counts the bits of a signed number's absolute value.
            a, b = _forest(members.view(np.uint64), most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    sent = fingerprints.select("fingerprint").mapInArrow(spread, "fingerprint bigint, anchor bigint")
    heavy = sent.groupBy("anchor").count().filter(F.col("count") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("count") * 2 / BLOCK), F.lit(1)).cast("int")
    placed = sent.join(heavy, "anchor", "left").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    )
    # A member of block i goes to the pairs {i, j} for every j.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).select(
        "fingerprint", "anchor", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    keys = ["anchor", "low", "high"]
    dealt = paired.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(solve, "a bigint, b bigint")


def _classified(marked: DataFrame, most: int) -> DataFrame:
    """``marked`` (one row per document with ``id`` and ``fingerprint``) with ``component``, a name of the linked group."""
    groups = cut(marked.select("fingerprint").distinct())
    parts = connected_components(links(groups, most)).withColumnRenamed("node", "fingerprint")
    return marked.join(parts, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def near_duplicates(
    df: DataFrame, most: int = 4, words: int = 5, text: str = "text", row_id: str = "doc_id"
) -> DataFrame:
    """``row_id, fingerprint, component_id``, one row for each row of ``df``.

    ``component_id`` is the smallest id reachable over links of at most ``most`` differing bits; a null id is not
    smaller than any other, and a part that has only null ids keeps null. Rows with one fingerprint, such as exact
    copies or texts without words, are always together. Repeated rows give repeated results; an empty table gives
    an empty one. Other columns of ``df`` are not read.
    """
    marked = cut(df.select(F.col(row_id).alias("id"), fingerprint(F.col(text), words).alias("fingerprint")))
    named = _classified(marked.groupBy("fingerprint").agg(F.min("id").alias("first_id")), most)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    whole = named.join(smallest, "component").select("fingerprint", "component_id")
    return marked.join(whole, "fingerprint").select(F.col("id").alias(row_id), "fingerprint", "component_id")


def deduplicate(df: DataFrame, most: int = 4, words: int = 5, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of ``df`` of each group of near duplicates, with all its columns: that of the smallest id.

    Groups as in ``near_duplicates``. A null id counts as the largest; of equal ids the row with the smaller hash of
    its text stays; rows that agree in id and text are one. Rows are told apart by 96 bits of hashes of both.
    """
    keys = (F.xxhash64(row_id, text).alias("_key"), F.hash(text, row_id).alias("_second_key"))
    marked = cut(df.select(F.col(row_id).alias("id"), fingerprint(F.col(text), words).alias("fingerprint"), *keys))
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("_key"), F.col("_second_key"))
    first = marked.groupBy("fingerprint").agg(F.min(rank).alias("first"))
    chosen = _classified(first, most).groupBy("component").agg(F.min("first").alias("first"))
    chosen = chosen.select("first._key", "first._second_key")
    kept = df.select("*", *keys).join(chosen, ["_key", "_second_key"], "left_semi")
    return kept.dropDuplicates(["_key", "_second_key"]).drop("_key", "_second_key")
