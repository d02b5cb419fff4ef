"""Substring dedup: word windows that occur more than once, found with suffix automata of reference shards.

A broadcast of all automata would grow with the corpus, and so would the time to stream every document through
each. So the shards are cut by content, and a document meets only the shards it can match in:

1. Each window belongs to one anchor: the smallest hash of its ``gram`` consecutive words (winnowing). Equal windows
   have the same anchor at the same place. The windows of one anchor occurrence form a run, its context.
2. Anchors that occur once cannot repeat. Where all contexts of an anchor are one text, all its windows repeat.
3. The other contexts are the reference: by anchor they form shards. Each task builds the suffix automaton of its
   shard and streams the shard's contexts through it for matching statistics: the longest match of at least two
   occurrences that ends at each word. Where it reaches the window, the window repeats.
4. Anchors with very many contexts would make a shard of any size. Their windows are counted one by one instead.

Context runs cut every document's windows into disjoint sets, so an automaton counts no window twice.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from relaykit.llm.common import cut, slices

# Words of an anchor; a window of W words holds W - GRAM + 1 of them.
GRAM = 12
# Where an anchor has more contexts than this, windows are counted by a 128-bit hash instead.
HEAVY = 1_000
KEY = "_text_key"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Rolling:
    """Hashes of runs of a sequence, by prefix sums; arithmetic is modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        self.back = _powers(pow(base, -1, 1 << 64), len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values)), out=sums[1:])
        self.sums = sums

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in UTF-8 bytes."""
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(letter.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _contexts(texts: list[bytes], window: int, gram: int) -> dict[str, np.ndarray]:
    """The anchor occurrences of some texts: text number, first window, number of windows, anchor and context hash."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    start, end = _words(data)
    sizes = np.array([len(t) + 1 for t in texts])
    first_byte = np.cumsum(sizes) - sizes
    first_word = np.searchsorted(start, first_byte)
    last_word = np.append(first_word[1:], len(start))
    text_of = np.repeat(np.arange(len(texts)), last_word - first_word)
    empty = np.array([], np.int64)
    if len(start) < window:
        return {"text": empty, "first": empty, "n": empty, "anchor": empty, "context": empty}
    words = _Rolling(data.astype(np.uint64) + np.uint64(1), _BASES[1]).runs(start, end)
    rolling = _Rolling(words, _BASES[0])
    at = np.arange(len(words) - gram + 1)
    grams = rolling.runs(at, at + gram)
    # Hash above, place below: of equal hashes the first wins, in every copy of the window alike.
    order = (grams & np.uint64(_MASK ^ 0xFFFFFFFF)) | at.astype(np.uint64)
    span = window - gram + 1
    least, width = order, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    window_at = np.arange(len(words) - window + 1)
    inside = last_word[text_of[window_at]] >= window_at + window
    owner = np.where(inside, (least & np.uint64(0xFFFFFFFF)).astype(np.int64), -1 - window_at)
    heads = np.flatnonzero(np.diff(owner, prepend=-(1 << 60)) != 0)
    counts = np.diff(np.append(heads, len(owner)))
    real = owner[heads] >= 0
    heads, counts = heads[real], counts[real]
    return {
        "text": text_of[heads],
        "first": heads - first_word[text_of[heads]],
        "n": counts,
        "anchor": grams[owner[heads]].view(np.int64),
        "context": rolling.runs(heads, heads + counts + window - 1).view(np.int64),
    }


class SuffixAutomaton:
    """Suffix automaton of several token strings, with the number of occurrences of each state, two at most."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, tokens: list, times: int = 1) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)
            self.count[last] += times

    def _extend(self, last: int, token) -> int:
        follow, link, length = self.next, self.link, self.length
        if token in follow[last]:
            found = follow[last][token]
            return found if length[found] == length[last] + 1 else self._split(last, token, found)
        new = len(length)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.count.append(0)
        state = last
        while state >= 0 and token not in follow[state]:
            follow[state][token] = new
            state = link[state]
        if state >= 0:
            found = follow[state][token]
            link[new] = found if length[found] == length[state] + 1 else self._split(state, token, found)
        return new

    def _split(self, state: int, token, found: int) -> int:
        twin = len(self.length)
        self.next.append(dict(self.next[found]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[found])
        self.count.append(0)
        self.link[found] = twin
        while state >= 0 and self.next[state].get(token) == found:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def finish(self) -> None:
        """Carries the occurrences to the shorter suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def statistics(self, tokens: list) -> Iterator[int]:
        """For each token, the length of the longest match with at least two occurrences that ends there."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            while state and self.count[state] < 2:
                state = self.link[state]
                size = self.length[state]
            yield size


def _repeats(contexts: list[tuple[list, int]], window: int) -> list[list[int]]:
    """For each context (words, occurrences), the windows that occur at least twice in all of them, by place."""
    automaton = SuffixAutomaton()
    for words, times in contexts:
        automaton.add(words, times)
    automaton.finish()
    return [
        [end - window + 1 for end, size in enumerate(automaton.statistics(words)) if size >= window] for words, _ in contexts
    ]


def _text_key(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def with_text_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a 128-bit hash of the text; a null text counts as empty."""

    keyed = docs.withColumn(KEY, F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    # Never null; said here so that every join on the key starts from the same rows and can share their shuffle.
    return keyed.filter(F.col(KEY).isNotNull())


def repeated_windows(keyed: DataFrame, window: int = 50, gram: int = GRAM, text: str = "text") -> DataFrame:
    """``text_key, marks`` of rows with their text key (``with_text_key``): for each distinct text with a repeated window, where such windows start.

    ``text_key`` is a 128-bit hash of the text; ``marks`` are pairs of first window and number of windows. A window
    that occurs twice in one text, or once in each of two rows with the same text, is repeated. Texts shorter than a
    window, empty ones and nulls have none.
    """
    if not 1 <= gram <= window:
        raise ValueError("an anchor has at least one word and fits into the window")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1_000_000):
                texts = [(t or "").encode() for t in part.column(0).to_pylist()]
                found = _contexts(texts, window, gram)
                keys = np.array([_text_key(t) for t in texts], dtype=object)
                columns = [pa.array(found["anchor"]), pa.array(found["context"]), pa.array(keys[found["text"]], pa.binary())]
                columns += [pa.array(found["first"].astype(np.int32)), pa.array(found["n"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "context", "text_key", "first", "n"])

    rows = keyed.select(F.col(text).alias("text")).mapInArrow(
        cut_up, "anchor bigint, context bigint, text_key binary, first int, n int"
    )
    # An anchor that occurs once is dropped before anything wider than its hash and a count is shuffled.
    repeated = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).filter("total > 1").select("anchor")
    # Copies of a text fall together here, before anything is gathered by anchor.
    places = cut(
        rows.join(repeated, "anchor", "left_semi")
        .groupBy("anchor", "context", "text_key", "first", "n").agg(F.count(F.lit(1)).alias("times"))
    )
    contexts = places.groupBy("anchor", "context").agg(
        F.sum("times").alias("times"), F.min(F.struct("text_key", "first", "n")).alias("sample")
    )
    variants = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"))
    known = cut(contexts.join(variants, "anchor").select("anchor", "context", "times", "variants", "sample.*"))
    whole = known.filter("variants = 1").select("anchor", "context", F.lit(0).alias("at"), F.col("n").alias("many"))
    unsure = known.filter("variants > 1")

    # The words of one sample of each context in question. All columns of the keyed rows are kept up to here, so that
    # this join and the one in remove_repeats share one shuffle of the texts.
    wanted = unsure.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "context", "times", "variants", "first", "n")).alias("parts"))
    one = keyed.join(wanted.withColumnRenamed("text_key", KEY), KEY).dropDuplicates([KEY])
    text_at, parts_at = one.columns.index(text), one.columns.index("parts")

    def parts_of(batches: Iterator[pa.RecordBatch], heavy: bool) -> Iterator[tuple]:
        for batch in batches:
            for body, parts in zip(batch.column(text_at).to_pylist(), batch.column(parts_at).to_pylist()):
                words = (body or "").encode().split()
                for p in parts:
                    if (p["variants"] > HEAVY) == heavy:
                        yield p, words[p["first"] : p["first"] + p["n"] + window - 1]

    def packed(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        while out := list(itertools.islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p["anchor"], p["context"], p["times"], b" ".join(piece)) for p, piece in parts_of(batches, False))
        yield from packed(rows, ["anchor", "context", "times", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (p["anchor"], p["context"], p["times"], at, xxhash.xxh3_128_digest(b" ".join(piece[at : at + window])))
            for p, piece in parts_of(batches, True) for at in range(p["n"])
        )
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield from packed(rows, ["anchor", "context", "times", "at", "window_key"], kinds)

    quoted = one.mapInArrow(quote, "anchor bigint, context bigint, times bigint, words binary")

    # Very common anchors: whole windows are counted, by partial sums before the shuffle, and the repeated ones are
    # joined back. No task gathers the copies of a window.
    named = one.filter(F.exists("parts", lambda p: p["variants"] > HEAVY)).mapInArrow(
        name_windows, "anchor bigint, context bigint, times bigint, at int, window_key binary"
    )
    often = named.groupBy("anchor", "window_key").agg(F.sum("times").alias("total")).filter("total > 1").select("anchor", "window_key")
    common = named.join(often, ["anchor", "window_key"]).select("anchor", "context", "at", F.lit(1).alias("many"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def shard() -> Iterator[pa.RecordBatch]:
            found = _repeats([(r["words"].split(b" "), min(r["times"], 2)) for r in held], window)
            out = [(r["anchor"], r["context"], at, 1) for r, starts in zip(held, found) for at in starts]
            if out:
                a, c, at, many = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c), pa.array(at, pa.int32()), pa.array(many, pa.int32())], ["anchor", "context", "at", "many"]
                )

        # A shard ends between two anchors; none has more than ``HEAVY`` contexts.
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= 200 and row["anchor"] != held[-1]["anchor"]:
                    yield from shard()
                    held = []
                held.append(row)
        if held:
            yield from shard()

    matched = quoted.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        match, "anchor bigint, context bigint, at int, many int"
    )
    marks = whole.union(matched).union(common).groupBy("anchor", "context").agg(F.collect_list(F.struct("at", "many")).alias("found"))
    placed = places.join(marks, ["anchor", "context"]).select("text_key", "first", F.explode("found").alias("f"))
    return placed.groupBy("text_key").agg(
        F.collect_list(F.struct((F.col("first") + F.col("f.at")).alias("first"), F.col("f.many").alias("n"))).alias("marks")
    )


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = GRAM, text: str = "text") -> DataFrame:
    """Adds ``kept`` (the words left, joined by one space), ``n_words`` and ``n_removed`` to every row.

    A word goes if any window of ``window`` words over it also starts anywhere else, in the same text or another
    row; all copies lose it. Words are runs without ASCII white space. A null text counts as empty. Columns that
    already have one of the new names are replaced. An empty table stays empty.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    columns = docs.columns
    keyed = with_text_key(docs, text)
    marks = repeated_windows(keyed, window, gram, text)
    marks = marks.withColumnRenamed("text_key", KEY).withColumnRenamed("marks", "_marks")
    joined = keyed.join(marks, KEY, "left").select(*columns, "_marks")
    place = columns.index(text)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                kept, counts, gone = [], [], []
                for body, found in zip(part.column(place).to_pylist(), part.column(len(columns)).to_pylist()):
                    words = (body or "").encode().split()
                    counts.append(len(words))
                    if found:
                        edges = np.zeros(len(words) + 1, np.int64)
                        starts = np.array([m["first"] for m in found])
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + np.array([m["n"] for m in found]) + window - 1, -1)
                        keep = np.cumsum(edges[:-1]) == 0
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    gone.append(counts[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                new = [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(columns)], *new], [*part.schema.names[: len(columns)], "kept", "n_words", "n_removed"]
                )

    schema = StructType([*docs.schema.fields]).add("kept", StringType()).add("n_words", LongType()).add("n_removed", LongType())
    return joined.mapInArrow(trim, schema)
