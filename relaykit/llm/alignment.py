"""Alignment of two tokenizations of the same text.

Both are lists of rising byte offsets at which tokens end, the last of them equal. The shorter list of a document is
looked up in the longer one by galloping: from a known place the steps double until they pass the offset, then a binary
search settles it. Every 16th offset gallops from the document's beginning, the others from the 16th before them. The
offsets that both lists hold cut the tokens into groups; the differences of their ranks are the groups' sizes, and so
the ranges of tokens that overlap. Two tokens are linked where their bytes end together.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaykit.llm.common import shared_folder, slices

STRIDE = 16
# A pair with more than this share of all links is broadcast with its count; there are fewer than HEAD of them.
HEAD = 1 << 16
_SLICE_BYTES = 1_000_000
# Chunks that a worker remembers; longer ones than _LONG characters are not kept.
_KNOWN = 400_000
_LONG = 100
# Before a space that follows something else than white space, unless it is the last character.
_CUT = re.compile(r"(?<=[^\s\u180e\u2581])(?= .)", re.S)
OUTPUTS = ("tokens", "groups", "links")


@dataclass(frozen=True)
class Side:
    """A tokenizer file: ``byte_level`` (JSON, byte-level BPE) or ``pieces`` (SentencePiece).

    ``before`` is what it must find before a text so that the bytes of the tokens are a space and the text.
    """

    kind: str
    path: str
    before: str = ""


class _ByteLevel:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # Their strings in a text are ordinary text.
        self.model.encode_special_tokens = True
        # The printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        names = self.model.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        config = json.loads(self.model.to_str())
        pieces = config["pre_tokenizer"] or {}
        # No match of its expression goes on behind a space that follows something else.
        self.cuts = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space") and not config["normalizer"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class _Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(i) for i in range(self.model.get_piece_size())]
        # No piece goes on behind a space that follows something else, and white space stays as it is.
        self.cuts = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_of))) and self.model.decode(self.model.encode("a  b ")) == "a  b "

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Both:
    """Two tokenizers with the ids (packed 32-bit integers) of the chunks met; None where bytes are not those of the chunk.

    A chunk is a space and what follows it. Encoded one by one, chunks give the ids of the whole, as tokens end there.
    """

    def __init__(self, a: Side, b: Side):
        kinds = {"byte_level": _ByteLevel, "pieces": _Pieces}
        self.sides = (a, b)
        self.models = tuple(kinds[s.kind](s.path) for s in self.sides)
        self.bytes_of = tuple(m.bytes_of for m in self.models)
        self.lengths = tuple(np.array([len(t) for t in table], np.int64) for table in self.bytes_of)
        self.cuts = all(m.cuts for m in self.models)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def encode(self, side: int, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with a space."""
        return [np.array(ids, np.int32) for ids in self.models[side].encode([self.sides[side].before + t[1:] for t in texts])]

    def keeps(self, side: int, ids: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.bytes_of[side].__getitem__, ids.tolist())) == data

    def _in_one_row(self, side: int, row: list[str], data: list[bytes]) -> list[bytes] | None:
        """Ids of chunks that end without white space, encoded as one text, which is faster."""
        whole = b"".join(data)
        ids = self.encode(side, [whole.decode()])[0]
        if not self.keeps(side, ids, whole):
            return None
        cuts = (4 * np.searchsorted(np.cumsum(self.lengths[side][ids]), np.cumsum(list(map(len, data))), side="right")).tolist()
        packed = ids.tobytes()
        return [packed[i:j] for i, j in zip([0, *cuts], cuts)]

    def _one_by_one(self, side: int, chunks: list[str]) -> list[bytes | None]:
        return [ids.tobytes() if self.keeps(side, ids, c.encode()) else None for c, ids in zip(chunks, self.encode(side, chunks))]

    def learn(self, chunks: list[list[str]]) -> list[str]:
        """Encodes what is not known; returns the long chunks, which rarely come again."""
        if len(self.known) > _KNOWN:
            self.known.clear()
        # Only the last chunk of a text may end in white space.
        row = set().union(*[c[:-1] for c in chunks]).difference(self.known) if self.cuts else set()
        rest = {c[-1] for c in chunks if c}.difference(self.known, row)
        row, rest = list(row), list(rest)
        data = [c.encode() for c in row]
        for some, found in ((row, [self._in_one_row(k, row, data) if row else [] for k in (0, 1)]), (rest, [self._one_by_one(k, rest) for k in (0, 1)])):
            both = [self._one_by_one(k, some) if f is None else f for k, f in enumerate(found)]
            self.known.update((c, None if x is None or y is None else (x, y)) for c, x, y in zip(some, *both))
        return [c for some in (row, rest) for c in some if len(c) > _LONG]


@functools.cache
def _load(a: Side, b: Side) -> _Both:
    """One of each tokenizer a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Both(a, b)


@functools.cache
def _parts(size_a: int, size_b: int) -> list[str]:
    """Ids as they stand in a text of groups: of A as the first of all, first of a group, later; of B first of a group, later."""
    return [m + str(i) for mark, size in (("", size_a), (";", size_a), (",", size_a), ("|", size_b), (",", size_b)) for m in [mark] for i in range(size)]


def gallop(longer: np.ndarray, targets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each target the first place from ``start`` on at which ``longer`` (rising) is no smaller. There must be one."""
    low, high = start.copy(), start.copy()
    last, step = len(longer) - 1, 1
    short = np.flatnonzero(longer[high] < targets)
    while len(short):
        low[short] = high[short] + 1
        high[short] = np.minimum(high[short] + step, last)
        short = short[longer[high[short]] < targets[short]]
        step *= 2
    wide = np.flatnonzero(low < high)
    while len(wide):
        middle = (low[wide] + high[wide]) >> 1
        less = longer[middle] < targets[wide]
        low[wide[less]] = middle[less] + 1
        high[wide[~less]] = middle[~less]
        wide = wide[low[wide] < high[wide]]
    return low


def _look_up(ends: np.ndarray, sizes: np.ndarray, drives: np.ndarray, longer: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common ends in ``ends`` and ``longer``, of the documents that drive; ``first`` is where each begins in ``longer``."""
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(ends)) - begin[doc]
    mine = np.flatnonzero(drives[doc])
    targets, rank, doc = ends[mine], rank[mine], doc[mine]
    place = np.empty(len(mine), np.int64)
    anchors = rank % STRIDE == 0
    place[anchors] = gallop(longer, targets[anchors], first[doc[anchors]])
    known = np.flatnonzero(anchors)[np.cumsum(anchors) - 1] if len(mine) else place
    place[~anchors] = gallop(longer, targets[~anchors], place[known[~anchors]])
    hit = longer[place] == targets
    return mine[hit], place[hit]


def common_ends(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both hold.

    Many documents in a row, with offsets that go on rising from one to the next; ``sizes_*`` are their numbers of tokens.
    """
    short = sizes_a <= sizes_b
    a1, b1 = _look_up(a, sizes_a, short, b, np.cumsum(sizes_b) - sizes_b)
    b2, a2 = _look_up(b, sizes_b, ~short, a, np.cumsum(sizes_a) - sizes_a)
    return np.sort(np.concatenate([a1, a2])), np.sort(np.concatenate([b1, b2]))


def _encoded(texts: list[str | None], both: _Both) -> tuple[list[bytes], list[bytes]]:
    """Packed ids of both sides; none on either where the text is null or empty, or the bytes of a side are not a space and the text."""
    cut = _CUT.split if both.cuts else lambda text: [text]
    chunks = [cut(" " + t) if t else [] for t in texts]
    long = both.learn(chunks)
    out: tuple[list[bytes], list[bytes]] = ([], [])
    for text, found in zip(texts, chunks):
        ids = list(map(both.known.__getitem__, found))
        if None in ids:
            # Bytes lost in one chunk could only come back in the next one: the text itself tells.
            whole = [both.encode(k, [" " + text])[0] for k in (0, 1)]
            good = all(both.keeps(k, w, (" " + text).encode()) for k, w in enumerate(whole))
            ids = [tuple(w.tobytes() for w in whole)] if good else []
        out[0].append(b"".join([x for x, _ in ids]))
        out[1].append(b"".join([y for _, y in ids]))
    for chunk in long:
        both.known.pop(chunk, None)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values).cast(kind))


def _aligned(texts: list[str | None], side_a: Side, side_b: Side, outputs: Sequence[str]) -> dict[str, pa.Array]:
    both = _load(side_a, side_b)
    packed = _encoded(texts, both)
    sizes_a, sizes_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in packed)
    ids_a, ids_b = (np.frombuffer(b"".join(ids), np.int32).astype(np.int64) for ids in packed)
    ia, ib = common_ends(np.cumsum(both.lengths[0][ids_a]), np.cumsum(both.lengths[1][ids_b]), sizes_a, sizes_b)
    doc_a = np.repeat(np.arange(len(texts)), sizes_a)
    groups = np.bincount(doc_a[ia], minlength=len(texts))
    out = {"n_a": pa.array(sizes_a), "n_b": pa.array(sizes_b), "n_groups": pa.array(groups)}
    begin_a, begin_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    if "tokens" in outputs:
        doc_g = doc_a[ia]
        out |= {"a_ids": _lists(ids_a, sizes_a, pa.int32()), "b_ids": _lists(ids_b, sizes_b, pa.int32())}
        out |= {"a_last": _lists(ia - begin_a[doc_g], groups, pa.int32()), "b_last": _lists(ib - begin_b[doc_g], groups, pa.int32())}
    if "groups" in outputs:
        size_a, size_b = map(len, both.bytes_of)
        parts = _parts(size_a, size_b)
        # Ranks of the common ends differ by the sizes of the groups.
        group_a, group_b = (np.repeat(np.arange(len(ia)), np.diff(i, prepend=-1)) for i in (ia, ib))
        code_a, code_b = ids_a + 2 * size_a, ids_b + 3 * size_a + size_b
        heads_a, heads_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        code_a[heads_a] -= size_a
        code_a[begin_a[sizes_a > 0]] = ids_a[begin_a[sizes_a > 0]]
        code_b[heads_b] -= size_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate([[0], ib[:-1] + 1])[group_a] if len(ia) else []] = code_a
        order[np.arange(len(ids_b)) + (ia + 1)[group_b]] = code_b
        words, ends = list(map(parts.__getitem__, order.tolist())), np.cumsum(sizes_a + sizes_b).tolist()
        out["groups"] = pa.array(["".join(words[s:e]) for s, e in zip([0, *ends], ends)], pa.string())
    if "links" in outputs:
        doc, pair = doc_a[ia], ids_a[ia] << 32 | ids_b[ib]
        sort = np.lexsort((pair, doc))
        doc, pair = doc[sort], pair[sort]
        heads = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        times = np.diff(np.append(heads, len(pair)))
        distinct = np.bincount(doc[heads], minlength=len(texts))
        out |= {"pairs": _lists(pair[heads], distinct, pa.int64()), "times": _lists(times, distinct, pa.int32())}
    return out


_KINDS = {
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "a_ids": "array<int>", "b_ids": "array<int>", "a_last": "array<int>", "b_last": "array<int>",
    "groups": "string", "pairs": "array<bigint>", "times": "array<int>",
}
_OF = {"tokens": ["a_ids", "b_ids", "a_last", "b_last"], "groups": ["groups"], "links": ["pairs", "times"]}


def align(df: DataFrame, a: Side, b: Side, text: str = "text", keep: Sequence[str] | None = None, outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """The columns ``keep`` (all, if None) of ``df`` with the alignment of each text; columns of the added names are replaced.

    ``n_a, n_b, n_groups`` always. ``tokens``: ``a_ids, b_ids`` and the place of each group's last token on both sides,
    ``a_last, b_last``. ``groups``: ids as ``a1,a2|b1;a3|b2,b3``. ``links``: the distinct linked pairs of the text,
    ``pairs`` (id of A times 2^32, plus id of B) and ``times``. A group of p and q tokens has p + q - 1 overlapping pairs.

    A text that is null or empty, or whose bytes a tokenizer does not keep, has no tokens: zeros, an empty text, empty
    arrays. Repeated rows are aligned each. An empty table gives an empty result. One pass without a shuffle; texts are
    taken whole.
    """
    added = ["n_a", "n_b", "n_groups", *[c for o in outputs for c in _OF[o]]]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(1).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _SLICE_BYTES):
                found = _aligned(part.column(1).to_pylist(), a, b, outputs)
                yield pa.RecordBatch.from_arrays([part.column(0), *[found[c] for c in added]], ["row", *added])

    schema = df.sparkSession.createDataFrame([], ", ".join(f"{c} {_KINDS[c]}" for c in added)).schema
    done = rows.mapInArrow(run, StructType([rows.schema["row"], *schema.fields]))
    return done.select(*(["row.*"] if kept else []), *added)


def score_links(aligned: DataFrame, key: str) -> DataFrame:
    """``key, n_best, count_sum`` of each row of ``aligned`` with links: how many of them are their B id's most frequent pair
    (ties included), and the sum of their pairs' counts. A pair's count is how often it is linked in all rows.

    ``key`` names the rows and must not be null. Frequent pairs meet their counts by a broadcast of fewer than ``HEAD``
    rows, the others by a shuffle in which no pair has a large share.
    """
    spark = aligned.sparkSession
    each = aligned.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(key, "link.pairs", "link.times")
    folder = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    each.groupBy("pairs").agg(F.sum("times").alias("count")).write.parquet(folder)
    counts = spark.read.parquet(folder)
    # One row an id of B: bounded by its vocabulary.
    best = counts.groupBy((F.col("pairs").bitwiseAND(0xFFFFFFFF)).alias("b")).agg(F.max("count").alias("most"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    head = counts["count"] > total // HEAD + 1
    ranked = counts.join(F.broadcast(best), counts["pairs"].bitwiseAND(0xFFFFFFFF) == best["b"]).select("pairs", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))
    often, seldom = ranked.filter(head), ranked.filter(~head)
    met = each.join(F.broadcast(often), "pairs", "left")
    rest = met.filter("count is null").select("pairs", key, "times").join(seldom, "pairs")
    both = met.filter("count is not null").select(key, "times", "count", "is_best").union(rest.select(key, "times", "count", "is_best"))
    return both.groupBy(key).agg(F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def align_and_score(df: DataFrame, a: Side, b: Side, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` with ``n_a, n_b, n_groups, groups_sha256, n_links, n_overlaps, n_best, count_sum``.

    ``groups_sha256`` is the hex digest of ``groups``, empty without tokens. The alignment is computed once and written
    to the shared folder; its rows get numbers there, so repeated or null ids are no matter.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = align(df, a, b, text, keep, ("groups", "links")).withColumn("groups_sha256", digest).drop("groups")
    own = [c for c in aligned.columns if c not in ("pairs", "times")]
    packed = aligned.select(F.struct(*own).alias("row"), "pairs", "times", F.monotonically_increasing_id().alias("key"))
    packed.write.parquet(folder)
    packed = spark.read.parquet(folder)
    scores = score_links(packed, "key")
    # Ends meet once on each side, so a group has one link.
    return packed.select("row", "key").join(scores, "key", "left").select(
        "row.*", F.col("row.n_groups").alias("n_links"), F.greatest(F.lit(0).cast("long"), F.expr("row.n_a + row.n_b - row.n_groups")).alias("n_overlaps"),
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
    )
