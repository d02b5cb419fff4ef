"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding: the token ``t`` with
``prefix = shorter + t`` for which ``t`` may follow the last token of ``shorter``. Two tokens may follow each
other when no merge crosses the border between them. The table of these last tokens is the whole state, so
bytes can be appended exactly, and after an edit only the entries near it are computed again.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from relaykit.llm.common import slices

# White space as Unicode's property has it; Python's own \s also takes U+001C to U+001F.
_SPACE = "\t-\r \x85\xa0  -     　"
# Where this occurs, the white space of two neighbouring space-separated chunks belongs to one match.
_JOINED_SPACE = re.compile(f"[{_SPACE}] (?:[{_SPACE}]|\\Z)")
# All other spaces.
_CUT = re.compile(f"(?<![{_SPACE}]) | (?![{_SPACE}]|\\Z)")
_BORN_WITH_TEXT = -1
# Bounds of a worker's memory, not of the work: what was forgotten is computed again.
_KNOWN_BYTES = 24_000_000
_KNOWN_PAIRS = 200_000
_SLICE_CHARS = 2_000_000
_ADDED = StructType().add("ids", BinaryType()).add("n_tokens", LongType()).add("decoded", BinaryType())


def _rust_spaces(pattern: str) -> str:
    """The pattern with \\s spelt out, inside and outside of character sets."""
    return re.sub(r"(\[\^?)\\s", lambda m: m[1] + _SPACE, pattern).replace(r"\s", f"[{_SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tokenizer file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def chunks(text: str) -> list:
    """``text`` cut where no match of ``public_tokenizers.PATTERN`` can span: before a space, unless white space is on both
    sides of it or it ends the text. A plain chunk stands for itself with the space before it, a tuple holds text without one.
    """
    found = _CUT.split(text) if _JOINED_SPACE.search(text) else text.split(" ")
    found[0] = (found[0],)
    return found


class Vocabulary:
    """Ranks with what the prefix tables need: how a token splits, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pattern = regex.compile(_rust_spaces(pattern)) if pattern else None
        self._neighbours: dict[tuple[int, int], bool] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._known_bytes = 0

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; None for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            merges = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((m for m in merges if m[0] is not None), default=None)
            if best is None:
                raise ValueError(f"the vocabulary cannot build its token {token!r} by merges")
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _border(self, rank: int, side: int) -> list[tuple[bytes, float, float]]:
        """Pieces that touch one border of a token while it is built: bytes, merge that makes, merge that absorbs it."""
        known = self._right if side else self._left
        if rank not in known:
            pieces, token, absorbed = [], self.bytes_of[rank], float("inf")
            while True:
                halves = self._halves(token)
                born = self.ranks[token] if halves else _BORN_WITH_TEXT
                pieces.append((token, born, absorbed))
                if not halves:
                    break
                token, absorbed = halves[side], born
            known[rank] = pieces
        return known[rank]

    def may_follow(self, left: int, right: int) -> bool:
        """True if the bytes of both tokens together encode to exactly these two tokens."""
        key = (left, right)
        known = self._neighbours.get(key)
        if known is None:
            known = True
            for a, a_born, a_gone in self._border(left, 1):
                for b, b_born, b_gone in self._border(right, 0):
                    # Of two merges of equal rank the left one goes first.
                    if b_born < a_gone and a_born <= b_gone:
                        merge = self.ranks.get(a + b)
                        if merge is not None and merge < a_gone and merge <= b_gone:
                            known = False
                            break
                if not known:
                    break
            if len(self._neighbours) >= _KNOWN_PAIRS:
                self._neighbours.clear()
            self._neighbours[key] = known
        return known

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Appends to the prefix table ``last`` (entry 0 unused) until it covers ``data[:stop]``."""
        get, neighbours, longest = self.ranks.get, self._neighbours, self.longest
        for end in range(len(last), (len(data) if stop is None else stop) + 1):
            # Just one token is valid here. Short ones are the likelier.
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    key = (last[start], token)
                    ok = neighbours[key] if key in neighbours else self.may_follow(*key)
                    if ok:
                        break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")
            last.append(token)

    def walk_back(self, last: list[int]) -> list[int]:
        tokens, end = [], len(last) - 1
        while end:
            tokens.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tokens[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        last = [-1]
        self.extend(piece, last)
        return self.walk_back(last)

    def _encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece. In byte order, neighbours share the table entries of their common prefix."""
        out, last, before = {}, [-1], b""
        for piece, text in sorted((piece.encode(), piece) for piece in pieces):
            if piece in self.ranks:
                out[text] = self.ranks[piece].to_bytes(4, "little")
                continue
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            self.extend(piece, last)
            before = piece
            out[text] = array("I", self.walk_back(last)).tobytes()
        return out

    def _learn(self, chunks: set) -> None:
        """Makes the ids of all ``chunks`` known. What was not met since the last change of generation is forgotten."""
        if self._known_bytes > _KNOWN_BYTES:
            self._older, self._known, self._known_bytes = self._known, {}, 0
        chunks -= self._known.keys()
        met = chunks & self._older.keys()
        find = self.pattern.findall
        fresh = {chunk: find(" " + chunk if type(chunk) is str else chunk[0]) for chunk in chunks - met}
        pieces = self._encode_pieces({piece for found in fresh.values() for piece in found})
        for chunk in met:
            self._known[chunk] = self._older[chunk]
        for chunk, found in fresh.items():
            self._known[chunk] = pieces[found[0]] if len(found) == 1 else b"".join(map(pieces.__getitem__, found))
        self._known_bytes += sum(150 + (len(chunk) if type(chunk) is str else len(chunk[0])) for chunk in chunks)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts as little-endian unsigned 32-bit integers.

        Each match of the pattern is encoded by itself. Texts are cut by ``chunks``, and each distinct chunk is matched
        and encoded once.
        """
        out, at = [], 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size + len(texts[at]) <= _SLICE_CHARS):
                cut.append(chunks(texts[at]))
                size += len(texts[at])
                at += 1
            self._learn(set().union(*cut))
            out += [b"".join(map(self._known.__getitem__, found)) for found in cut]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class PrefixEncoding:
    """A byte string with its table of last tokens, open to exact appends and edits (no pattern is applied)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        vocabulary.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of ``data[start:end]``; returns how many entries were computed.

        An entry depends on the ``longest`` entries and bytes before it. Once that many entries after the edit
        came out as they were, all later ones stay as they were.
        """
        old_last, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[: start + 1]
        settled = start + len(new)
        self.vocabulary.extend(self.data, self.last, settled)
        same, at = 0, settled
        while at < len(self.data) and same < self.vocabulary.longest:
            at += 1
            self.vocabulary.extend(self.data, self.last, at)
            same = same + 1 if self.last[at] == old_last[at - shift] and at - settled > 0 else 0
        self.last += old_last[at - shift + 1 :]
        return at - start

    def tokens(self) -> list[int]:
        return self.vocabulary.walk_back(self.last)


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (the bytes of the ids) to every row.

    One pass without a shuffle; the ranks (a file of some 50,000 tokens, whatever the data) are broadcast. Null
    texts count as empty: no ids, 0 tokens. Repeated rows are encoded each; an empty table stays empty. A column
    that already has one of the new names is replaced. What a task learns goes with it: Spark keeps more idle workers
    than cores, and each would hold its own.
    """
    df = df.drop("ids", "n_tokens", "decoded")
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    place = df.columns.index(text)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, place):
                ids = vocabulary.encode_all([t or "" for t in part.column(place).to_pylist()])
                counts = [len(x) // 4 for x in ids]
                back = [vocabulary.decode(x) for x in ids]
                new = [pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "ids", "n_tokens", "decoded"])

    schema = StructType([*df.schema.fields, *_ADDED.fields])
    return df.mapInArrow(coded, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes behind packed ids; null stays null. An id that the vocabulary lacks raises KeyError."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            yield pa.array([None if x is None else vocabulary.decode(x) for x in batch.to_pylist()], pa.binary())

    return df.withColumn("decoded", texts(F.col(ids)))
