"""Token counts of a unigram segmentation, computed once for each distinct pre-token prefix.

The best segmentation of a pre-token is a forward pass over its bytes: the price of a prefix is the least price of
a shorter prefix plus that of the token between them. Distinct pre-tokens form a trie; a node's price depends on its
prefix alone, so it is computed once, and a terminal node keeps the number of tokens. The trie is walked in byte
order, so only the path to the current node is held.

The prices are minus log probabilities of a unigram model over a given vocabulary, estimated from the corpus by
expectation-maximisation. The trie serves that too: forward sums belong to prefixes, and the backward sums of all
pre-tokens under a node, weighted by count and divided by their totals, add up when the walk leaves it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from relaykit.llm.bpe import _rust_spaces, chunks, read_ranks
from relaykit.llm.common import cut, slices

# A price holds ten-thousandths of a nat above, the number of tokens below: of equal prices the fewer tokens win.
COUNT_BITS = 24
COUNT_MASK = (1 << COUNT_BITS) - 1
# Products over so many bytes stay within the range of floats: a token's chance is far above 1e-7.
SHORT = 32
BYTE = 10.0
# The price of no token, and so many words are walked at a time.
FAR = 1 << 61
WALKED = 50_000
# A text has fewer bytes, and so fewer tokens.
PRETOKEN = 1 << 32


@dataclass(frozen=True)
class Estimate:
    rounds: int = 2
    # Pseudo tokens of the prior, a Zipf law by rank: tokens that the corpus lacks keep a price.
    prior: float = 10_000.0
    # A worker passes its counts on when it holds so many distinct chunks.
    held: int = 200_000


def zipf_logs(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Logarithm of a Zipf probability by rank for each token: the prior of the model."""
    total = math.log(sum(1 / (n + 1) for n in range(len(ranks))))
    return {t: -math.log(rank + 1) - total for t, rank in ranks.items()}


def prices_of(logs: dict[bytes, float]) -> dict[bytes, int]:
    """Price of each token: minus its log probability in ten-thousandths, and a count of one.

    Sums of floats depend on the order of tasks in their last digits only, which rounding removes.
    """
    return {t: (round(-p * 1e4) << COUNT_BITS) | 1 for t, p in logs.items()}


def scaled(logs: dict[bytes, float]) -> dict[bytes, float]:
    """Probability of each token times ``BYTE`` for each of its bytes, which keeps products of short words near one."""
    return {t: math.exp(p + len(t) * math.log(BYTE)) for t, p in logs.items() if len(t) <= SHORT}


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values)) if most > -math.inf else most


def _expected_short(counted: list[tuple[bytes, int]], chances: dict[bytes, float], longest: int, expected: dict[bytes, float]) -> None:
    """``expected_counts`` of pre-tokens of at most ``SHORT`` bytes, sorted, by plain sums of products.

    Chances carry a factor for each byte; all segmentations of a pre-token share it, so it falls out of each quotient.
    """
    forward, backward, edges, before, get = [1.0], [0.0], [()], b"", chances.get
    for word, n in [*counted, (b"", 0)]:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        while len(forward) > shared + 1:
            forward.pop()
            below = backward.pop()
            for start, token, chance in edges.pop():
                mass = chance * below
                backward[start] += mass
                expected[token] += forward[start] * mass
        for end in range(shared + 1, len(word) + 1):
            found, total = [], 0.0
            for start in range(max(0, end - longest), end):
                token = word[start:end]
                chance = get(token)
                if chance is not None:
                    found.append((start, token, chance))
                    total += forward[start] * chance
            if not found:
                raise ValueError(f"the vocabulary has no token for byte {word[end - 1]}")
            edges.append(found)
            forward.append(total)
            backward.append(0.0)
        if n:
            backward[-1] += n / forward[-1]
        before = word


def expected_counts(counted: Iterable[tuple[bytes, int]], logs: dict[bytes, float], longest: int, chances: dict[bytes, float] | None = None) -> dict[bytes, float]:
    """How often each token is expected in all segmentations of the pre-tokens, each weighted by its count.

    ``chances``: ``scaled(logs)``, where a caller keeps it. Pre-tokens of over ``SHORT`` bytes are summed by logarithms.
    """
    expected: dict[bytes, float] = defaultdict(float)
    forward, backward, before = [0.0], [-math.inf], b""

    def into(word: bytes, end: int) -> list[tuple[int, bytes, float]]:
        """Tokens that end at ``end``. Found anew on the way back, as a long run of spaces has very many."""
        tokens = ((start, word[start:end]) for start in range(max(0, end - longest), end))
        return [(start, token, logs[token]) for start, token in tokens if token in logs]

    def leave(depth: int) -> None:
        """Nodes below ``depth`` have seen all their pre-tokens: pass their backward sums up."""
        for end in range(len(forward) - 1, depth, -1):
            forward.pop()
            below = backward.pop()
            for start, token, price in into(before, end):
                mass = price + below
                backward[start] = _log_sum([backward[start], mass])
                expected[token] += math.exp(forward[start] + mass)

    words = sorted(counted)
    _expected_short([w for w in words if len(w[0]) <= SHORT], chances or scaled(logs), longest, expected)
    for word, n in words:
        if len(word) <= SHORT:
            continue
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        leave(shared)
        for end in range(shared + 1, len(word) + 1):
            found = into(word, end)
            if not found:
                raise ValueError(f"the vocabulary has no token for byte {word[end - 1]}")
            forward.append(_log_sum([forward[start] + price for start, _, price in found]))
            backward.append(-math.inf)
        before = word
        backward[-1] = _log_sum([backward[-1], math.log(n) - forward[-1]])
    leave(0)
    return dict(expected)


def _cutter(pattern: str) -> tuple[Callable[[str], list], Callable[[object], list[str]]]:
    """How texts are cut into chunks that come again, and the pre-tokens of a chunk. Another pattern leaves texts whole."""
    find = regex.compile(_rust_spaces(pattern)).findall
    if pattern != public_tokenizers.PATTERN:
        return lambda text: [(text,)], lambda chunk: find(chunk[0])

    def pretokens(chunk: object) -> list[str]:
        if type(chunk) is not str:
            return find(chunk[0])
        # A space with letters is one match.
        return [" " + chunk] if chunk.isascii() and chunk.isalpha() else find(" " + chunk)

    return chunks, pretokens


def estimate(df: DataFrame, path: str, pattern: str, text: str = "text", how: Estimate = Estimate()) -> dict[bytes, float]:
    """Log probabilities of a unigram model over the vocabulary of ``path``, estimated on all texts of ``df``.

    The corpus is read once: distinct pre-tokens are counted by task before the shuffle, and stay in Spark, ordered by
    bytes. Each round sums expected counts by token; the driver gets one figure for each token of the vocabulary.
    Null and empty texts count nothing, repeated rows count each; an empty table leaves the prior.
    """
    spark = df.sparkSession
    ranks = read_ranks(path)
    prior = zipf_logs(ranks)
    longest = max(map(len, ranks))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up, pretokens = _cutter(pattern)
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            counts: dict[str, int] = defaultdict(int)
            for chunk, n in found.items():
                for pretoken in pretokens(chunk):
                    counts[pretoken] += n
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                for body in part.column(0).to_pylist():
                    if body:
                        found.update(cut_up(body))
                if len(found) > how.held:
                    yield rows()
                    found.clear()
        yield rows()

    counted = df.select(F.col(text).alias("text")).mapInArrow(distinct, "pretoken string, n bigint")
    counted = counted.groupBy("pretoken").agg(F.sum("n").alias("n"))
    counted = cut(counted.repartitionByRange(F.col("pretoken").cast("binary")).sortWithinPartitions(F.col("pretoken").cast("binary")))
    logs = prior
    for _ in range(how.rounds):
        shared = spark.sparkContext.broadcast(logs)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chances = scaled(shared.value)
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                found = expected_counts(((p.encode(), n) for p, n in pairs), shared.value, longest, chances)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.float64())], ["token", "expected"]
                )

        sums = counted.mapInArrow(expect, "token binary, expected double").groupBy("token").agg(F.sum("expected").alias("expected"))
        seen = {bytes(r["token"]): r["expected"] for r in sums.collect()}
        total = math.log(math.fsum(seen.values()) + how.prior)
        logs = {t: math.log(seen.get(t, 0.0) + how.prior * math.exp(p)) - total for t, p in prior.items()}
    return logs


def count_in_trie(pretokens: set[str], prices: dict[bytes, int], longest: int) -> dict[str, int]:
    """Number of tokens of each pre-token."""
    counts, path, before, get = {}, [0], b"", prices.get
    for word, text in sorted((p.encode(), p) for p in pretokens):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del path[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best = None
            for start in range(max(0, end - longest), end):
                price = get(word[start:end])
                if price is not None:
                    price += path[start]
                    if best is None or price < best:
                        best = price
            if best is None:
                raise ValueError(f"the vocabulary has no token for byte {word[end - 1]}")
            path.append(best)
        before = word
        counts[text] = path[-1] & COUNT_MASK
    return counts


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words of at most ``SHORT`` bytes, filled up with zeros, and their lengths."""
    return np.frombuffer(b"".join(w.ljust(SHORT, b"\0") for w in words), np.uint8).reshape(-1, SHORT), np.array([len(w) for w in words], np.int64)


class Suffixes:
    """The tokens of at most ``SHORT`` bytes as a trie that is read from their ends.

    Its edges, by depth, are sorted keys (state above, byte); an edge's place is the state that it leads to.
    """

    def __init__(self, prices: dict[bytes, int]):
        tokens = [t for t in prices if len(t) <= SHORT]
        letters, lengths = _letters([t[::-1] for t in tokens])
        price, state = np.array([prices[t] for t in tokens], np.int64), np.zeros(len(tokens), np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(SHORT):
            longer = lengths > depth
            if not longer.any():
                break
            letters, lengths, price, state = letters[longer], lengths[longer], price[longer], state[longer]
            keys, state = np.unique(state << 8 | letters[:, depth], return_inverse=True)
            ends, level = lengths == depth + 1, np.full(len(keys), FAR)
            level[state[ends]] = price[ends]
            self.levels.append((keys, level))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of sorted words of at most ``SHORT`` bytes: ``count_in_trie`` for all nodes of one depth at once."""
        letters, lengths = _letters(words)
        # How many bytes a word shares with the one before it: so many of its nodes are done.
        same = np.cumprod(letters[1:] == letters[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        shared = np.concatenate([[0], np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))])
        order = np.arange(len(words))
        path = [np.zeros(len(words), np.int64)]
        for end in range(1, int(lengths.max()) + 1):
            fresh = (shared < end) & (lengths >= end)
            best = np.full(len(words), FAR)
            at = np.flatnonzero(fresh)
            state = np.zeros(len(at), np.int64)
            for start, (keys, price) in zip(range(end - 1, -1, -1), self.levels):
                key = state << 8 | letters[at, start]
                state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = keys[state] == key
                at, state = at[found], state[found]
                if not len(at):
                    break
                best[at] = np.minimum(best[at], path[start][at] + price[state])
            missing = np.flatnonzero(fresh & (best >= FAR))
            if len(missing):
                raise ValueError(f"the vocabulary has no token for byte {letters[missing[0], end - 1]}")
            path.append(best[np.maximum.accumulate(np.where(fresh, order, 0))])
        return np.stack(path)[lengths, order] & COUNT_MASK


def count_all(pretokens: set[str], prices: dict[bytes, int], longest: int, suffixes: Suffixes) -> dict[str, int]:
    """``count_in_trie``, with short pre-tokens counted by ``suffixes`` of the same prices."""
    short, long = [], set()
    for pretoken in pretokens:
        word = pretoken.encode()
        if len(word) <= SHORT:
            short.append((word, pretoken))
        else:
            long.add(pretoken)
    counts = count_in_trie(long, prices, longest)
    short.sort()
    for at in range(0, len(short), WALKED):
        words, texts = zip(*short[at : at + WALKED])
        counts.update(zip(texts, suffixes.count(words).tolist()))
    return counts


def count_tokens(df: DataFrame, logs: dict[bytes, float], pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``n_pretokens`` (matches of ``pattern``) to every row; a column of such a name is replaced.

    ``logs``: log probability of each token, as ``estimate`` gives them.

    One pass without a shuffle. Null and empty texts have 0. Repeated rows are counted each; an empty table stays empty.
    """
    df = df.drop("n_tokens", "n_pretokens")
    shared = df.sparkSession.sparkContext.broadcast(prices_of(logs))
    place = df.columns.index(text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices = shared.value
        longest = max(map(len, prices))
        suffixes = Suffixes(prices)
        cut_up, pretokens = _cutter(pattern)
        # Tokens of a chunk, and above ``PRETOKEN`` its pre-tokens.
        known: dict = {}
        for batch in batches:
            for part in slices(batch, place, 2_000_000):
                found = [cut_up(t) if t else [] for t in part.column(place).to_pylist()]
                # Bounded memory: what the slice does not need is forgotten once many are known.
                needed = set().union(*found)
                if len(known) > 500_000:
                    known = {c: known[c] for c in needed & known.keys()}
                fresh = {c: pretokens(c) for c in needed - known.keys()}
                counts = count_all(set().union(*fresh.values()), prices, longest, suffixes)
                for chunk, parts in fresh.items():
                    known[chunk] = sum(map(counts.__getitem__, parts)) + len(parts) * PRETOKEN
                sums = [sum(map(known.__getitem__, f)) for f in found]
                tokens = pa.array([n % PRETOKEN for n in sums], pa.int64())
                words = pa.array([n // PRETOKEN for n in sums], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, tokens, words], [*part.schema.names, "n_tokens", "n_pretokens"]
                )

    schema = StructType([*df.schema.fields]).add("n_tokens", LongType()).add("n_pretokens", LongType())
    return df.mapInArrow(counted, schema)
