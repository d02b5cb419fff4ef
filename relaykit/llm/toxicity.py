"""Toxic passages as maximum-scoring segments of token log-odds.

Training compares in how many toxic and other documents a token occurs, under an informative Dirichlet prior; tokens
whose log-odds stand out get a positive score, all others a small negative one. (Documents are counted, not
occurrences: these come in bursts, which would make chance words of one long document stand out.) One linear scan finds every maximal
segment of a text (a passage that neither a shorter nor a longer one beats). Under the null model the largest
segment score of n tokens has an extreme-value distribution; ``lambda * score - ln(n)`` is the same for short and
long texts. A logistic curve over that figure, fitted on training documents that the token scores have not seen,
gives the probability; texts without a scoring token get the share of label 1 among such documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaykit.llm.common import cut, slices

TOKEN = re.compile(r"[^\W\d_]+")
# A word also counts by its beginnings, as abuse is inflected.
STEMS = (4, 5, 6)
_KNOWN_WORDS = 150_000
# Weight of the squared coefficients of the calibration, against one for each row.
RIDGE = 0.02


def features(word: str) -> list[str]:
    """The word, and each of its beginnings, marked by an asterisk."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


class _WordScores(dict):
    """Score of each word met: that of its best known feature, 0 for none. A worker forgets them all when there are many."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        found = self[word] = max((self.scores.get(f, 0.0) for f in features(word)), default=0.0)
        return found


@dataclass(frozen=True)
class Training:
    # At most about so many labelled documents are learnt from, chosen by a hash of their id.
    documents: int = 20_000
    # Share of them that calibrates the score and gives no token counts.
    calibration: int = 4
    # Weight of the prior, in tokens: at most so many, and so large a share of all those counted. Its shape is the
    # frequency of tokens in all training documents.
    prior: float = 10_000.0
    prior_share: float = 0.1
    # A token scores if its log-odds are so many standard errors above zero ...
    least_z: float = 4.0
    # ... and occurs in so many training documents.
    least_documents: int = 5
    # Size of the model: the tokens of highest z.
    tokens: int = 50_000


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    other: float
    rate: float
    slope: float
    offset: float
    # Score of a text without any scoring token.
    none: float


def segments(positions: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), given the scoring tokens; the rest score ``other`` < 0.

    Ruzzo and Tompa's scan: linear, as each segment is pushed once and merged once.
    """
    kept: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, at = 0.0, -1
    for position, score in zip(positions, scores):
        total += other * (position - at - 1)
        at = position
        first, left, right = position, total, total + score
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((first, position, left, right))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
        total = right
    return [(a, b, right - left) for a, b, left, right in kept]


def _figures(text: str, model: Model, known: _WordScores) -> tuple[float, int, list[tuple[int, int, float]]]:
    tokens = TOKEN.findall(text.lower())
    if len(known) > _KNOWN_WORDS:
        known.clear()
    scores = list(map(known.__getitem__, tokens))
    hits = [i for i, s in enumerate(scores) if s]
    found = segments(hits, [scores[i] for i in hits], model.other) if hits else []
    best = max((s for _, _, s in found), default=0.0)
    return model.rate * best - math.log(len(tokens) + 1), len(tokens), found


def train(labelled: DataFrame, text: str = "text", label: str = "label", row_id: str = "doc_id", how: Training = Training()) -> Model:
    """Learns from rows with label 0 or 1; rows with other or null labels are not used, a null text counts as empty.

    Without rows of both labels, or words that tell them apart, every text scores the share of label 1 (or one half). Repeated rows count repeatedly.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(row_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    n = rows.count()
    mixed = F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1)))
    # Folds are dealt within each label; copies of a text share one. The sample is bounded, so two windows hold it.
    place = F.dense_rank().over(Window.partitionBy("label").orderBy(F.xxhash64("text")))
    rows = cut(rows.filter(mixed < how.documents).withColumn("fold", F.pmod(place, F.lit(how.calibration))))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                counts = (Counter(), Counter())
                for body, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = set(TOKEN.findall(body.lower()))
                    counts[toxic].update({f for word in words for f in features(word)})
                tokens = list(counts[0] | counts[1])
                columns = [tokens, [counts[1][t] for t in tokens], [counts[0][t] for t in tokens]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "toxic", "clean"])

    learning = rows.filter("fold > 0").select("text", "label")
    counted = cut(
        learning.mapInArrow(tally, "token string, toxic bigint, clean bigint")
        .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    sums = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    toxic, clean = sums["t"] or 0, sums["c"] or 0
    labels = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, zeros = labels.get(1, 0), labels.get(0, 0)
    if not toxic or not clean:
        return _share(ones, zeros)
    prior = min(how.prior, how.prior_share * (toxic + clean))
    alpha = F.lit(prior) * (F.col("toxic") + F.col("clean")) / F.lit(float(toxic + clean))
    odds = lambda count, total: F.log((count + alpha) / (total + prior - count - alpha))
    delta = odds(F.col("toxic"), float(toxic)) - odds(F.col("clean"), float(clean))
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    chosen = (
        counted.filter(F.col("toxic") + F.col("clean") >= how.least_documents)
        .select("token", delta.alias("delta"), (delta / spread).alias("z"), "clean")
        .filter(F.col("z") > how.least_z).orderBy(F.desc("z"), "token").limit(how.tokens).collect()
    )
    if not chosen:
        return _share(ones, zeros)
    scores = {r["token"]: r["delta"] for r in chosen}
    # Null model: how often a token of a clean document scores, and what; a small cost for all others.
    mean = sum(scores.values()) / max(len(scores), 1)
    seen = [(r["delta"], (r["clean"] + 0.5) / (clean + 1.0)) for r in chosen]
    # A random clean text must lose on average, or its segments would grow with its length.
    other = -max(0.05, mean / 40, 2 * sum(p * s for s, p in seen))
    rate = _rate(seen, other)
    model = Model(scores, other, rate, 0.0, 0.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordScores(model.scores)
        for batch in batches:
            x = [x if found else None for x, _, found in (_figures(t, model, known) for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "label"])

    held = rows.filter("fold = 0").select("text", "label").mapInArrow(measure, "x double, label int").toPandas()
    # Texts without a scoring token have no segment to compare, whatever their length: their own share of label 1.
    hit = held["x"].notna()
    slope, offset = _logistic(held["x"][hit].to_numpy(float), held["label"][hit].to_numpy())
    missed = held["label"][~hit]
    none = (missed.sum() + ones / (ones + zeros)) / (len(missed) + 1)
    return Model(scores, other, rate, slope, offset, float(none))


def _share(ones: int, zeros: int) -> Model:
    """Nothing tells the labels apart: every text scores the share of label 1."""
    share = min(max(ones / (ones + zeros), 1e-6), 1 - 1e-6) if ones + zeros else 0.5
    return Model({}, -1.0, 0.0, 0.0, 0.0, share)


def _rate(seen: list[tuple[float, float]], other: float) -> float:
    """The positive root of ``sum(p * exp(rate * score)) = 1`` for the null model's scores."""
    rest = 1.0 - sum(p for _, p in seen)
    value = lambda r: sum(p * math.exp(min(r * s, 500)) for s, p in seen) + rest * math.exp(r * other) - 1
    low, high = 1e-6, 1e-3
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by short Newton steps; a ridge keeps separable rows from driving it apart."""
    flat = 0.0, math.log((y.sum() + 1) / ((1 - y).sum() + 1))
    if not len(x) or x.std() == 0:
        return flat
    x, y = np.append(x, [x.mean()] * 2), np.append(y, [0, 1])
    middle, width = x.mean(), x.std()
    z = np.stack([(x - middle) / width, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, z.T @ (y - p) - RIDGE * beta), -0.5, 0.5)
        beta += step
        if abs(step).max() < 1e-9:
            break
    if beta[0] <= 0:
        # A worse passage never makes a text less likely toxic.
        return flat
    return float(beta[0] / width), float(beta[1] - beta[0] * middle / width)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (probability of label 1) and ``passages`` to every row; columns of these names are replaced.

    ``passages`` are the maximal segments: first and last token (from 0), score, and ``expected``, the number of
    segments of that score that clean text of this length would hold. Null and empty texts have no token and are
    scored as such. The model, at most ``Training.tokens`` tokens, is broadcast. One pass without a shuffle.
    """
    df = df.drop("score", "passages")
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)
    passages = "passages array<struct<first: int, last: int, score: double, expected: double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _WordScores(model.scores)
        for batch in batches:
            for part in slices(batch, place):
                found = [_figures(t or "", model, known) for t in part.column(place).to_pylist()]
                curve = lambda x: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * x + model.offset))))
                chance = [curve(x) if f else model.none for x, _, f in found]
                runs = [
                    [{"first": a, "last": b, "score": s, "expected": (n + 1) * math.exp(-model.rate * s)} for a, b, s in f]
                    for _, n, f in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(chance, pa.float64()), pa.array(runs, kind)], [*part.schema.names, "score", "passages"]
                )

    added = df.sparkSession.createDataFrame([], f"score double, {passages}").schema
    return df.mapInArrow(scored, StructType([*df.schema.fields, *added.fields]))


def held_out(row_id: Column) -> Column:
    """True for the fifth of the ids that training never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % 5 == 0


def train_on_labels(documents: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A model of ``labels.toxic``, from the labelled documents that are not held out.

    The sample is drawn by a hash of the id on both sides, so only its texts meet their labels.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(max(marks.count(), 1))) < how.documents
    rows = documents.select("doc_id", "text").filter(~held_out(F.col("doc_id"))).filter(chosen)
    return train(rows.join(marks.filter(chosen), "doc_id"), how=how)
