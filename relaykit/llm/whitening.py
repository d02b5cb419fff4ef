"""Whitening of vectors along the principal components of their covariance.

One pass adds up the distinct vectors, one their centred products. The covariance, dimension by dimension, is all that
reaches the driver. There a spectral divide and conquer finds the components: the polar factor of ``C - shift * I``
(its matrix sign) has the projector onto the eigenvectors above the shift, which splits the space into two invariant
subspaces; each is split again until it has one dimension. Polar factors come from the dynamically weighted Halley
iteration, with QR factorisations only (QDWH). Subspaces below the wanted components are left alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaykit.llm.common import shared_folder

EPS = float(np.finfo(float).eps)


def polar(h: np.ndarray, least: float | None = None) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix; ``least`` is a lower bound of its smallest to its largest singular value.

    Directions of a singular value that is zero to rounding come out anywhere between -1 and 1.
    """
    size = len(h)
    x = h / np.linalg.norm(h)
    low = max(least if least is not None else _least_singular(x), EPS)
    eye = np.eye(size)
    # Six rounds do for any condition; rounding may add a few.
    for _ in range(50):
        a, b, c = _weights(low)
        q, _ = np.linalg.qr(np.concatenate([math.sqrt(c) * x, eye]))
        after = (b / c) * x + (a - b / c) / math.sqrt(c) * (q[:size] @ q[size:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (a + b * low * low) / (1 + c * low * low))
        if abs(1 - low) < 10 * EPS and moved < (5 * EPS) ** (1 / 3):
            return x
    raise ArithmeticError("the polar iteration did not settle")


def _least_singular(x: np.ndarray) -> float:
    """A lower bound by the norm of the inverse; 0 if there is none."""
    try:
        bound = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return 0.0
    return 0.9 * bound if math.isfinite(bound) else 0.0


def _weights(low: float) -> tuple[float, float, float]:
    """The weights that bring singular values in [low, 1] to 1 fastest."""
    if 1 - low < EPS:
        return 3.0, 1.0, 3.0
    d = (4 * (1 - low**2) / low**4) ** (1 / 3)
    a = math.sqrt(1 + d) + math.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d))) / 2
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def _split(c: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first ``k`` vectors span the upper invariant subspace; None if all eigenvalues are one to rounding."""
    size = len(c)
    diagonal = np.sort(np.diag(c))
    mean = diagonal.mean()
    spread = np.linalg.norm(c - mean * np.eye(size))
    tolerance = 4 * EPS * scale * size
    if spread <= tolerance:
        return None
    # The middle of the diagonal halves the work; the mean always has eigenvalues on both sides.
    shifts = [float(np.median(diagonal)), mean, *[mean + spread / size * t for t in (0.25, -0.25, 0.1, -0.1, 0.5, -0.5)]]
    best = None
    for shift in shifts:
        moved = c - shift * np.eye(size)
        if np.linalg.norm(moved) == 0:
            continue
        projector = (polar(moved) + np.eye(size)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < size:
            continue
        basis = projector @ np.random.default_rng(size).standard_normal((size, k))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ np.linalg.qr(basis)[0])
        whole, _ = np.linalg.qr(basis, mode="complete")
        left = np.linalg.norm(whole[:, k:].T @ c @ whole[:, :k])
        if best is None or left < best[0]:
            best = (left, whole, k)
        if left <= tolerance:
            break
    return (best[1], best[2]) if best else None


def top_components(c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    scale = float(np.linalg.norm(c))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # Subspaces still to be split, the uppermost last.
    todo = [np.eye(len(c))]
    while todo and len(values) < most:
        basis = todo.pop()
        inner = basis.T @ c @ basis
        inner = (inner + inner.T) / 2
        found = _split(inner, scale) if basis.shape[1] > 1 else None
        if found:
            whole, k = found
            todo += [basis @ whole[:, k:], basis @ whole[:, :k]]
        else:
            values += np.diag(inner).tolist()
            vectors += list(basis.T)
    # Eigenvalues that differ by rounding only may come out of order.
    order = sorted(range(len(values)), key=lambda i: -values[i])[:most]
    return np.array([values[i] for i in order]), np.array([vectors[i] for i in order]).reshape(len(order), len(c)).T


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    # Largest entry of the whitened fit list's covariance minus the identity, as measured over all of it.
    identity_error: float


def scaled(vector: Column, factor: int = 256) -> Column:
    """Whole numbers ``floor(factor * c)``; null for a vector that is null, empty, or holds null or non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * factor).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd, whole)


def _matrix(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length that most of the vectors have, the larger one of equally frequent ones; 0 without vectors."""
    counts = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("length")).count()
    first = counts.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return first[0]["length"] if first else 0


def fit(rows: DataFrame, components: int, vector: str = "x") -> Whitening | None:
    """Learns from the distinct vectors of whole numbers in ``rows``; None if there are none. They must have one length."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select(F.col(vector).alias("x")).filter("x is not null").distinct().write.parquet(folder)
    distinct = spark.read.parquet(folder)
    sums = distinct.mapInArrow(_add_up, "at int, value bigint").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = {r["at"]: r["value"] for r in sums}
    n = found.pop(-1, 0)
    if not n:
        return None
    size = len(found)
    totals = [found[i] for i in range(size)]
    mean = np.array([s / n for s in totals])

    def products(centre: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
        """Mean of the outer products of the centred (and turned) vectors."""
        width = size if turn is None else turn.shape[1]
        upper = np.triu_indices(width)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                if batch.num_rows:
                    y = _matrix(batch) - centre
                    y = y if turn is None else y @ turn
                    total += y.T @ y
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["at", "value"])

        cells = distinct.mapInArrow(add_up, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros((width, width))
        at = np.array([r["at"] for r in cells])
        out[upper[0][at], upper[1][at]] = [r["value"] / n for r in cells]
        return np.triu(out) + np.triu(out, 1).T

    covariance = products(mean, None)
    values, vectors = top_components(covariance, min(components, size))
    trace = float(np.trace(covariance))
    # A direction without variance is given as zero.
    good = values > 4 * EPS * size * trace
    turn = np.where(good, vectors / np.sqrt(np.where(good, values, 1.0)), 0.0)
    error = float(abs(products(mean, turn) - np.eye(len(values))).max())
    return Whitening(n, totals, values, turn, trace, error)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension, and at -1 the number of vectors; exact."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            exact = int(abs(x).max()) * len(x) < 2**62
            part = x.sum(axis=0).tolist() if exact else [sum(c) for c in x.T.tolist()]
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *total], pa.int64())], ["at", "value"])


def whiten(df: DataFrame, components: int = 4, factor: int = 256, vector: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of ``df`` with ``n, deviation, component, whitened, explained, identity_error``: a row for each vector and component.

    Entries become ``x = floor(factor * c)``; the fit list is each distinct ``x`` once. ``deviation`` is the exact sum of
    ``(n * x - S)^2`` and raises an error where it leaves 64 bits. Components are numbered from 1 by falling eigenvalue
    ``e`` and have unit length; ``whitened`` is the projection of ``x - S / n`` over the root of ``e``, and 0 where ``e``
    is 0 to rounding (``identity_error`` then is 1); ``explained`` is ``e`` over the trace, 0 if that is 0.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those whose length
    is not the usual one. Repeated rows stay, as do other columns; columns named like the added ones are replaced. An
    empty table gives an empty result. The model (dimension x components) is bounded by the dimension, not by rows.
    """
    added = ["n", "deviation", "component", "whitened", "explained", "identity_error"]
    own = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c not in added])
    rows = df.select(own.alias("row"), scaled(F.col(f"`{vector}`"), factor).alias("x"))
    length = usual_length(rows, "x")
    rows = rows.filter(F.size("x") == length) if length else rows.filter("false")
    model = fit(rows, components)
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    sums, n = F.array(*[F.lit(s).cast("long") for s in model.sums]).cast("array<bigint>"), F.lit(model.n).cast("long")
    far = F.zip_with("x", sums, lambda x, s: n * x - s)
    deviation = F.aggregate(far, F.lit(0).cast("long"), lambda total, d: total + d * d)
    shared = df.sparkSession.sparkContext.broadcast((np.array([s / model.n for s in model.sums]), model.vectors))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = shared.value
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch, 1) - mean) @ turn
                ends = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))], ["row", "deviation", "y"])

    inner = rows.select("row", "x", deviation.alias("deviation"))
    schema = inner.select("row", "deviation", F.array().cast("array<double>").alias("y")).schema
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values]).cast("array<double>")
    every = inner.mapInArrow(project, schema).select("row", "deviation", F.posexplode("y").alias("at", "whitened"))
    return every.select(
        "row.*", n.alias("n"), "deviation", (F.col("at") + 1).alias("component"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
