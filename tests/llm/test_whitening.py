from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relaykit.llm import whitening
from relaykit.llm.queries import op12_whitening


def matrices():
    chance = np.random.default_rng(3)
    for size in (1, 2, 3, 7, 40):
        a = chance.standard_normal((size, 3 * size))
        yield a @ a.T
        yield np.eye(size) * 2.5
        q, _ = np.linalg.qr(chance.standard_normal((size, size)))
        yield q @ np.diag(10.0 ** np.arange(0, -size, -1)) @ q.T
        yield q @ np.diag(np.repeat([5.0, 1.0], [size // 2, size - size // 2])) @ q.T
        yield 0.5 * np.eye(size) + 0.5
        yield np.zeros((size, size))
    yield np.array([[1, 0.3], [0.3, 1]])
    yield np.diag([2.0, 2.0, 1.0, 3.0, 2.0])


@pytest.mark.parametrize("c", list(matrices()))
def test_components_equal_the_library(c):
    c = (c + c.T) / 2
    values, vectors = whitening.top_components(c, 4)
    want = np.linalg.eigvalsh(c)[::-1][:4]
    scale = max(np.linalg.norm(c), 1e-300)
    assert len(values) == min(4, len(c)) and abs(values - want).max() <= 1e-13 * scale
    assert abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert abs(c @ vectors - vectors * values).max() <= 1e-13 * scale


def test_polar_factor_is_the_sign():
    chance = np.random.default_rng(1)
    q, _ = np.linalg.qr(chance.standard_normal((30, 30)))
    signs = np.where(np.arange(30) < 11, 1.0, -1.0)
    for sizes in (np.ones(30), 10.0 ** -np.linspace(0, 12, 30), np.linspace(1, 2, 30)):
        got = whitening.polar(q @ np.diag(signs * sizes) @ q.T)
        assert abs(got - q @ np.diag(signs) @ q.T).max() < (1e-3 if sizes.min() < 1e-9 else 1e-12)
        assert abs(got @ got - np.eye(30)).max() < 1e-12


def brute(rows, components=4):
    """Plain computation over whole numbers: id to (deviation, whitened by component), and the figures for all."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in good:
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)))
    return n, out, values / (centred**2).sum() * n


def check(found, rows, components=4):
    n, want, explained = brute(rows, components)
    assert len(found) == sum(map(len, want.values())) * components
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    turned = {}
    for r in found:
        deviation, y = want[r["vec_id"]][0]
        assert r["deviation"] == deviation and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        target = y[r["component"] - 1]
        if abs(target) > 1e-6:
            assert turned.setdefault(r["component"], np.sign(target * r["whitened"])) == np.sign(target * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(target)) < 1e-8


def test_query_equals_a_plain_computation(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}/embeddings.parquet'").fetchall()
        found = op12_whitening(spark, path)
        assert dict(found.dtypes) == {"vec_id": "bigint", "n": "bigint", "deviation": "bigint", "component": "int", "whitened": "double", "explained": "double", "identity_error": "double"}
        check(found.collect(), rows)


def test_odd_vectors_and_columns(spark):
    chance = np.random.default_rng(5)
    body = [(i, [float(c) for c in chance.normal(3, [1, 5, 0.2, 2, 1])]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = [*body, *odd, body[3], *[(200 + i, body[7][1]) for i in range(30)], (300, [-0.0] * 5), (301, [0.0] * 5)]
    frame = spark.createDataFrame([(*r, "a", 1) for r in [*rows, (400, [1.0, 2.0])]], "vec_id long, embedding array<double>, n string, x int")
    found = whitening.whiten(frame)
    assert sorted(found.columns) == sorted(["vec_id", "embedding", "x", "n", "deviation", "component", "whitened", "explained", "identity_error"])
    check(found.collect(), rows)


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns[-1] == "identity_error"
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 1.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert len(line) == 27 and {r["component"]: round(r["explained"], 9) for r in line} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert all(r["whitened"] == 0 for r in line if r["component"] > 1)
    far = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        whitening.whiten(far).select(F.sum("deviation")).collect()
