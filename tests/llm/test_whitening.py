"""Whitening against a dense eigensolver and exact integers."""

from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import catalog, whitening


def matrix(kind, size, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = {"spread": np.geomspace(1e6, 1e-6, size), "close": 1 + np.arange(size) * 1e-7, "equal": np.ones(size),
              "pairs": np.repeat(np.arange(1, size // 2 + 2), 2)[:size].astype(float), "zero": np.r_[np.ones(1), np.zeros(size - 1)],
              "centre": np.r_[3.0, 2.0, 1.0, np.zeros(size)][:size] if size > 3 else np.ones(size)}[kind]
    a = q * values @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ["spread", "close", "equal", "pairs", "zero", "centre"])
@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_components(kind, size):
    a = matrix(kind, size, size)
    values, vectors = whitening.top_components(a, 4)
    scale = np.abs(a).max()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:4], rtol=0, atol=1e-13 * scale * size)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale * size


def test_polar_factor():
    a = matrix("spread", 12, 1) - 0.5 * np.eye(12)
    u = whitening.polar_factor(a)
    assert np.abs(u @ u - np.eye(12)).max() < 1e-12 and np.linalg.eigvalsh(u @ a).min() > 0


def plain(vectors, k=4, scale=256):
    """{row: (n, deviation, whitened, explained)} of usable rows of one length."""
    x = [[int(np.floor(scale * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit, float) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = (centred ** 2).sum() / n
    return [(n, sum((n * c - s) ** 2 for c, s in zip(row, sums)), (np.array(row, float) - mean) @ axes / np.sqrt(values), values / trace) for row in x]


def same(got, expected):
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    signs = None
    for i, (n, deviation, whitened, explained) in expected.items():
        rows = sorted(by_row.pop(i), key=lambda r: r["component"])
        assert [r["component"] for r in rows] == list(range(1, len(whitened) + 1))
        assert {(r["n"], r["deviation"]) for r in rows} == {(n, deviation)}
        assert np.allclose([r["explained"] for r in rows], explained, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in rows)
        y = np.array([r["whitened"] for r in rows])
        signs = np.sign(y * whitened) if signs is None else signs
        assert np.allclose(y * signs, whitened, rtol=1e-7, atol=1e-7)
    assert not by_row


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    same(catalog.QUERIES["op12_whitening"](spark, sf).collect(), dict(zip([r["vec_id"] for r in rows], plain([r["embedding"] for r in rows]))))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [[float(v) for v in rng.standard_normal(3)] for _ in range(40)] + [[-0.0, 0.001, 5.0]] * 7
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0]]
    schema = "x string, component int, vec_id long, embedding array<double>, dim string"
    df = spark.createDataFrame([("a", 0, i, v, "d") for i, v in enumerate(good + bad)], schema)
    same(whitening.whiten(df.repartition(7)).collect(), {i: v for i, v in enumerate(plain(good, 3))})


def test_lengths_have_their_own_fits(spark):
    rng = np.random.default_rng(6)
    two, five = ([[float(v) for v in rng.standard_normal(d)] for _ in range(30)] for d in (2, 5))
    df = spark.createDataFrame(list(enumerate(two + five)) + [(99, [1.0] * 9), (None, two[0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in got} == {*range(60), None}  # a vector alone of its length has no component
    two, five = ([list(map(float, np.float32(v))) for v in x] for x in (two, five))
    same([r for r in got if r["dim"] == 5], {30 + i: v for i, v in enumerate(plain(five))})
    same([r for r in got if r["dim"] == 2 and r["vec_id"] is not None], dict(enumerate(plain(two))))


def test_large_values(spark):
    rows = [(i, [float(i) * 1e15, 1e300 if i == 3 else 1.0]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    assert {r["vec_id"] for r in got} == set(range(5)) and all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in got)


def test_empty_and_constant(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.5, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"], r["explained"]) for r in one) == [(1, 1, -1.0, 1.0), (2, 1, 1.0, 1.0)]
