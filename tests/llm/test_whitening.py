"""Whitening against a full eigendecomposition, exact deviations, and odd vectors."""

import math

import numpy as np
import pytest

from quillstream.llm import whitening as W


def plain(vectors, k=4):
    """x of each row, n, S, and eigenvalues and vectors of the distinct rows' covariance."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fitted = np.array(sorted(set(map(tuple, x))), float)
    centred = fitted - fitted.mean(axis=0)
    values, found = np.linalg.eigh(centred.T @ centred / len(fitted))
    sums = [sum(int(c) for c in column) for column in zip(*set(map(tuple, x)), strict=True)]
    return x, len(fitted), sums, values[::-1], found[:, ::-1][:, :k]


def compare(rows, ids, vectors):
    x, n, sums, values, found = plain(vectors)
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i in ids for c in range(1, 5))
    at, mean = {i: k for k, i in enumerate(ids)}, np.array([s / n for s in sums])
    for c in range(1, 5):
        own = [r for r in rows if r["component"] == c]
        wanted = np.array([(np.array(x[at[r["vec_id"]]]) - mean) @ found[:, c - 1] / math.sqrt(values[c - 1]) for r in own])
        got = np.array([r["whitened"] for r in own])
        assert min(np.abs(got - wanted).max(), np.abs(got + wanted).max()) < 1e-8
        assert all(r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) for r in own)
    for r in rows:
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[at[r["vec_id"]]], sums, strict=True))


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = W.op12_embedding_whitening(spark, sf_dir).collect()
    compare(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_copies_have_no_weight_and_bad_vectors_go(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [v.tolist() for v in rng.normal(0, 1, (300, 8)) * np.arange(1, 9)]
    good = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[3]) for i in range(200)]
    bad = [(-1, None), (-2, [None, *vectors[0][1:]]), (-3, [float("nan"), *vectors[0][1:]]), (-4, [float("inf"), *vectors[0][1:]]), (-5, [*vectors[0][1:], float("-inf")])]
    spark.createDataFrame([(i, v, "clash", 0.5) for i, v in good + bad], "vec_id long, embedding array<double>, x string, n double").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(W.op12_embedding_whitening(spark, str(tmp_path)).collect(), [i for i, _ in good], [v for _, v in good])


def query(spark, tmp_path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op12_embedding_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_no_components(spark, tmp_path, rows):
    assert query(spark, tmp_path, rows) == []


def test_fewer_components_than_asked_for(spark, tmp_path):
    rows = query(spark, tmp_path, [(i, [float(i), 2.0 * i, 1.0, *[0.0] * 30]) for i in range(1, 20)] + [(None, [1.0, 2.0])])
    assert {r["component"] for r in rows} == {1, 2} and len(rows) == 40 and sum({r["explained"] for r in rows}) == pytest.approx(1) and rows[0]["identity_error"] < 1e-9
    short = next(r for r in rows if r["vec_id"] is None)  # as [1, 2, 0, 0, ...]
    assert short["n"] == 20 and short["deviation"] == sum((20 * x - s) ** 2 for x, s in ((256, 256 * 191), (512, 512 * 191), (0, 256 * 19)))


def test_large_entries(spark, tmp_path):
    rows = query(spark, tmp_path, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], "double")
    assert {r["vec_id"] for r in rows} == {1, 2, 3} and all(r["deviation"] is None for r in rows if r["vec_id"] < 3)
    x = np.array([[1 << 40, -3], [5, 1 << 20]])
    for n, sums in ((10, [7, 8]), (3, [1 << 41, 0]), (1 << 30, [5, 6])):
        assert W.deviations(x, n, sums) == [d if (d := sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True))) < 1 << 63 else None for row in x]


@pytest.mark.parametrize("spectrum", ["steep", "flat", "equal"])
def test_passes_without_the_covariance(spark, spectrum, monkeypatch):
    """A block narrower than the space: passes go on until residuals certify; close eigenvalues widen it."""
    rng = np.random.default_rng(5)
    dims = 120
    scale = {"steep": 300.0 * 0.5 ** np.arange(dims) + 2, "flat": np.linspace(300, 100, dims), "equal": np.r_[[200.0] * 3, [100.0] * (dims - 3)]}[spectrum]
    x = np.round(rng.normal(0, 1, (3000, dims)) * scale).astype(int)
    model, _ = W.fit(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(4), 4)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    assert np.allclose(model.values, values[::-1][:4], rtol=1e-12)
    for c in range(4):
        assert abs(abs(model.vectors[:, c] @ vectors[:, -1 - c]) - 1) < 1e-10
    assert 1 < model.passes < (12 if spectrum == "steep" else 7)
