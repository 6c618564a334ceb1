"""Whitening against dense linear algebra and exact whole numbers."""

import math

import numpy as np
import pytest

from folioscope.llm import plans, whitening

SMALL = "/root/testdata/sf0.001"


def slow(vectors, k=16):
    """n, deviations, whitened, explained of plain lists, from numpy's eigenvectors."""
    usable = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) for v in vectors]
    x = [[math.floor(64 * c) + 1000000 for c in v] for v, u in zip(vectors, usable) if u]
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [s / n for s in sums]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in fit])
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    rows = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], rows @ found / np.sqrt(values), values / np.trace(centred.T @ centred / n), usable, mean


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, white, explained, usable, _ = slow([r["embedding"] for r in rows])
    ids = [r["vec_id"] for r, u in zip(rows, usable) if u]
    got = {(r["vec_id"], r["component"]): r for r in plans.op11_whitening(spark, SMALL).collect()}
    assert len(got) == 16 * len(ids) and sorted({i for i, _ in got}) == sorted(ids)
    for c in range(16):
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine, sign * white[:, c], rtol=1e-8, atol=1e-9)
        assert got[ids[0], c + 1]["explained"] == pytest.approx(explained[c], rel=1e-12)
    for i, d in zip(ids, deviations):
        assert (got[i, 1]["deviation"], got[i, 16]["n"]) == (d, n)
    assert len({r["identity_error"] for r in got.values()}) == 1 and got[ids[0], 1]["identity_error"] < 1e-10


def test_factor_and_rotation():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (2, 1), (7, 7), (16, 5), (33, 33)):
        root = rng.standard_normal((d, rank)) * 10.0 ** rng.integers(-1, 2, rank)
        a = root @ root.T
        g = whitening.pivoted_cholesky(a)
        assert g.shape[1] == rank and np.allclose(g @ g.T, a, rtol=0, atol=1e-12 * a.max())
        assert all((g[:, k] != 0).sum() <= d - k for k in range(rank))  # a triangle up to the order of rows
        values, vectors = whitening.eigen(a)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-13)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-13 * a.max())
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def test_small_eigenvalues_keep_their_digits():
    """Variances from 1 to 1e-16: a rotation of the covariance itself would lose the small ones."""
    scale = 10.0 ** -np.arange(0, 9)
    mixed = np.full((9, 9), 0.3) + 0.7 * np.eye(9)
    a = scale[:, None] * mixed * scale
    values, vectors = whitening.eigen(a)
    assert len(values) == 9
    assert np.prod(values) == pytest.approx(np.linalg.det(mixed) * np.prod(scale**2), rel=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.uniform(-2, 2, 3).tolist() for _ in range(12)]
    vectors += [vectors[0], vectors[0], None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    schema = "row string, v array<double>, whitened int, n int"
    df = spark.createDataFrame([(f"r{i}", v, i, 1) for i, v in enumerate(vectors)], schema)
    got = whitening.whiten(df, "v", 5).collect()
    n, deviations, white, explained, _, _ = slow(vectors[:14], 5)
    assert n == 12 and len(got) == 14 * 3 and {r["n"] for r in got} == {12}
    for r in got:
        i, c = int(r["row"]["row"][1:]), r["component"] - 1
        assert r["row"]["n"] == 1 and int(r["deviation"]) == deviations[i]
        assert abs(r["whitened"]) == pytest.approx(abs(white[i, c]), rel=1e-9) and r["explained"] == pytest.approx(explained[c], rel=1e-12)
    assert whitening.whiten(df.limit(0), "v").count() == 0
    assert whitening.whiten(df.filter("whitened in (0, 12, 13)"), "v").count() == 0  # one distinct vector has no variance
    two = whitening.whiten(df.filter("whitened in (0, 1, 12)"), "v").collect()
    assert {r["component"] for r in two} == {1} and sorted(round(abs(r["whitened"]), 9) for r in two) == [1.0] * 3
    assert whitening.whiten(df.select("v").filter("v is null"), "v").count() == 0


def test_large_numbers_are_exact(spark):
    vectors = [[1e9, -3e9], [2e9 + 0.5, 7.0], [-4e9, 123456.789], [0.0, 0.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>"), "v").collect()
    want = slow(vectors)[1]
    assert {r["row"]["i"]: int(r["deviation"]) for r in got} == dict(enumerate(want))
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([([float(i % 7) for i in range(2049)],)], "v array<double>"), "v")


def test_long_integer_and_float_lists_are_read_alike(spark):
    as_long = spark.createDataFrame([([i, i * i % 5],) for i in range(9)], "v array<bigint>")
    as_float = as_long.select(as_long["v"].cast("array<float>").alias("v"))
    both = [sorted((r["component"], int(r["deviation"]), round(abs(r["whitened"]), 9)) for r in whitening.whiten(d, "v").collect()) for d in (as_long, as_float)]
    assert both[0] == both[1] and len(both[0]) == 18
