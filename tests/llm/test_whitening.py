"""Operator 11 against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, kept=32):
    """x, eigenvalues (falling) and eigenvectors of the good rows."""
    x = np.floor(64 * np.array([v for _, v in rows], float)) + 1_000_000
    c = x - x.sum(axis=0) / len(x)
    e, q = np.linalg.eigh(c.T @ c / len(x))
    return x.astype(np.int64), c, e[::-1], q[:, ::-1]


def check(got, rows, many):
    x, c, e, q = plain(rows)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert wide.shape == (len(rows), many) and list(wide.columns) == list(range(1, many + 1))
    want = (c @ q[:, :many] / np.sqrt(e[:many]))[np.argsort([k for k, _ in rows])]
    own = wide.to_numpy()
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), e[:many] / e.sum(), rtol=1e-9)
    far = {k: sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(r, x.sum(axis=0), strict=True)) for (k, _), r in zip(rows, x, strict=True)}
    assert all(far[k] == v for k, v in zip(got["vec_id"], got["deviation"], strict=True))
    assert (got["n"] == len(rows)).all() and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize(("n", "d", "decay"), [(400, 64, 0.0), (400, 80, 0.15), (300, 20, 0.3), (30, 64, 0.0), (200, 90, 0.02)])
def test_equals_eigenvectors(spark, n, d, decay):
    rng = np.random.default_rng(n + d)
    data = rng.normal(size=(n, d)) * np.exp(-decay * np.arange(d)) * 4 + rng.normal(size=d)
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(data)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    check(got, rows, min(32, d, n - 1))


def test_bad_rows_are_left_out(spark):
    rng = np.random.default_rng(3)
    good = [(k, np.float32(v).tolist()) for k, v in enumerate(rng.normal(size=(60, 6)))]
    bad = [(100, None), (101, [None] * 6), (102, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (103, [float("inf")] * 6), (104, []), (105, [1.0, 2.0])]
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in good + bad], SCHEMA + ", x string, N int").repartition(4)
    check(whitening.whitened(docs).toPandas(), good, 6)


def test_degenerate_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], SCHEMA)).count() == 0
    # a repeated row and a null id count; a line has one component
    got = whitening.whitened(spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [2.0, 2.0])], SCHEMA)).toPandas()
    assert len(got) == 4 and set(got["component"]) == {1} and (got["n"] == 4).all() and abs(got["explained"].iloc[0] - 1) < 1e-12


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(k * 1e10), -float(k) * 2**40, 1.0]) for k in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    x, c, e, q = plain(rows)
    far = {k: sum((5 * int(v) - int(sum(int(y) for y in x[:, j]))) ** 2 for j, v in enumerate(r)) for (k, _), r in zip(rows, x, strict=True)}
    assert all((v == far[k]) if far[k] < 1 << 63 else v != v for k, v in zip(got["vec_id"], got["deviation"].astype(object), strict=True))
