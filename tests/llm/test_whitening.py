"""Whitening against a dense eigensolver, and odd tables."""

import math

import numpy as np
import pytest

from sourceloom.llm import whitening
from sourceloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def dense(vectors):
    """Grid, fit list, eigenpairs by a dense solver."""
    grid = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(grid, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - 1_000_000) - (sums - 1_000_000 * n) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return grid, n, sums, values[::-1], vectors[:, ::-1]


def test_query_matches_a_dense_solver(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    grid, n, sums, values, vectors = dense([r["embedding"] for r in rows])
    got = QUERIES["op13_chebyshev_whitening"](spark, SF).toPandas()
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    ids = {r["vec_id"]: g for r, g in zip(rows, grid)}
    for c in range(1, 17):
        part = got[got["component"] == c]
        want = np.array([((ids[i] - sums / n) @ vectors[:, c - 1]) / math.sqrt(values[c - 1]) for i in part["vec_id"]])
        have = part["whitened"].to_numpy()
        sign = np.sign(have @ want)
        assert np.abs(have - sign * want).max() < 1e-7
        assert np.allclose(part["explained"], values[c - 1] / values.sum(), rtol=1e-9)
    exact = {i: int(sum((n * int(x) - int(s)) ** 2 for x, s in zip(g, sums))) for i, g in ids.items()}
    assert all(exact[i] == d for i, d in zip(got["vec_id"], got["deviation"]))


@pytest.mark.parametrize("shape", ["flat", "falling", "equal", "low rank"])
def test_iteration_on_known_spectra(shape):
    rng = np.random.default_rng(5)
    d = 90
    values = {
        "flat": np.linspace(60, 70, d),
        "falling": 1000.0 * 0.8 ** np.arange(d),
        "equal": np.r_[[9.0] * 10, [4.0] * 10, np.ones(d - 20)],
        "low rank": np.r_[[5.0, 3.0, 2.0], np.zeros(d - 3)],
    }[shape]
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (basis * values) @ basis.T
    found = whitening.leading(lambda y: v @ y, d, 16)
    want = np.sort(values)[::-1][:16]
    want = want[want > 0]
    assert np.allclose(found.values, want, rtol=1e-12, atol=1e-12) and len(found.values) == len(want)
    assert np.abs(v @ found.vectors - found.vectors * found.values).max() < 1e-10 * want[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(want))).max() < 1e-12


def test_damping_saves_passes():
    """The filter needs far fewer products than plain subspace iteration would."""
    rng = np.random.default_rng(1)
    values = np.linspace(10, 20, 200)
    basis = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    v = (basis * values) @ basis.T
    found = whitening.leading(lambda y: v @ y, 200, 8)
    ratio = values[-17] / values[-8]
    assert found.passes < 0.2 * math.log(1e-12) / math.log(ratio)


SCHEMA = "vec_id long, embedding array<double>, n int, g string, cell int"


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -3.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [-0.01, 7.0]), (7, []), (8, [0.505, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = whitening.whiten(frame).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1, 6, 8]
    assert {r["n"] for r in got} == {3} and all(len(r["whitened"]) == 2 for r in got)
    same = [r["whitened"] for r in got if r["vec_id"] in (1, 8)]
    assert same[0] == same[1] == same[2]
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in one] == [(1, 0, [])] * 2
    with pytest.raises(ValueError, match="lengths differ"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(i) * 2.0**30, -1.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [i << 36 for i in range(20)]
    for r in got:
        assert int(r["deviation"]) == (20 * x[r["vec_id"]] - sum(x)) ** 2
    assert got[0]["identity_error"] < 1e-9 and len(got[0]["whitened"]) == 1
