"""Whitening against a direct eigendecomposition, its parts against the matrices they stand for, and odd vectors."""

import math

import numpy as np
import pytest

from rowledger.llm import queries, whitening
from rowledger.llm.common import table

DATA = "/root/testdata/sf0.001"


def scatter(rows):
    off = rows - rows.mean(axis=0)
    return off.T @ off


@pytest.mark.parametrize("kind", ["whole", "ties", "few dimensions", "flat", "one"])
def test_spectrum_is_the_scatter(kind):
    rng = np.random.default_rng(3)
    rows = {
        "whole": np.floor(rng.normal(size=(150, 12)) * 30), "ties": rng.integers(0, 2, size=(200, 5)).astype(float),
        "few dimensions": np.floor(rng.normal(size=(90, 2)) * 9) @ np.arange(1, 15).reshape(2, 7), "flat": np.full((40, 3), 5.0),
        "one": rng.normal(size=(60, 1)),
    }[kind]
    plain, block, left, right = (whitening.Spectrum(rows.shape[1]) for _ in range(4))
    for r in rows:
        plain.add(r)
    block.add_block(rows)
    left.add_block(rows[:30])
    for r in rows[30:]:
        right.add(r)
    left.combine(right)
    whole = scatter(rows)
    for found in (plain, block, left, whitening.Spectrum.from_bytes(plain.to_bytes(), rows.shape[1])):
        assert found.n == len(rows) and np.allclose(found.mean, rows.mean(axis=0), atol=1e-9)
        assert np.allclose(found.vectors * found.values @ found.vectors.T, whole, atol=1e-8 * max(1, whole.max()))
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(rows.shape[1]), atol=1e-10)


def test_secular_equation():
    rng = np.random.default_rng(4)
    for size in (1, 2, 9, 40):
        d, z = np.sort(rng.uniform(0, 100, size)), rng.normal(size=size) * 10.0 ** rng.integers(-4, 3, size)
        roots, turn = whitening.secular(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(roots, want, rtol=1e-12, atol=1e-12 * want.max())
        assert np.allclose(turn.T @ turn, np.eye(size), atol=1e-12)


def direct(vectors):
    """(sound rows of whole numbers, distinct ones) in plain Python."""
    sound = [v for v in vectors if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    size = max(map(len, sound))
    x = np.array([[math.floor(float(np.float32(e)) * 256) for e in v] + [0] * (size - len(v)) for v in sound])
    return x, np.unique(x, axis=0)


def compare(got, x, fit):
    """Rows by id against the eigendecomposition of the covariance."""
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(scatter(fit.astype(float)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    assert [r.deviation for r in got if r.component == 1] == [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums)) for row in x]
    for k in range(4):
        mine = np.array([r.whitened for r in got if r.component == k + 1])
        want = (x - sums / n) @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(got[k].explained / (values[k] / values.sum()) - 1) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_query_is_the_direct_whitening(spark):
    rows = table(spark, DATA, "embeddings").orderBy("vec_id").collect()
    got = sorted(queries.op11_whitening(spark, DATA).collect(), key=lambda r: (r.vec_id, r.component))
    compare(got, *direct([r.embedding for r in rows]))


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    plain = [(i, [float(e) for e in rng.normal(size=6)]) for i in range(40)]
    odd = [
        (50, None), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (52, [float("nan")] * 6), (53, [float("inf")] + [0.0] * 5), (54, [float("-inf")] + [0.0] * 5),
        (55, [-0.001, -0.0, 0.0, 0.0, 0.0, 0.0]), (56, []), (57, [0.5]), *[(58, [0.25] * 6)] * 30, (None, [0.125] * 6),
    ]
    docs = spark.createDataFrame(plain + odd, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as component", "1 as n", "2 as x", "3 as whitened", "'p' as part")
    got = sorted(whitening.whiten(docs.repartition(5)).collect(), key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.component))
    kept = sorted((r for r in plain + odd if not 50 <= (r[0] or 0) <= 54), key=lambda r: (r[0] is not None, r[0] or 0))
    # repeated rows are learned once and returned each
    by_component = sorted(got, key=lambda r: (r.vec_id is not None, r.vec_id or 0))
    assert len(got) == 4 * len(kept) and sum(r.vec_id == 58 for r in got) == 120
    repeated = {k: {r.whitened for r in by_component if r.vec_id == 58 and r.component == k} for k in (1, 2, 3, 4)}
    assert all(len(v) == 1 for v in repeated.values())
    ordered = [r for vec_id in dict.fromkeys(i for i, _ in kept) for r in by_component if r.vec_id == vec_id]
    x, fit = direct([v for _, v in kept])
    compare(ordered, x, fit)


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.where("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [5.0, 10.0])], schema)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(rows).collect()}
    assert got == {1: None, 2: None, 3: 0}
