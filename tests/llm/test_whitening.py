import math

import numpy as np
import pytest

from watchpost.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim int, rows bigint"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 0, 7, 9) for k, v in vectors], SCHEMA).repartition(3)


def expected(vectors, dim):
    """Every usable vector's exact deviation, and whitened coordinates by a full decomposition."""
    usable = [
        (k, v) for k, v in vectors
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)
    ]
    whole = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in usable]
    n, sums = len(whole), [sum(col) for col in zip(*whole)]
    exact = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for v in whole]
    centred = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in whole])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return usable, exact, centred, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("dim,count", [(12, 300), (70, 500), (3, 40)])
def test_equals_a_full_decomposition(spark, dim, count):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((count, dim)) * np.linspace(3, 1, dim)
    vectors = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    vectors += [
        (None, vectors[0][1]), (7, vectors[1][1]), (7, vectors[1][1]), (1000, None), (1001, []),
        (1002, [None] * dim), (1003, [float("nan")] * dim), (1004, [float("inf")] * dim),
        (1005, [1.0] * (dim + 1)),
    ]
    usable, exact, centred, values, axes = expected(vectors, dim)
    got = whitening.whiten(frame(spark, vectors)).collect()
    most = min(8, dim)
    assert len(got) == len(usable) * most
    assert {r["n"] for r in got} == {len(usable)}
    assert sorted({(r["vec_id"] is None, r["vec_id"], r["deviation"]) for r in got}, key=str) == sorted(
        {(k is None, k, d) for (k, _), d in zip(usable, exact)}, key=str
    )
    # equal ids may have different vectors
    by_id = {(r["vec_id"], r["deviation"], r["component"]): r for r in got}
    keys = [(k, d) for (k, _), d in zip(usable, exact)]
    for c in range(most):
        want = centred @ axes[:, c] / math.sqrt(values[c])
        have = np.array([by_id[k, d, c + 1]["whitened"] for k, d in keys])
        want *= np.sign(want @ have)
        assert np.abs(want - have).max() < 1e-9
        assert by_id[*keys[2], c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_residuals_reach_rounding_error_with_equal_and_close_values():
    values = np.concatenate([[5.0, 5.0, 5.0 - 1e-6, 4.0], np.linspace(3.9, 0.0, 196)])
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((200, 200)))[0]
    matrix = (turn * values) @ turn.T
    theta, axes = whitening.leading_eigenvectors(lambda y: matrix @ y, 200, 8)
    residuals = np.linalg.norm(matrix @ axes - axes * theta, axis=0)
    assert residuals.max() < 1e-12
    assert np.abs(theta - np.sort(values)[::-1][:8]).max() < 1e-12
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-13


@pytest.mark.parametrize("vectors", [
    [], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.5, 0.25, 1.0]) for k in range(5)],
])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_fewer_components_than_dimensions(spark):
    """Entries that do not vary, or vary together, leave fewer components."""
    vectors = [(k, [float(k % 5), 2.0 * (k % 5), 1.0, float(k % 3)]) for k in range(60)]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert sorted({r["component"] for r in got}) == [1, 2]
    assert max(r["identity_error"] for r in got) < 1e-9


def test_very_large_entries(spark):
    vectors = [(k, [1e30 * (k % 2), float(k)]) for k in range(6)]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r["deviation"] for r in got} == {None}
    assert sorted({r["component"] for r in got}) == [1]
