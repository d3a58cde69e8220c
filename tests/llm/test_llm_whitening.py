"""Whitening against a dense eigenvalue decomposition, exact sums, and tables with odd rows."""

import numpy as np
import pytest

from quorumql.llm.whitening import filtered, leading, lower_bound, whiten


def vectors(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * (np.linspace(2, 0.2, d) if spread is None else spread)).astype(np.float32).astype(np.float64)


def dense(x):
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    near = (x - np.round(x.mean(axis=0))).astype(float)
    near -= near.mean(axis=0)
    values, turn = np.linalg.eigh(near.T @ near / n)
    return deviation, values[::-1], near @ turn[:, ::-1]


def check(done, keys, x, components):
    deviation, values, along = dense(x)
    found = {}
    for r in done.collect():
        found.setdefault(r.key, {})[r.component] = r
    assert sorted(found) == sorted(keys) and all(sorted(v) == list(range(1, components + 1)) for v in found.values())
    for k, own in zip(keys, deviation):
        assert {(int(r.deviation), r.n) for r in found[k].values()} == {(own, len(x))}
    for c in range(components):
        got = np.array([found[k][c + 1].whitened for k in keys])
        expected = along[:, c] / np.sqrt(values[c])
        assert np.abs(got - expected * np.sign(got @ expected)).max() < 1e-8
        assert found[keys[0]][c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
        assert found[keys[0]][c + 1].identity_error < 1e-10


@pytest.mark.parametrize("width, components", [(12, 4), (3, 32), (40, 6)])
def test_whitened_values_equal_a_dense_decomposition(spark, width, components):
    rows = vectors(300, width)
    rows[:100] = rows[0]  # a vector that a third of the rows share
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)
    check(whiten(df, components=components, guard=3, degree=6), list(range(300)), np.floor(64 * rows).astype(np.int64) + 1_000_000, min(width, components))


def test_close_eigenvalues_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = df.toPandas()
    x = np.floor(64 * np.stack(held["embedding"].to_numpy()).astype(np.float64)).astype(np.int64) + 1_000_000
    check(whiten(df), held["vec_id"].tolist(), x, 32)


def test_odd_rows_are_dropped_and_the_rest_kept(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [1.0, None, 2.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    good = [[0.5, 1.0, -2.0], [3.0, 1.5, 0.25], [0.5, 1.0, -2.0], [-1.0, 4.0, 1.0], [2.0, -3.0, 0.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(good)] + [(4, good[4], 2, "x"), (None, good[1], 3, "y")] + [(90 + i, v, 4, "z") for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, key string")
    done = whiten(df).collect()
    assert sorted((str(r.key), r.component) for r in done) == sorted((str(k), c) for k in (0, 1, 2, 3, 4, 4, None) for c in (1, 2, 3))
    assert {r.n for r in done} == {7}
    same = {r.component: r.whitened for r in done if r.key == 0}
    assert all(r.whitened == same[r.component] for r in done if r.key == 2)


def test_no_variance_and_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten(empty).collect() == []
    one = whiten(spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.key, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(7, 1, 0, None, None, None)] * 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    done = whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in done) and len(done) == 27
    assert all(r.identity_error < 1e-10 for r in done)


def test_large_entries_stay_exact(spark):
    rows = [(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [3.0, 1e14])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    sums = x.sum(axis=0)
    assert {r.key: int(r.deviation) for r in whiten(df).collect()} == {i: sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}


def test_filter_damps_the_unwanted_part_only():
    values = np.concatenate([np.linspace(1, 5, 40), [5.5, 6, 9]])
    apply = lambda b: values[:, None] * b
    out = np.abs(filtered(apply, np.ones((43, 1)), 8, 1.0, 5.0, 9.0)[:, 0])
    assert out[:40].max() < out[40] < out[41] < out[42] <= 1.0001
    assert all(0 <= lower_bound(apply, np.ones(43), steps) <= 1.0 + 1e-9 for steps in (2, 12, 43))
    found, turn, share = leading(apply, 43, 3, guard=4, degree=8)
    assert np.allclose(found, [9, 6, 5.5]) and share < 1e-12 and np.allclose(np.abs(turn[[42, 41, 40], [0, 1, 2]]), 1)
