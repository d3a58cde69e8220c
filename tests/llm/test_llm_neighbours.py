"""Neighbour search against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumql.llm import neighbours
from quorumql.llm.neighbours import Tree, chi_square, nearest


def brute(rows, asks, k):
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero([asks(i) for i in ids]):
        score = (vectors * vectors[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    expected = brute(rows, lambda i: i % 20 == 0, 20)
    found = collected(nearest(table, F.col("vec_id") % 20 == 0, 20, cell=128))
    assert found.keys() == expected.keys() and all(len(v) == 20 for v in found.values())
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 20 for q in expected])
    assert recall >= 0.9
    truth = {q: dict(v) for q, v in expected.items()}
    assert all(s == truth[q][i] for q, v in found.items() for i, s in v if i in truth[q])


def test_lengths_differ_and_rows_repeat(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * rng.uniform(0.1, 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties, more than k of them
    expected = brute(rows, lambda i: i % 50 == 0, 10)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, queries in ((10_000, 10_000), (37, 2)):  # with cells in one block and in many
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", queries)
        found = collected(nearest(df, F.col("vec_id") % 50 == 0, 10, sure=0.999999, cell=64))
        assert found == expected


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [0.5, 0.5], "b"), (2, None, "c"), (3, [], "d"), (4, [0.0, 0.0], "e"), (5, [nan, 1.0], "f"), (6, [1.0, None], "g"),
            (7, [inf, 1.0], "h"), (8, [1.0], "i"), (20, [0.9, 0.1], None), (None, [1.0, 1.0], "j"), (40, None, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    found = collected(nearest(df, F.col("vec_id") % 20 == 0, 20))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {0: [20, 1], 20: [0, 1]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, F.lit(True), 5).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest(one, F.lit(True), 5).count() == 0


def test_tree_cells_hold_their_points():
    points = np.random.default_rng(0).normal(size=(500, 3))
    points[:50] = points[0]
    tree = Tree.fit(points, 4, 3)
    cell = tree.cells(points)
    assert cell.min() >= 0 and cell.max() < 16
    assert (points >= tree.low[cell]).all() and (points <= tree.high[cell]).all()


def test_chi_square():
    sample = (np.random.default_rng(1).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    for x in (2.0, 7.3, 13.4, 20.0):
        assert chi_square(np.float64(x), 8) == pytest.approx((sample <= x).mean(), abs=5e-3)


def test_the_stopping_test_decides_what_is_verified():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6000, 64))
    vectors[1:] /= np.linalg.norm(vectors[1:], axis=1)[:, None]
    vectors[0] *= 1.2 / np.linalg.norm(vectors[0])
    rows = pd.DataFrame({"id": np.arange(6000), "vector": list(vectors)})
    space = neighbours.Space(rng.normal(size=(65, neighbours.DIRECTIONS)), 1.44)
    queries = rows.iloc[::20].assign(bound=float("-inf"))
    exact = vectors[::20] @ vectors.T
    exact[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    truth = np.argsort(-exact, axis=1)[:, :20]
    shares, recalls = [], []
    for sure in (0.5, neighbours.SURE, 0.9999999):
        seen = []
        found = pd.concat(neighbours.search_block(space, rows, queries, 20, sure, seen))
        got = found.groupby("query_id")["vec_id"].agg(set)
        recalls.append(np.mean([len(got[20 * i] & set(t)) / 20 for i, t in enumerate(truth)]))
        shares.append(sum(seen) / (300 * 6000))
    assert shares[0] < shares[1] < 0.75 and shares[1] < shares[2]
    assert recalls[0] < recalls[1] and recalls[1] >= 0.9 and recalls[2] > 0.999
    assert neighbours.chi_square(np.float64(neighbours.chi_square_limit(0.92, 24)), 24) == pytest.approx(0.92)


def test_a_repeated_query_key_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])]
    found = collected(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 2))
    assert found == {0: [(1, 2.0), (2, 0.0)]}
