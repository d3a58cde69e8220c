"""Approximate nearest neighbours by stable projections in a kd-tree, searched until a chi-square test holds.

Nearness is the inner product. One more component, the root of what a vector's squared length lacks to the largest one,
turns it into Euclidean distance: the larger the product with a query, the smaller the distance. Vectors are projected
on a few random normal directions (a 2-stable distribution); for two points at distance d, their squared projected
distance over d*d follows a chi-square distribution with as many degrees of freedom as there are directions.

A kd-tree over the projections, its cuts set on a bounded sample, deals all rows into cells; inside a cell a second tree
deals them into leaves. A query takes its points by growing projected distance, its nearest ones first and then shell by
shell, and verifies their vectors with the exact measure, many pairs at a time; leaves whose box lies outside the radius are not looked at, and
points outside it are not verified. The radius is that within which a point nearer than the k-th best found would, with
probability ``sure``, have been met already; it shrinks with every shell. This happens in two rounds, each a grouped
job: the query's own cell, which gives a bound; then all cells that the test with this bound leaves over.

Every row is indexed. Cells with more rows or queries than a block holds are dealt into blocks, so no task holds more
than a block of either whatever the data look like; the table of cell sizes is broadcast, which has ``MOST_CELLS`` rows
at most. Vectors that are null, empty, zero, or that hold null or non-finite components take no part, nor do those of
another length than the most frequent one (ties: the longer). Of a query key that repeats, the smallest vector asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumql.session import freeze

DIRECTIONS, SURE, LEAF = 24, 0.92, 64
#: Shares of the squared radius at which a shell ends, queries taken at a time, and pairs verified at a time.
SHELLS, CHUNK, PAIRS = (0.4, 0.7, 1.0), 128, 1 << 16
#: Rows in a cell at which the tree is cut further, cells at most, and rows of the sample that sets the cuts.
CELL, MOST_CELLS, SAMPLE = 4096, 4096, 20_000
#: Rows and queries at most that one task compares.
BLOCK, QUERY_BLOCK = 16_384, 2048


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype=np.float64) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / factorial(i) for i in range(freedom // 2))


def chi_square_limit(share: float, freedom: int) -> float:
    """The value that ``share`` of the distribution lies below."""
    low, high = 0.0, 20.0 * freedom + 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.float64(middle), freedom) < share else (low, middle)
    return high


@dataclass
class Tree:
    """Cuts of a kd-tree in heap order, and the boxes of its cells."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fit(points: np.ndarray, depth: int, width: int) -> Tree:
        axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        low, high = np.full((2 << depth, width), -np.inf), np.full((2 << depth, width), np.inf)
        held = {0: points}
        for node in range((1 << depth) - 1):
            own = held.pop(node)
            if len(own):
                axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut[node] = float(np.median(own[:, axis[node]]))
            right = own[:, axis[node]] >= cut[node] if len(own) else np.zeros(0, bool)
            for child, part in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
                held[child] = part
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, axis[node]] = np.minimum(high[node, axis[node]], cut[node])
            low[2 * node + 2, axis[node]] = np.maximum(low[node, axis[node]], cut[node])
        first = (1 << depth) - 1
        return Tree(axis, cut, low[first : 2 * first + 1], high[first : 2 * first + 1])

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(self.cut) and (node < len(self.cut)).any():
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - len(self.cut)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    total = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        away = np.maximum(np.maximum(low[None, :, k] - points[:, None, k], points[:, None, k] - high[None, :, k]), 0)
        total += away * away
    return total


@dataclass
class Space:
    """Projection of vectors, lifted to the sphere of the longest, and the tree over the projections."""

    directions: np.ndarray
    longest: float
    tree: Tree | None = None

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest - (vectors * vectors).sum(axis=1), 0))
        return np.concatenate([vectors, more[:, None]], axis=1) @ self.directions

    def squared_distance(self, score: np.ndarray, query_length: np.ndarray) -> np.ndarray:
        return np.maximum(query_length + self.longest - 2 * score, 0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the same order wherever a pair is met."""
    return (left * right).sum(axis=1)


def keep_best(query: np.ndarray, score: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id; sorted by query, best first."""
    order = np.lexsort((found, -score, query))
    query, score, found = query[order], score[order], found[order]
    first = np.maximum.accumulate(np.where(np.append(True, np.diff(query) != 0), np.arange(len(query)), 0)) if len(query) else query
    kept = np.arange(len(query)) - first < k
    return query[kept], score[kept], found[kept]


def search_block(space: Space, rows: pd.DataFrame, queries: pd.DataFrame, k: int, sure: float, seen: list | None = None) -> Iterator[pd.DataFrame]:
    """The k best rows of a block for each query, shell by shell, with the test and the query's bound.

    ``seen`` gets the number of verified pairs and of all pairs.
    """
    vectors, ids = stacked(rows["vector"]), rows["id"].to_numpy()
    points = space.lifted(vectors, query=False)
    depth = max(0, int(np.ceil(np.log2(max(1, len(points) / LEAF)))))
    tree = Tree.fit(points, depth, points.shape[1])
    leaf = tree.cells(points)
    order = np.argsort(leaf, kind="stable")
    vectors, points, ids, leaf = vectors[order], points[order], ids[order], leaf[order]
    starts = np.flatnonzero(np.append(True, np.diff(leaf) != 0))
    inside = np.cumsum(np.append(0, np.diff(leaf) != 0))  # place of each point's leaf
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    limit = chi_square_limit(sure, space.directions.shape[1])
    all_own = stacked(queries["vector"])
    all_projected = space.lifted(all_own, query=True)
    near = np.argsort(tree.cells(all_projected), kind="stable")  # queries of one leaf look at the same points
    for at in range(0, len(near), CHUNK):
        chunk = near[at : at + CHUNK]
        own, projected, names = all_own[chunk], all_projected[chunk], queries["id"].to_numpy()[chunk]
        worst, length = queries["bound"].to_numpy()[chunk].astype(np.float64), (own * own).sum(axis=1)

        def radius() -> np.ndarray:
            return np.where(np.isfinite(worst), limit * space.squared_distance(np.where(np.isfinite(worst), worst, 0), length), np.inf)

        open_ = (box_distances(projected, low, high) <= radius()[:, None]).any(axis=0)
        place = np.flatnonzero(open_[inside])
        if not len(place):
            continue
        taken = points[place]
        away = np.maximum((taken * taken).sum(axis=1) + (projected * projected).sum(axis=1)[:, None] - 2 * (projected @ taken.T), 0)
        away[names[:, None] == ids[place]] = np.inf
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        done = np.zeros(away.shape, bool)
        # Scores of a block product may differ in their last digits; what could count by them is summed in the one order.
        rough, slack = own @ vectors[place].T, 1e-10 * np.sqrt(length * space.longest) + 1e-300
        for share in (*((None,) if not np.isfinite(worst).all() else ()), *SHELLS):
            if share is None:
                first = min(4 * k, len(place) - 1)
                now = np.minimum(np.partition(away, first, axis=1)[:, first], radius())
            else:
                now = share * radius()
            wanted = (away <= now[:, None]) & ~done & (away < np.inf)
            done |= wanted
            if seen is not None:
                seen.append(int(wanted.sum()))
            i, j = np.nonzero(wanted & (rough >= (worst - slack)[:, None]))
            score = np.empty(len(i))
            for p in range(0, len(i), PAIRS):
                part = slice(p, p + PAIRS)
                score[part] = products(vectors[place[j[part]]], own[i[part]])
            good = score >= worst[i]
            best = keep_best(*(np.concatenate([b, n]) for b, n in zip(best, (i[good], score[good], ids[place[j[good]]]))), k)
            count = np.bincount(best[0], minlength=len(chunk))
            full = count >= k
            last = np.cumsum(count) - 1
            worst[full] = np.maximum(worst[full], best[1][last[full]])
        yield pd.DataFrame({"query_id": names[best[0]], "vec_id": best[2], "score": best[1]})


def searched(rows: DataFrame, queries: DataFrame, space: Space, k: int, sure: float) -> DataFrame:
    """Best rows of the cells that ``queries`` (id, vector, bound, cell) are routed to, block by block."""
    sizes = rows.groupBy("cell").count().withColumnRenamed("count", "n_rows").join(
        queries.groupBy("cell").count().withColumnRenamed("count", "n_queries"), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("n_queries") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    dealt_rows = rows.join(F.broadcast(sizes), "cell").select(
        "cell", F.pmod(F.xxhash64("id", F.lit("row")), F.col("row_blocks")).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "id", "vector")
    dealt_queries = queries.join(F.broadcast(sizes), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
        F.pmod(F.xxhash64("id", F.lit("query")), F.col("query_blocks")).cast("int").alias("query_block"), "id", "vector", "bound")

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.concat([none, *(search_block(space, left, right, k, sure) if len(left) and len(right) else ())])

    keys = ["cell", "row_block", "query_block"]
    return dealt_rows.groupBy(*keys).cogroup(dealt_queries.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def projected(rows: DataFrame, space: Space) -> DataFrame:
    """(id, vector, cell) of rows (id, vector)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cell = space.tree.cells(space.lifted(stacked(frame["vector"]), query=False))
                yield frame.assign(cell=cell.astype("int32"))

    return rows.mapInPandas(run, "id long, vector array<double>, cell int")


def routed(queries: DataFrame, space: Space, sure: float, own: bool) -> DataFrame:
    """Queries with the cells they have to search: their own, or else the others that the test with ``bound`` leaves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), 512):
                frame = whole.iloc[i : i + 512]
                vectors = stacked(frame["vector"])
                points = space.lifted(vectors, query=True)
                home = space.tree.cells(points)
                if own:
                    yield frame.assign(cell=home.astype("int32"))
                    continue
                away = box_distances(points, space.tree.low, space.tree.high)
                kth = frame["bound"].to_numpy()
                far = np.maximum(space.squared_distance(np.where(np.isfinite(kth), kth, 0), (vectors * vectors).sum(axis=1)), 1e-12)
                open_ = ~np.isfinite(kth)[:, None] | (chi_square(away / far[:, None], points.shape[1]) < sure)
                open_[np.arange(len(home)), home] = False
                which, cell = np.nonzero(open_)
                yield frame.iloc[which].assign(cell=cell.astype("int32"))

    return queries.mapInPandas(run, "id long, vector array<double>, bound double, cell int")


def fit_space(rows: DataFrame, width: int, directions: int = DIRECTIONS, cell: int = CELL, most_cells: int = MOST_CELLS, seed: int = 5) -> Space:
    """Directions, the longest squared length of all rows, and a tree whose cuts are medians of a bounded sample."""
    length = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    n, longest = rows.agg(F.count("*"), F.max(length)).first()
    rng = np.random.default_rng(seed)
    space = Space(rng.normal(size=(width + 1, directions)), float(longest or 0.0))
    order = F.xxhash64("id", F.lit("cuts"))
    share = min(1.0, SAMPLE / max(1, n))
    place = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    taken = rows.filter(place < share).select("vector").limit(2 * SAMPLE).toPandas()
    points = space.lifted(stacked(taken["vector"]), query=False) if len(taken) else np.zeros((0, directions))
    depth = int(np.ceil(np.log2(max(1, min(most_cells, n / cell)))))
    space.tree = Tree.fit(points, depth, directions)
    return space


def nearest(vectors: DataFrame, queries: Column, k: int, vector: str = "embedding", key: str = "vec_id", sure: float = SURE, **options) -> DataFrame:
    """``k`` rows of the largest inner product for each row for which ``queries`` holds, its own key left out.

    Ties go to the smaller key. Rows with a null key take no part.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = most[0] if most else 1
    rows = rows.filter(F.size("vector") == width)
    space = fit_space(rows.select("id", "vector"), width, **options)
    indexed = freeze(projected(rows.select("id", "vector"), space), "cells")
    asked = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("bound", F.lit(float("-inf")))
    first = freeze(best(searched(indexed, routed(asked, space, sure, own=True), space, k, sure), k).drop("rank"), "first")
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    again = asked.join(bounds, asked.id == bounds.query_id, "left").select(
        "id", "vector", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.col("bound")).alias("bound"))
    second = searched(indexed, routed(again, space, sure, own=False), space, k, sure)
    return best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")
