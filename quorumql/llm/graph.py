"""Connected components of a graph of any size by alternating star steps; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumql.session import freeze


def stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b.

    With ``larger`` every node's larger neighbours are linked to its smallest neighbour (or itself); otherwise the node
    and its smaller neighbours are.
    """
    if larger:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if larger:
        made = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return made.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not the smallest of its component; root is the smallest.

    Ends when a round changes nothing: each node is then linked to its component's smallest alone.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, seen = freeze(ordered, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, seen = freeze(stars(stars(now, True), False), "links"), mark
