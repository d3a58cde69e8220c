"""Comparing result sets as multisets or position by position.

Result tables hold one row per result row: the key columns of the query, ``row_pos`` and ``cells`` (canonical text).
Execution tables hold one row per executed query: the key columns, ``error`` (null if it ran) and ``row_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.functions.cells import row_hashes

EMPTY_SQL_ERROR = "Empty SQL output"


def multiset_match(
    predicted: DataFrame, gold: DataFrame, keys: Sequence[str] = ("index",), ordered: bool = False
) -> DataFrame:
    """``rows_match`` per key: both sides hold the same rows equally often (at the same positions if ``ordered``).

    Predicted rows weigh +1 and gold rows -1; they match when every distinct row sums to zero. Grouping includes
    the row itself, so a result of any size spreads over all tasks and repeated rows collapse before the shuffle.
    Keys without rows on either side do not appear; ``execution_match`` reads that as equal.
    """
    parts = [*keys, *(["row_pos"] if ordered else []), "cells"]
    signed = predicted.select(*parts, F.lit(1).alias("weight")).unionAll(
        gold.select(*parts, F.lit(-1).alias("weight"))
    )
    differences = signed.groupBy(*parts).agg(F.sum("weight").alias("difference"))
    return differences.groupBy(*keys).agg((F.max(F.abs("difference")) == 0).alias("rows_match"))


def fingerprints(results: DataFrame, keys: Sequence[str], ordered: bool = False) -> DataFrame:
    """Row count and two hash sums per result.

    Sums do not depend on row order and combine map-side, so only one small row per result and task is shuffled,
    never the rows. Two results with equal fingerprints differ with a chance of about 2**-128; ``audit_vote_keys``
    proves a grouping exact where that is wanted.
    """
    cells = F.col("cells")
    if ordered:
        cells = F.concat(F.array(F.col("row_pos").cast("string")), cells)
    first, second = row_hashes(cells)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(first.cast("decimal(20,0)")).alias("hash_a"),
        F.sum(second.cast("decimal(20,0)")).alias("hash_b"),
    )


def fingerprint_match(
    predicted: DataFrame, predicted_rows: DataFrame, gold: DataFrame, gold_rows: DataFrame,
    keys: Sequence[str] = ("index",), samples: Sequence[str] = ("sample_index",), ordered: bool = False,
) -> DataFrame:
    """``exec_match`` of every sample against the one gold result of its key, without copying gold rows per sample.

    ``predicted`` and ``gold`` are execution tables, so every sample has a row: false if it or the gold query failed
    or the key has no gold query, and else whether both return the same rows; two results without rows are equal.
    """
    empty = F.struct(F.lit(0).cast("bigint").alias("n_rows"), *[
        F.lit(0).cast("decimal(30,0)").alias(name) for name in ("hash_a", "hash_b")])

    def printed(runs: DataFrame, rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        prints = fingerprints(rows, by, ordered).select(*by, F.struct("n_rows", "hash_a", "hash_b").alias("_print"))
        joined = runs.select(*by, F.col("error").isNull().alias("_ran")).join(prints, list(by), "left")
        return joined.select(*by, F.when(F.col("_ran"), F.coalesce("_print", empty)).alias(name))

    ours = printed(predicted, predicted_rows, [*keys, *samples], "_ours")
    theirs = printed(gold, gold_rows, keys, "_gold")
    return ours.join(theirs, list(keys), "left").select(
        *keys, *samples, F.coalesce(F.col("_ours") == F.col("_gold"), F.lit(False)).alias("exec_match"))


def execution_match(
    predicted: DataFrame, gold: DataFrame, matches: DataFrame, keys: Sequence[str] = ("index",)
) -> DataFrame:
    """``exec_match`` per key: both sides ran without error and their rows match.

    ``predicted`` and ``gold`` are execution tables, ``matches`` comes from ``multiset_match`` over the rows of both.
    A key with rows on neither side counts as equal.
    """
    golds = gold.select(*keys, F.col("error").alias("gold_error"), F.lit(True).alias("gold_known"))
    joined = predicted.join(golds, list(keys), "left").join(matches, list(keys), "left")
    both_ran = F.col("error").isNull() & F.col("gold_error").isNull() & F.col("gold_known").isNotNull()
    return joined.select(*keys, (both_ran & F.coalesce("rows_match", F.lit(True))).alias("exec_match"))


def with_empty_sql_error(executions: DataFrame, sql: str = "sql", generation_error: str = "generation_error") -> DataFrame:
    """Queries without text never ran: their error is the generation error, or a fixed message."""
    is_empty = F.coalesce(F.col(sql), F.lit("")) == ""
    reason = F.coalesce(F.nullif(F.col(generation_error), F.lit("")), F.lit(EMPTY_SQL_ERROR))
    return executions.withColumn("error", F.when(is_empty, reason).otherwise(F.col("error")))


def executable(error: Column) -> Column:
    return error.isNull()


def prediction_status(executions: DataFrame) -> DataFrame:
    """Add ``executable`` and hide the row count of queries that failed."""
    ran = executable(F.col("error"))
    return executions.withColumn("executable", ran).withColumn("row_count", F.when(ran, F.col("row_count")))
