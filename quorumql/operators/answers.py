"""Turning raw model answers into statements, over a whole table of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.functions import sqltext


def clean_answers(answers: DataFrame, text_col: str = "raw_output") -> DataFrame:
    """Add ``sql``, ``n_statements``, ``is_read_only`` and ``answer_class`` to each answer.

    The class is ``empty``, ``mutating`` (not a read-only statement), ``multi_statement`` or ``read_only``.
    Steps are separate columns, so each regex runs once per row.
    """
    body = answers.withColumn(
        "_body", sqltext.extract_fence(sqltext.strip_think(F.coalesce(F.col(text_col), F.lit(""))))
    )
    split = body.withColumn("_statements", sqltext.split_statements(F.col("_body")))
    cleaned = split.withColumn("sql", sqltext.first_statement(F.col("_statements"), F.col("_body")))
    return (
        cleaned.withColumn("n_statements", F.size("_statements"))
        .withColumn("is_read_only", sqltext.is_read_only(F.col("sql")))
        .withColumn("answer_class", _answer_class())
        .drop("_body", "_statements")
    )


def _answer_class() -> Column:
    return (
        F.when(F.col("sql") == "", F.lit("empty"))
        .when(~F.col("is_read_only"), F.lit("mutating"))
        .when(F.col("n_statements") > 1, F.lit("multi_statement"))
        .otherwise(F.lit("read_only"))
    )


def answer_report(answers: DataFrame, text_col: str = "raw_output", by: Sequence[str] = ()) -> DataFrame:
    """Number of answers per class."""
    return clean_answers(answers, text_col).groupBy(*by, "answer_class").agg(
        F.count(F.lit(1)).alias("num_answers"), F.sum("n_statements").cast("bigint").alias("num_statements")
    )
