"""From generations and executions to prediction records and a run summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumql.operators.answers import clean_answers
from quorumql.operators.compare import execution_match, multiset_match, with_empty_sql_error
from quorumql.operators.metrics import run_summary
from quorumql.operators.statements import DEADLINE_SECONDS, run_statements
from quorumql.operators.voting import majority_vote, prediction_records, question_rollup, vote_keys
from quorumql.session import freeze


@dataclass(frozen=True)
class Evaluation:
    """``samples`` has one row per sample with its vote key, ``predictions`` one per question."""

    samples: DataFrame
    votes: DataFrame
    predictions: DataFrame

    def summary(self, by: Sequence[str] = ()) -> DataFrame:
        return run_summary(self.predictions, by)


def evaluate(
    examples: DataFrame,
    samples: DataFrame,
    results: DataFrame,
    gold: DataFrame,
    gold_results: DataFrame,
    ordered: bool = False,
    keys: Sequence[str] = ("index",),
) -> Evaluation:
    """Vote, compare and record.

    ``samples`` are generations with the outcome of running them (sql, generation_error, error, elapsed_s,
    row_count, ...), ``results`` their rows; ``gold`` and ``gold_results`` hold one execution per question, made
    once whatever the number of samples. Every question gets a record, answered or not; no questions are an error.
    """
    if examples.isEmpty():
        raise ValueError("no questions are selected")
    on = list(keys)
    keyed = vote_keys(samples, results, keys, ordered)
    # One small row per question, read by every branch below; written once so result rows are not hashed again.
    votes = freeze(majority_vote(keyed, keys), "votes")
    picked = votes.select(*on, F.col("selected_sample").alias("sample_index"))
    chosen = samples.join(picked, [*on, "sample_index"], "left_semi")
    chosen_rows = results.join(picked, [*on, "sample_index"], "left_semi")
    matches = execution_match(chosen, gold, multiset_match(chosen_rows, gold_results, keys, ordered), keys)
    predictions = prediction_records(examples, samples, gold, votes, question_rollup(samples, keys), matches, keys)
    return Evaluation(keyed, votes, predictions)


def run_generations(
    generations: DataFrame, keys: Sequence[str] = ("index",), timeout_s: float = DEADLINE_SECONDS, workers: int = 8,
    database: str | None = None, sessions: Callable[[str], SparkSession] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Execute generated SQL: (samples with outcome, result rows). Empty SQL becomes an error record."""
    on = [*keys, "sample_index"]
    where = [] if database is None else [database]
    executions, results = run_statements(
        generations.select(*on, *where, "sql"), timeout_s=timeout_s, workers=workers, database=database, sessions=sessions)
    outcome = executions.drop("sql", "columns", *where)
    return with_empty_sql_error(generations.join(outcome, on, "left")), results.drop(*where)


def evaluate_answers(
    examples: DataFrame,
    answers: DataFrame,
    ordered: bool = False,
    timeout_s: float = DEADLINE_SECONDS,
    workers: int = 8,
    keys: Sequence[str] = ("index",),
    sessions: Callable[[str], SparkSession] | None = None,
) -> Evaluation:
    """The whole way from raw answers: clean them, run them and the gold queries, evaluate.

    ``answers`` are generations with raw_output; their ``sql`` is derived here. With ``sessions`` every question's
    SQL runs in the session of its ``db_id``; without it all run on the session's tables.
    """
    database = None if sessions is None else "db_id"
    where = [] if database is None else [database]
    cleaned = clean_answers(answers.drop("sql", *where)).drop("n_statements", "is_read_only", "answer_class")
    failed = F.coalesce(F.col("generation_error"), F.lit("")) != ""
    generations = cleaned.withColumn("sql", F.when(failed, F.lit("")).otherwise(F.col("sql")))
    if where:
        generations = generations.join(examples.select(*keys, *where), list(keys))
    samples, results = run_generations(generations, keys, timeout_s, workers, database, sessions)
    gold, gold_results = run_statements(
        examples.select(*keys, *where, F.col("gold_sql").alias("sql")), timeout_s=timeout_s, workers=workers,
        database=database, sessions=sessions)
    return evaluate(examples, samples.drop(*where), results, gold.drop(*where), gold_results.drop(*where), ordered, keys)
