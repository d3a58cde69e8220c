"""Grouped training data and its rewards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quorumql.functions import sqltext
from quorumql.operators.prompts import build_prompts
from quorumql.operators.rewards import count_messages, last_assistant_text, outcome_reward
from quorumql.operators.selection import assign_batches, filter_by_db, replicate, train_eval_split


def training_rows(
    examples: DataFrame,
    contexts: DataFrame,
    db_id: str | None = None,
    train_offset: int = 0,
    train_limit: int = 256,
    eval_offset: int | None = None,
    eval_limit: int = 64,
    seed: int | None = 0,
    group_size: int = 8,
    groups_per_batch: int = 16,
    include_evidence: bool = False,
    with_tool: bool = True,
    tool_schema: str | None = None,
) -> DataFrame:
    """One row per rollout: shuffled, split, prompted, batched; train groups repeat, eval groups do not."""
    if group_size < 2:
        raise ValueError("group_size must be >= 2 for training")
    split = train_eval_split(
        filter_by_db(examples, db_id), train_offset, train_limit, eval_offset, eval_limit, seed
    )
    prompted = build_prompts(split, contexts, include_evidence, with_tool, tool_schema)
    train = replicate(prompted.where(F.col("split") == "train"), group_size)
    evaluation = replicate(prompted.where(F.col("split") == "eval"), 1)
    return assign_batches(train.unionByName(evaluation), groups_per_batch)


def reward_rollouts(
    messages: DataFrame,
    gold_sql: DataFrame,
    outcomes: DataFrame,
    keys: Sequence[str] = ("conv_id",),
    exec_match: float = 1.0,
    executable: float = 0.0,
    exact_sql: float = 0.0,
) -> DataFrame:
    """Reward of every conversation: final answer cleaned, compared as text, joined to its execution outcome.

    ``gold_sql`` holds the keys and gold_sql, ``outcomes`` the keys with executable and exec_match. A conversation
    without SQL counts as not executable.
    """
    on = list(keys)
    answers = last_assistant_text(messages, keys).withColumn("sql", sqltext.extract_sql(F.col("final_text")))
    calls = count_messages(messages, keys=keys).withColumnRenamed("num_messages", "query_tool_calls")
    joined = answers.join(gold_sql, on, "left").join(outcomes, on, "left").join(calls, on, "left")
    has_sql = F.col("sql") != ""
    flagged = (
        joined.withColumn("executable", has_sql & F.coalesce("executable", F.lit(False)))
        .withColumn("exec_match", has_sql & F.coalesce("exec_match", F.lit(False)))
        .withColumn("exact_match", sqltext.exact_match(F.col("sql"), F.col("gold_sql")))
    )
    return outcome_reward(flagged, exec_match, executable, exact_sql)
