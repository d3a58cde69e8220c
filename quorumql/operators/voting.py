"""Self-consistency: samples of one question vote by what their query returned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quorumql.functions.sqltext import exact_match
from quorumql.operators.compare import EMPTY_SQL_ERROR, fingerprints

KEYS = ("index",)
SAMPLE = "sample_index"


def vote_keys(
    executions: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS, ordered: bool = False
) -> DataFrame:
    """``vote_key`` of every sample: its error text, or the fingerprint of its rows. Equal errors vote together."""
    prints = fingerprints(results, [*keys, SAMPLE], ordered)
    joined = executions.join(prints, [*keys, SAMPLE], "left")
    rows = F.concat_ws(
        ":", F.lit("rows:"), F.coalesce("n_rows", F.lit(0)), F.coalesce("hash_a", F.lit(0)), F.coalesce("hash_b", F.lit(0))
    )
    key = F.when(F.col("error").isNotNull(), F.concat(F.lit("error::"), "error")).otherwise(rows)
    return joined.select(*executions.columns, key.alias("vote_key"))


def audit_vote_keys(
    keyed: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS, ordered: bool = False
) -> DataFrame:
    """Rows on which samples of one vote group disagree; empty means the grouping is exact.

    Within a group every distinct row must occur in all samples, equally often. Counted per (group, row), so no
    result is collected and no two samples are paired.
    """
    ran = keyed.where(F.col("error").isNull()).select(*keys, SAMPLE, "vote_key")
    sizes = ran.groupBy(*keys, "vote_key").agg(F.count(F.lit(1)).alias("group_size"))
    row = [*(["row_pos"] if ordered else []), "cells"]
    times = results.groupBy(*keys, SAMPLE, *row).agg(F.count(F.lit(1)).alias("times"))
    spread = (
        times.join(ran, [*keys, SAMPLE])
        .groupBy(*keys, "vote_key", *row)
        .agg(F.count(F.lit(1)).alias("in_samples"), F.min("times").alias("fewest"), F.max("times").alias("most"))
    )
    return spread.join(sizes, [*keys, "vote_key"]).where(
        (F.col("in_samples") != F.col("group_size")) | (F.col("fewest") != F.col("most"))
    )


def vote_groups(keyed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Size and first sample of every distinct result of a question."""
    return keyed.groupBy(*keys, "vote_key").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(SAMPLE).alias("first_sample")
    )


def majority_vote(keyed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Winner and vote statistics per question.

    The largest group wins, ties go to the group seen first, and its first sample is selected. Groups are folded
    by size before they are folded by question, so all steps are hash aggregations with partial results: a
    question with very many samples never meets in one task.
    """
    by_size = vote_groups(keyed, keys).groupBy(*keys, "group_size").agg(
        F.count(F.lit(1)).alias("groups"), F.min("first_sample").alias("first_sample")
    )
    totals = by_size.groupBy(*keys).agg(
        F.max_by("first_sample", "group_size").alias("selected_sample"),
        F.max("group_size").alias("vote_size"),
        F.max_by("groups", "group_size").alias("tied_winners"),
        F.sum("groups").alias("distinct_results"),
        F.sum(F.col("groups") * F.col("group_size")).alias("samples"),
    )
    return totals.withColumn("vote_fraction", F.col("vote_size") / F.col("samples"))


def sample_details(keyed: DataFrame, votes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every sample with its group's size and whether that group won (true for all of its samples)."""
    groups = vote_groups(keyed, keys).join(votes.select(*keys, "selected_sample"), list(keys)).select(
        *keys, "vote_key", "group_size", (F.col("first_sample") == F.col("selected_sample")).alias("selected_by_vote")
    )
    joined = keyed.join(groups, [*keys, "vote_key"])
    columns = [*keyed.columns, "group_size", "selected_by_vote"]
    if {"sql", "gold_sql"} <= set(keyed.columns):
        joined = joined.withColumn("exact_match", exact_match(F.col("sql"), F.col("gold_sql")))
        columns.append("exact_match")
    return joined.select(*columns)


def question_rollup(generations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cost of a question over all of its samples; missing token counts are 0, a missing total is their sum."""

    def filled(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    return generations.groupBy(*keys).agg(
        F.sum("query_tool_calls").cast("bigint").alias("query_tool_calls"),
        F.sum(filled("prompt_tokens")).cast("bigint").alias("prompt_tokens"),
        F.sum(filled("completion_tokens")).cast("bigint").alias("completion_tokens"),
        F.sum(F.coalesce(F.col("total_tokens"), filled("prompt_tokens") + filled("completion_tokens")))
        .cast("bigint").alias("total_tokens"),
        F.sum(F.coalesce("latency_s", F.lit(0.0))).alias("total_latency_s"),
        F.count_if(F.coalesce(F.col("generation_error"), F.lit("")) != "").alias("num_generation_errors"),
    )


def prediction_records(
    examples: DataFrame,
    samples: DataFrame,
    gold: DataFrame,
    votes: DataFrame,
    rollup: DataFrame,
    matches: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One record per question: the example, its selected sample, gold outcome, vote statistics and total cost.

    ``samples`` holds generation and execution columns of every sample (with ``messages``, if there, those of the selected
    one are kept), ``gold`` the gold execution (error,
    elapsed_s, row_count), ``matches`` ``exec_match`` of the selected sample.
    """
    on = list(keys)
    picked = votes.withColumnRenamed("selected_sample", SAMPLE)
    chosen = samples.join(picked, [*on, SAMPLE]).select(
        *on,
        F.col("sql").alias("predicted_sql"), "raw_output", "generation_error", *(["messages"] if "messages" in samples.columns else []),
        F.col("latency_s").alias("generation_latency_s"),
        F.col("error").alias("prediction_exec_error"), F.col("elapsed_s").alias("prediction_exec_time_s"),
        F.when(F.col("error").isNull(), F.col("row_count")).alias("prediction_row_count"),
        F.col("error").isNull().alias("executable"),
        F.col("samples").alias("self_consistency_samples"),
        F.col(SAMPLE).alias("self_consistency_selected_sample_index"),
        F.col("vote_size").alias("self_consistency_vote_size"),
        F.col("vote_fraction").alias("self_consistency_vote_fraction"),
        F.col("tied_winners").alias("self_consistency_num_tied_winners"),
        F.col("distinct_results").alias("self_consistency_distinct_execution_results"),
    )
    golds = gold.select(
        *on, F.col("error").alias("gold_exec_error"), F.col("elapsed_s").alias("gold_exec_time_s"),
        F.when(F.col("error").isNull(), F.col("row_count")).alias("gold_row_count"),
    )
    costs = rollup.withColumnRenamed("total_latency_s", "self_consistency_total_generation_latency_s")
    # A question without samples stays: it has no SQL, so it is not executable and matches nothing.
    unanswered = F.col("self_consistency_selected_sample_index").isNull()
    return (
        examples.join(chosen, on, "left")
        .join(golds, on, "left")
        .join(costs, on, "left")
        .join(matches, on, "left")
        .withColumn("prediction_exec_error", F.when(unanswered, F.lit(EMPTY_SQL_ERROR)).otherwise(F.col("prediction_exec_error")))
        .withColumn("executable", F.coalesce("executable", F.lit(False)))
        .withColumn("exec_match", F.coalesce("exec_match", F.lit(False)))
        .withColumn("exact_match", F.coalesce(exact_match(F.col("predicted_sql"), F.col("gold_sql")), F.lit(False)))
        .fillna(0, ["self_consistency_samples", *[c for c in costs.columns if c not in on]])
    )


def nest_samples(details: DataFrame, most: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sample details as one array per question, for record files that want them nested.

    ``most`` is the run's sample count, which bounds the arrays. A question with more samples is an error, not left out.
    """
    fields = [SAMPLE, *[c for c in details.columns if c not in (*keys, SAMPLE)]]
    counts = details.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a question has {largest} samples, more than the {most} of the run")
    return details.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("self_consistency_sampled_predictions")
    )
