"""Run metrics: summaries, running accuracy and accuracy by sample count."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.operators.positions import running, with_group_position
from quorumql.operators.voting import SAMPLE

_FIRST_RANGE = Decimal(2**62)  # larger than any sample number

_COUNTED = {
    "num_executable_predictions": "executable",
    "num_exec_matches": "exec_match",
    "num_exact_matches": "exact_match",
}


def _partials(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums from which every summary metric follows, at the finest grouping asked for."""
    errors = F.coalesce(F.col("num_generation_errors"), F.lit(0))
    has_gold_error = F.coalesce(F.col("gold_exec_error"), F.lit("")) != ""
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"),
        *[F.count_if(F.col(flag)).alias(name) for name, flag in _COUNTED.items()],
        F.sum(errors).cast("bigint").alias("num_generation_errors"),
        F.count_if(errors > 0).alias("num_examples_with_generation_error"),
        F.count_if(has_gold_error).alias("num_gold_exec_errors"),
        F.sum("query_tool_calls").cast("bigint").alias("num_query_tool_calls"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("bigint").alias("total_prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("bigint").alias("total_completion_tokens"),
        F.sum("self_consistency_vote_fraction").alias("_fractions"),
        F.sum("self_consistency_vote_size").cast("bigint").alias("_sizes"),
        F.sum("self_consistency_distinct_execution_results").cast("bigint").alias("_distinct"),
        F.count_if(F.col("self_consistency_num_tied_winners") > 1).alias("num_self_consistency_tie_examples"),
    )


def _finish(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    total = F.col("num_examples")
    tokens = F.col("total_prompt_tokens") + F.col("total_completion_tokens")
    executable_rate = F.col("num_executable_predictions") / total
    return sums.select(
        *by,
        "num_examples",
        "num_dbs",
        "num_executable_predictions",
        executable_rate.alias("executable_rate"),
        "num_exec_matches",
        (F.col("num_exec_matches") / total).alias("execution_accuracy"),
        "num_exact_matches",
        (F.col("num_exact_matches") / total).alias("exact_match_accuracy"),
        "num_generation_errors",
        "num_examples_with_generation_error",
        "num_gold_exec_errors",
        "num_query_tool_calls",
        (F.col("num_query_tool_calls") / total).alias("avg_query_tool_calls_per_example"),
        "total_prompt_tokens",
        "total_completion_tokens",
        tokens.alias("total_tokens"),
        (F.col("total_prompt_tokens") / total).alias("avg_prompt_tokens_per_example"),
        (F.col("total_completion_tokens") / total).alias("avg_completion_tokens_per_example"),
        (tokens / total).alias("avg_total_tokens_per_example"),
        (F.lit(1.0) - executable_rate).alias("invalid_sql_rate"),
        (F.coalesce("_fractions", F.lit(0)) / total).alias("avg_self_consistency_vote_fraction"),
        (F.coalesce("_sizes", F.lit(0)) / total).alias("avg_self_consistency_vote_size"),
        (F.coalesce("_distinct", F.lit(0)) / total).alias("avg_self_consistency_distinct_execution_results"),
        "num_self_consistency_tie_examples",
    )


def _fold(partials: DataFrame) -> list[Column]:
    skip = {"num_dbs"}
    names = [c for c, t in partials.dtypes if (c.startswith(("num_", "total_", "_"))) and c not in skip]
    return [F.sum(n).alias(n) for n in names]


def run_summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All run metrics, one row per ``by`` group (one row in all without it; none for an empty input).

    ``total_tokens`` is the sum of prompt and completion tokens. Databases are counted through a first grouping
    by database, which also shrinks the data before the final one.
    """
    per_db = _partials(predictions, [*by, "db_id"])
    sums = per_db.groupBy(*by).agg(*_fold(per_db), F.count_distinct("db_id").alias("num_dbs"))
    return _finish(sums.where(F.col("num_examples") > 0), by)


def summary_by_group(predictions: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Run metrics for the run, each of its databases and each difficulty in one pass.

    ``grouping`` names the level; the columns a level does not group by are null.
    """
    cells = _partials(predictions, [*run, "db_id", "difficulty"]).withColumn("_db", F.col("db_id"))
    runs = [F.col(r) for r in run]
    sums = cells.groupingSets(
        [runs, [*runs, F.col("db_id")], [*runs, F.col("difficulty")]], *runs, F.col("db_id"), F.col("difficulty")
    ).agg(
        *[c for c in _fold(cells.drop("_db"))],
        F.count_distinct("_db").alias("num_dbs"),
        F.grouping("db_id").alias("_no_db"),
        F.grouping("difficulty").alias("_no_difficulty"),
    )
    level = (
        F.when(F.col("_no_db") == 0, F.lit("db")).when(F.col("_no_difficulty") == 0, F.lit("difficulty"))
        .otherwise(F.lit("run"))
    )
    return _finish(sums.withColumn("grouping", level), ["grouping", *run, "db_id", "difficulty"])


def running_accuracy(
    predictions: DataFrame,
    every: int = 10,
    run: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("index",),
) -> DataFrame:
    """Accuracy and executable rate so far, after every ``every``-th prediction of a run and after its last.

    Predictions are first folded into blocks of ``every``, so running sums are only taken over block totals.
    """
    if every <= 0:
        raise ValueError("every must be positive")
    flags = predictions.select(*run, *order, "exec_match", "executable")
    placed = with_group_position(flags, run, order, "_place")
    blocks = placed.groupBy(*run, F.floor(F.col("_place") / every).alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("exec_match").alias("_matches"),
        F.count_if("executable").alias("_ran"),
    )
    sums = running(
        blocks, run, ["_block"],
        {"completed": F.col("_n"), "exec_matches": F.col("_matches"), "executables": F.col("_ran")},
    )
    return sums.select(
        *run,
        "completed",
        (F.col("exec_matches") / F.col("completed")).alias("exec_acc"),
        (F.col("executables") / F.col("completed")).alias("executable_rate"),
    )


def k_accuracy_curve(
    keyed: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("index",), by: Sequence[str] = (), match: str = "exec_match"
) -> DataFrame:
    """Accuracy of the majority vote over the first k samples, for each k, in one job.

    ``keyed`` holds vote_key and ``match`` per sample (equal within a vote group). Each group counts its samples
    below every k side by side, so samples are not repeated per k. A question counts for every k.
    """
    counts = {k: f"_below_{k}" for k in ks}
    groups = keyed.groupBy(*by, *keys, "vote_key").agg(
        *[F.count_if(F.col(SAMPLE) < k).alias(name) for k, name in counts.items()],
        F.min(SAMPLE).alias("_first"),
        F.max(F.col(match).cast("int")).alias("_hit"),
    )
    # Most samples below k first, then the earliest group, as one number: decimals keep this a hash aggregation.
    def rank(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)") * F.lit(_FIRST_RANGE) - F.col("_first")

    winners = groups.groupBy(*by, *keys).agg(
        *[F.max_by("_hit", rank(name)).alias(f"_hit_{k}") for k, name in counts.items()]
    )
    rates = winners.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"), *[F.sum(f"_hit_{k}").alias(f"_hits_{k}") for k in ks]
    )
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_hits_{k}").alias("hits")) for k in ks])
    return rates.select(*by, "num_examples", F.explode(points).alias("point")).select(
        *by, "point.k", "num_examples", (F.col("point.hits") / F.col("num_examples")).alias("execution_accuracy")
    )
