"""Comparing runs: metric rows, ranking, Pareto frontier, training-arm tables and metric logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.functions.coerce import iso_seconds, to_float, to_int
from quorumql.functions.render import fixed_or_na
from quorumql.operators.positions import running, with_position

# Column order of metric files and the names a training log may use for one metric.
METRIC_COLUMNS = (
    "k", "execution_accuracy", "exact_match_accuracy", "executable_rate", "avg_total_tokens_per_example",
    "avg_query_tool_calls_per_example", "self_consistency_vote_fraction", "num_examples", "duration_s", "run_dir",
    "local_summary_path",
)
METRIC_ALIASES = {
    "train/loss": ("train/loss", "optim/loss", "loss", "optim/fwd_loss", "optim/fwd_train_loss"),
    "train/reward_total": ("env/all/reward/total",),
    "train/exec_match": ("env/all/exec_match",),
    "eval/reward_total": ("test/env/all/reward/total",),
    "eval/exec_match": ("test/env/all/exec_match",),
}


def coerce_metrics(
    df: DataFrame, int_cols: Sequence[str] = ("k",), float_cols: Sequence[str] = (), required: Sequence[str] = ("k",)
) -> DataFrame:
    """Numbers out of text columns, bad ones null; rows without a required number are dropped."""
    typed = df.withColumns({
        **{c: to_int(F.col(c)) for c in int_cols}, **{c: to_float(F.col(c)) for c in float_cols}
    })
    for c in required:
        typed = typed.where(F.col(c).isNotNull())
    return typed


def run_duration(started: Column, finished: Column) -> Column:
    return iso_seconds(started, finished)


def sweep_metrics(arms: DataFrame, downloaded: DataFrame, returned: DataFrame) -> DataFrame:
    """One row per arm: its error, and metrics taken from the downloaded summary or else the returned one.

    ``arms`` holds arm_id, k, error and local_run_dir; summaries are keyed by arm_id. Failed arms stay in the
    table without metrics.
    """
    names = [
        "execution_accuracy", "exact_match_accuracy", "executable_rate", "avg_total_tokens_per_example",
        "avg_query_tool_calls_per_example", "avg_self_consistency_vote_fraction", "num_examples", "started_at",
        "finished_at", "run_dir",
    ]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("arm_id", F.struct(*[F.col(n) for n in names]).alias(name))

    joined = arms.join(packed(downloaded, "_near"), "arm_id", "left").join(packed(returned, "_far"), "arm_id", "left")
    # Without a local run directory the arm has no summary to report.
    summary = F.when(F.col("local_run_dir").isNotNull(), F.coalesce("_near", "_far"))
    picked = joined.withColumn("_summary", summary)
    return picked.select(
        "arm_id", "k", "error",
        *[F.col(f"_summary.{n}").alias(n) for n in names[:5]],
        F.col("_summary.avg_self_consistency_vote_fraction").alias("self_consistency_vote_fraction"),
        F.col("_summary.num_examples").alias("num_examples"),
        run_duration(F.col("_summary.started_at"), F.col("_summary.finished_at")).alias("duration_s"),
        F.col("_summary.run_dir").alias("run_dir"),
        F.when(F.col("_summary").isNotNull(), F.concat("local_run_dir", F.lit("/summary.json"))).alias("local_summary_path"),
    )


def rank_arms(
    df: DataFrame, score: str = "execution_accuracy", order: Sequence[str] = ("k",), name: str = "rank"
) -> DataFrame:
    """Add the 1-based rank by score (best first, missing last), ties by ``order``, and the score as text."""
    placed = with_position(df, [F.col(score).desc_nulls_last(), *order], "_place")
    return placed.select(
        *df.columns, (F.col("_place") + 1).alias(name), fixed_or_na(F.col(score)).alias(f"{score}_text")
    )


def pareto_frontier(df: DataFrame, minimise: str, maximise: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows no other row beats: none has smaller-or-equal x and larger-or-equal y with one of them strict.

    Equal rows stay together, rows with a missing x or y drop out, and a group of fewer than two rows has no
    frontier. The best y per x is found first, then compared with the best y at any smaller x.
    """
    points = df.where(F.col(minimise).isNotNull() & F.col(maximise).isNotNull())
    best = points.groupBy(*by, minimise).agg(F.max(maximise).alias("_best"), F.count(F.lit(1)).alias("_n"))
    swept = running(best, by, [minimise], {"_before": F.col("_best")}, inclusive=False, combine="max")
    front = swept.where(F.col("_before").isNull() | (F.col("_best") > F.col("_before"))).select(
        *by, minimise, F.col("_best").alias(maximise)
    )
    kept = points.join(front, [*by, minimise, maximise], "left_semi")
    if by:
        enough = best.groupBy(*by).agg(F.sum("_n").alias("_n")).where(F.col("_n") > 1)
        return kept.join(enough, list(by), "left_semi")
    total = best.agg(F.sum("_n").alias("n")).select("n").scalar()
    return kept.where(total > 1)


def k_series(df: DataFrame, k: str = "k", score: str = "execution_accuracy") -> DataFrame:
    """Points of the accuracy-by-k curve: those with an accuracy."""
    return df.where(F.col(score).isNotNull()).select(k, score)


def last_record(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The record with the largest ``order`` per key."""
    fields = F.struct(*[F.col(c) for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(fields, order).alias("_last")).select(*key, "_last.*")


def require_objects(df: DataFrame, column: str) -> DataFrame:
    """Fail when a JSON text column holds anything but objects."""
    is_object = F.ltrim(column).startswith("{") & F.try_parse_json(column).isNotNull()
    message = F.concat(F.lit("expected a JSON object, got: "), F.substring(F.col(column), 1, 80))
    return df.withColumn(column, F.when(is_object, F.col(column)).otherwise(F.raise_error(message)))


def latest(df: DataFrame, id_col: str) -> DataFrame:
    """Rows of the newest id (ids are timestamps, so newest is largest)."""
    return df.where(F.col(id_col) == df.agg(F.max(id_col).alias("newest")).scalar())


def metric_alias(
    df: DataFrame, metrics: str = "metrics", aliases: Mapping[str, Sequence[str]] = METRIC_ALIASES
) -> DataFrame:
    """For each name the first of its aliases that is a number in the JSON object; text numbers do not count."""
    names = sorted({a for options in aliases.values() for a in options})
    parsed = df.withColumn("_object", F.try_parse_json(metrics))

    def number(alias: str) -> Column:
        path = f"$['{alias}']"
        kind = F.schema_of_variant(F.try_variant_get("_object", path, "variant"))
        is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
        return F.when(is_number, F.try_variant_get("_object", path, "double"))

    numbers = {a: f"_number_{i}" for i, a in enumerate(names)}
    found = parsed.withColumns({column: number(a) for a, column in numbers.items()})
    wanted = {name: F.coalesce(*[F.col(numbers[a]) for a in options]) for name, options in aliases.items()}
    return found.withColumns(wanted).drop("_object", *numbers.values())


def arm_results(
    grid: DataFrame, metrics: DataFrame, key: Sequence[str], swept: Sequence[str],
    shown: Sequence[str] = ("train/exec_match", "eval/exec_match", "train/loss"),
) -> DataFrame:
    """Swept values of each arm with its last metrics as text, ``n/a`` where there is none."""
    joined = grid.join(metrics.select(*key, *[f"`{m}`" for m in shown]), list(key), "left")
    return joined.select(*key, *[c for c in swept if c not in key], *[fixed_or_na(F.col(f"`{m}`")).alias(m) for m in shown])
