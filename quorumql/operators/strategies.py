"""Where predicted SQL comes from: each strategy maps examples to a table of generations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from quorumql.operators.selection import replicate

NO_GENERATION = "no generation was stored for this sample"
_FIELDS = {
    "sql": "string", "raw_output": "string", "generation_error": "string", "latency_s": "double",
    "query_tool_calls": "int", "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint",
}


def gold_oracle(examples: DataFrame, samples: int = 1, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Predict the gold SQL itself: an offline check that everything behind it is wired right."""
    values = {"sql": F.col("gold_sql"), "raw_output": F.col("gold_sql"), "latency_s": F.lit(0.0), "query_tool_calls": F.lit(0)}
    rows = replicate(examples, samples).withColumnRenamed("rollout_index", "sample_index")
    return rows.select(
        *keys, "sample_index", *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()]
    )


def stored_generations(
    examples: DataFrame, generations: DataFrame, samples: int = 1, keys: Sequence[str] = ("index",)
) -> DataFrame:
    """Answers produced elsewhere, one row per example and sample.

    A missing answer becomes an error record with empty SQL, as does a failed one; token counts of 0 mean unknown.
    """
    if samples < 1:
        raise ValueError("samples must be >= 1")
    wanted = replicate(examples.select(*keys), samples).withColumnRenamed("rollout_index", "sample_index")
    known = generations.withColumn("_found", F.lit(True))
    joined = wanted.join(known, [*keys, "sample_index"], "left")
    failure = F.when(F.col("_found").isNull(), F.lit(NO_GENERATION)).otherwise(F.col("generation_error"))
    failed = F.coalesce(failure, F.lit("")) != ""
    values = {
        "sql": F.when(failed, F.lit("")).otherwise(F.coalesce("sql", F.lit(""))),
        "raw_output": F.coalesce("raw_output", F.lit("")),
        "generation_error": failure,
        "query_tool_calls": F.coalesce("query_tool_calls", F.lit(0)),
        **{n: F.nullif(F.col(n), F.lit(0)) for n in ("prompt_tokens", "completion_tokens", "total_tokens")},
    }
    return joined.select(
        *keys, "sample_index", *[values.get(n, F.col(n)).cast(t).alias(n) for n, t in _FIELDS.items()]
    )


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"gold_oracle": gold_oracle, "single_shot": stored_generations}


def strategy(name: str) -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; available: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]
