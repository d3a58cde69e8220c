"""What a run records about itself, beside what it measured."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumql.operators.voting import KEYS, nest_samples


@dataclass(frozen=True)
class RunSettings:
    """Settings of one run; times are ISO 8601 text."""

    started_at: str
    finished_at: str
    strategy: str
    model: str | None
    run_dir: str
    ordered_result_compare: bool = False
    float_precision: int = 6
    max_workers: int = 8
    self_consistency_samples: int = 1


def with_run_fields(summary: DataFrame, settings: RunSettings) -> DataFrame:
    """``summary`` with the run's settings and the places of its files, as ``sweep_metrics`` reads them."""
    return summary.withColumns({
        **{name: F.lit(value) for name, value in asdict(settings).items()},
        "self_consistency_enabled": F.lit(settings.self_consistency_samples > 1),
        "predictions_path": F.lit(f"{settings.run_dir}/predictions.jsonl"),
        "summary_path": F.lit(f"{settings.run_dir}/summary.json"),
    })


def run_config(spark: SparkSession, settings: RunSettings) -> DataFrame:
    """The settings as a table of one row, to be stored by ``write_summary``."""
    return with_run_fields(spark.range(1).select(), settings)


def full_records(predictions: DataFrame, details: DataFrame, settings: RunSettings, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Prediction records with strategy, model, the run's number of samples and the list of all samples.

    ``details`` comes from ``sample_details``; its columns make up the list's entries, in order of the samples.
    """
    nested = nest_samples(details, settings.self_consistency_samples, keys)
    return predictions.join(nested, list(keys), "left").withColumns({
        "strategy": F.lit(settings.strategy), "model": F.lit(settings.model),
        "self_consistency_samples": F.lit(settings.self_consistency_samples),
    })
