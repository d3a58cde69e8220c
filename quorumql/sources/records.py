"""Prediction, summary and sweep files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quorumql.operators.sweeps import METRIC_COLUMNS
from quorumql.session import freeze

_KEEP_NULLS = {"ignoreNullFields": "false"}
#: Rows of one array file.
ARRAY_ROWS = 10_000
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def write_predictions(predictions: DataFrame, path: str, run: str = "run_id", order: str = "index") -> None:
    """JSON lines per run, in index order across the files of a run.

    Rows are range-partitioned by run and index, so a large run is written by many tasks. Null fields are kept.
    """
    (
        predictions.repartitionByRange(run, order)
        .sortWithinPartitions(run, order)
        .write.mode("error")
        .partitionBy(run)
        .options(**_KEEP_NULLS)
        .json(path)
    )


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Predictions written before; the schema is given, so no pass over the files is spent on inferring it."""
    return spark.read.schema(schema).json(path)


def write_summary(summary: DataFrame, path: str, run: str | None = "run_id") -> None:
    """Run summaries or run settings as JSON, one record per run."""
    writer = summary.write.mode("error").options(**_KEEP_NULLS)
    (writer.partitionBy(run) if run else writer).json(path)


def write_sweep(df: DataFrame, path: str, fmt: str = "csv", columns: Sequence[str] = METRIC_COLUMNS) -> None:
    """Sweep metrics as CSV in a fixed column order (missing values empty), as a JSON array, or as JSON lines.

    Up to ``ARRAY_ROWS`` rows make one array in one file; more rows make several files of one array each, all of them
    bounded, which ``read_sweep`` reads together.
    """
    if fmt == "csv":
        have = set(df.columns)
        picked = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
        df.select(*picked).write.mode("error").option("header", True).csv(path)
    elif fmt == "jsonl":
        df.write.mode("error").options(**_KEEP_NULLS).json(path)
    elif fmt == "json":
        stored = freeze(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("id")), "sweep")
        low = F.col("id").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
        block = F.concat_ws("-", F.shiftright("id", _PARTITION_BITS), F.floor(low / ARRAY_ROWS)) if stored.count() > ARRAY_ROWS else F.lit("0")
        arrays = stored.groupBy(block.alias("block")).agg(F.collect_list("row").alias("rows"))
        if stored.isEmpty():
            arrays = df.sparkSession.createDataFrame([("0", "[]")], "block string, value string")
        else:
            arrays = arrays.select("block", F.to_json("rows", _KEEP_NULLS).alias("value"))
        arrays.repartition("block").write.mode("error").partitionBy("block").text(path)
    else:
        raise ValueError(f"unknown sweep format {fmt!r}")


def read_sweep(
    spark: SparkSession, csv_path: str | None = None, json_path: str | None = None, columns: Sequence[str] = METRIC_COLUMNS,
    jsonl_path: str | None = None,
) -> DataFrame:
    """Raw sweep metrics as text columns, CSV preferred; ``coerce_metrics`` makes numbers of them.

    CSV columns are taken by the names in the header, whatever their order; a column that is not there is null.
    """
    if csv_path is not None:
        found = spark.read.option("header", True).option("inferSchema", False).csv(csv_path)
        have = set(found.columns)
        return found.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    schema = ", ".join(f"{c} string" for c in columns)
    if jsonl_path is not None:
        return spark.read.schema(schema).json(jsonl_path)
    if json_path is not None:
        return spark.read.schema(schema).option("multiLine", True).json(json_path).select(*columns)
    raise ValueError("no metrics file given; expected csv_path, json_path or jsonl_path")


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON-lines log. Order comes from a step or time field in the records, never from the file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
