"""Running metrics of a run whose predictions are still arriving."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quorumql.session import new_folder

COUNTS = "completed bigint, exec_matches bigint, executables bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def progress_totals(predictions: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Running totals per run; works on a batch and on a stream. State is three numbers per run."""
    return predictions.groupBy(*run).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if("exec_match").alias("exec_matches"),
        F.count_if("executable").alias("executables"),
    )


def with_rates(totals: DataFrame) -> DataFrame:
    done = F.col("completed")
    return totals.withColumn("exec_acc", F.col("exec_matches") / done).withColumn(
        "executable_rate", F.col("executables") / done
    )


def stream_progress(
    predictions: DataFrame, out_dir: str, run: Sequence[str] = ("run_id",), checkpoint: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Start a query that writes the changed runs' metrics after every batch, to ``out_dir``/batch_id=N.

    Only runs touched by a batch are written (update mode). A batch repeated after a failure overwrites its own
    folder, so nothing is counted twice; the newest record per run holds its current state.
    """
    spark = predictions.sparkSession
    totals = progress_totals(predictions, run)

    def write(batch: DataFrame, batch_id: int) -> None:
        with_rates(batch).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint or new_folder(spark, "progress"))
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_progress(spark, out_dir: str, run_schema: str = "run_id bigint", run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Current state of every run: its record from the newest batch that touched it."""
    schema = f"{run_schema}, {COUNTS}, exec_acc double, executable_rate double, batch_id bigint"
    history = spark.read.schema(schema).parquet(out_dir)
    values = [c for c in history.columns if c not in (*run, "batch_id")]
    newest = history.groupBy(*run).agg(F.max_by(F.struct(*values), "batch_id").alias("_now"))
    return newest.select(*run, "_now.*")


def keyed_state_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` that keeps state by key in RocksDB, which ``stream_running_accuracy`` needs."""
    own = spark.newSession()
    own.conf.set(_PROVIDER, _KEYED_STATE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


class _EveryNth(StatefulProcessor):
    """Three numbers of state for each run; a row after every N-th prediction and after the last expected one."""

    def __init__(self, every: int, run: Sequence[str], order: Sequence[str]) -> None:
        self.every, self.run, self.order = every, list(run), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", COUNTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        before = self.so_far.get() or (0, 0, 0)
        sums = {
            "completed": before[0] + np.arange(1, len(arrived) + 1, dtype=np.int64),
            "exec_matches": before[1] + np.cumsum(arrived["exec_match"].eq(True).to_numpy(), dtype=np.int64),
            "executables": before[2] + np.cumsum(arrived["executable"].eq(True).to_numpy(), dtype=np.int64),
        }
        self.so_far.update(tuple(int(v[-1]) for v in sums.values()))
        told = (sums["completed"] % self.every == 0) | (sums["completed"] == arrived["expected"].fillna(-1).to_numpy())
        yield pd.DataFrame({**{name: [value] * int(told.sum()) for name, value in zip(self.run, key)}, **{k: v[told] for k, v in sums.items()}})

    def close(self) -> None:
        pass


def stream_running_accuracy(
    predictions: DataFrame, out_dir: str, every: int = 10, run: Sequence[str] = ("run_id",), order: Sequence[str] = ("index",),
    checkpoint: str | None = None, once: bool = True,
) -> StreamingQuery:
    """Start a query that writes accuracy and executable rate so far, after exactly every ``every``-th prediction of a run
    and after its last, to ``out_dir``/batch_id=N.

    ``predictions`` is a stream in a ``keyed_state_session`` with the columns of ``running_accuracy`` and ``expected``, the
    run's number of predictions (null: not known, so only every N-th is told). Predictions of a run that arrive together
    are taken in ``order``; otherwise the order of arrival counts. State is three numbers a run and survives restarts
    with the same checkpoint; what a task holds at a time is one run's share of one batch of the stream, which the source
    bounds. A batch repeated after a failure overwrites its own folder, so nothing is told twice. Null flags count as
    false; rows beyond ``expected`` count on.
    """
    if every <= 0:
        raise ValueError("every must be positive")
    spark = predictions.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        raise ValueError("state by key needs RocksDB as state store: read the stream in keyed_state_session(spark)")
    fields = predictions.select(*run).schema
    flags = predictions.select(*run, *order, "exec_match", "executable", F.col("expected").cast("bigint").alias("expected"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), COUNTS])
    told = flags.groupBy(*run).transformWithStateInPandas(
        statefulProcessor=_EveryNth(every, run, order), outputStructType=schema, outputMode="Append", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        with_rates(batch).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = (
        told.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint or new_folder(spark, "running-accuracy"))
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_running_accuracy(spark: SparkSession, out_dir: str, run_schema: str = "run_id bigint") -> DataFrame:
    """Everything told so far, with the number of the batch that told it."""
    return spark.read.schema(f"{run_schema}, {COUNTS}, exec_acc double, executable_rate double, batch_id bigint").parquet(out_dir)
