"""Running many SQL statements in few Spark jobs, each against its own database; what goes wrong is recorded as data."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quorumql.functions.cells import canonical_cells, shown_cells
from quorumql.operators.positions import null_safe_join
from quorumql.session import freeze, new_folder

DEADLINE_SECONDS = 20.0
#: Statements that are run as one job while all goes well, and pieces into which a job that failed is split.
BATCH, PIECES = 100, 8
_INTERRUPT_SECONDS = 0.5
_ROWS = "text_id bigint, attempt string, row_id bigint, cells array<string>, shown array<string>"
_RUNS = "text_id bigint, attempt string, error string, error_condition string, elapsed_s double, columns array<string>"
_PARTITION_BITS = 33
#: Finished runs that the driver holds before it writes them to the shared folder.
_RUNS_HELD = 500
_NUMBERED = re.compile(r"\w*#\d+L?")
#: How EXPLAIN reports what planning the statement ran into, such as a division of constants by zero.
_PLANNING_FAILED = "Error occurred during query planning"


@dataclass(frozen=True)
class _Run:
    text_id: int
    attempt: str
    error: str | None
    condition: str | None
    elapsed_s: float
    columns: list[str]


@dataclass(frozen=True)
class _Prepared:
    """An analysed statement; ``alone`` if it is known to fail, so that it must not take others with it."""

    text_id: int
    sql: str
    rows: DataFrame
    columns: list[str]
    elapsed_s: float
    alone: bool


def as_query(spark: SparkSession, sql: str) -> tuple[DataFrame, bool]:
    """The statement as a DataFrame, and whether planning it failed.

    It has to be a whole statement by itself, which EXPLAIN checks without carrying anything out, and it is placed
    in a FROM clause, where only queries are allowed.
    """
    text = sql.strip().rstrip(";")
    plan = spark.sql(f"EXPLAIN {text}").first()[0]
    return spark.sql(f"SELECT * FROM (\n{text}\n) AS statement"), plan.startswith(_PLANNING_FAILED)


def describe_error(error: Exception, sql: str = "") -> tuple[str, str | None]:
    """The whole message and its condition.

    The plan that Spark appends and the numbers that it gives to columns change from run to run and are left out;
    what looks like such a number but stands in the statement itself is kept.
    """
    condition = getattr(error, "getCondition", lambda: None)()
    message = str(error).split("\n\nJVM stacktrace:")[0].strip()
    message = re.split(r";\n(?=['+:!]|\w)", message, maxsplit=1)[0]
    own = set(_NUMBERED.findall(sql))
    message = _NUMBERED.sub(lambda m: m[0] if m[0] in own else m[0].split("#")[0], message).strip()
    return message or type(error).__name__, condition


class _Deadline:
    """Cancels the jobs that the current thread starts inside, once ``seconds`` have passed and until the end."""

    def __init__(self, spark: SparkSession, seconds: float) -> None:
        self.context, self.seconds = spark.sparkContext, seconds
        self.tag, self.finished, self.passed = f"statement-{uuid.uuid4().hex}", threading.Event(), False

    def _watch(self) -> None:
        pause = self.seconds
        while not self.finished.wait(pause):  # a job may start after the deadline has passed
            self.passed = True
            self.context.cancelJobsWithTag(self.tag)
            pause = _INTERRUPT_SECONDS

    def __enter__(self) -> _Deadline:
        self.context.addJobTag(self.tag)
        self.watcher = threading.Thread(target=self._watch, daemon=True)
        self.watcher.start()
        return self

    def __exit__(self, *_) -> None:
        self.finished.set()
        self.watcher.join()
        self.context.removeJobTag(self.tag)


def _prepare(spark: SparkSession, text_id: int, sql: str, max_rows: int | None, precision: int, shown: bool) -> _Prepared | _Run:
    started = time.perf_counter()
    try:
        if max_rows is not None and max_rows < 0:
            raise ValueError("a row cap below zero (non-negative is needed)")
        df, alone = as_query(spark, sql)
        columns = df.columns
        if max_rows is not None:
            df = df.limit(max_rows + 1)
        plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
        rows = plain.select(
            F.lit(text_id).cast("bigint").alias("text_id"), F.monotonically_increasing_id().alias("row_id"),
            canonical_cells(plain, precision=precision).alias("cells"), *([shown_cells(plain).alias("shown")] if shown else []))
    except Exception as problem:  # noqa: BLE001 - every failure becomes a record
        return _Run(text_id, "", *describe_error(problem, sql), time.perf_counter() - started, [])
    return _Prepared(text_id, sql, rows, columns, time.perf_counter() - started, alone)


def _write_together(spark: SparkSession, texts: list[_Prepared], folder: str, timeout_s: float) -> Iterator[_Run]:
    """Write the rows of all ``texts`` in one job; if it fails or runs into the deadline, in jobs of fewer and fewer texts.

    A text that fails alone has failed, with its own error. Rows carry the attempt that wrote them, so whatever a failed
    one may have left counts for nothing. The time of a job is shared evenly by its texts.
    """
    attempt, started, problem = uuid.uuid4().hex, time.perf_counter(), None
    with _Deadline(spark, timeout_s) as deadline:
        try:
            rows = reduce(DataFrame.unionAll, [t.rows for t in texts])
            rows.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(folder)
        except Exception as caught:  # noqa: BLE001
            problem = caught
    elapsed = time.perf_counter() - started
    if problem is None:
        for t in texts:
            yield _Run(t.text_id, attempt, None, None, t.elapsed_s + elapsed / len(texts), t.columns)
    elif len(texts) == 1:
        late = deadline.passed
        error, condition = (f"deadline of {timeout_s:g} s exceeded", None) if late else describe_error(problem, texts[0].sql)
        yield _Run(texts[0].text_id, attempt, error, condition, texts[0].elapsed_s + elapsed, [])
    else:
        size = -(-len(texts) // PIECES)
        for i in range(0, len(texts), size):
            yield from _write_together(spark, texts[i : i + size], folder, timeout_s)


def _run_batch(spark: SparkSession, texts: list[tuple[int, str]], folders: list[str], timeout_s: float, max_rows: int | None,
               precision: int, shown: bool) -> list[_Run]:
    """Analyse each text by itself, then run them together; ``folders`` are those that no job is writing to."""
    made = [_prepare(spark, i, sql, max_rows, precision, shown) for i, sql in texts]
    runs = [m for m in made if isinstance(m, _Run)]
    good = [m for m in made if isinstance(m, _Prepared)]
    together, alone = [m for m in good if not m.alone], [[m] for m in good if m.alone]
    folder = folders.pop()
    for part in [*([together] if together else []), *alone]:
        runs.extend(_write_together(spark, part, folder, timeout_s))
    folders.append(folder)
    return runs


def run_statements(
    statements: DataFrame,
    timeout_s: float = DEADLINE_SECONDS,
    max_rows: int | None = None,
    workers: int = 8,
    precision: int = 6,
    sql: str = "sql",
    database: str | None = None,
    sessions: Callable[[str], SparkSession] | None = None,
    shown: bool = False,
    batch: int = BATCH,
) -> tuple[DataFrame, DataFrame]:
    """Run every statement of a table and return (executions, result rows).

    With ``database`` naming a column, each statement runs in ``sessions(its database)``, a session whose tables are
    that database's own; without it all run in the table's session. Statements with equal database and text run once
    and share their result. Texts are numbered in a stored table and come to the driver a batch at a time, where each is
    analysed by itself, as any Spark query is. The texts of a batch then run as one job, the union of their rows under
    their numbers; a job that fails or runs into the deadline is split and tried again, so that in the end every text has
    the rows or the error that it has alone. Jobs at the same time write to a folder each, of which there are as many as
    ``workers``, whatever the number of texts.

    Executions repeat the input columns plus error (the whole message), error_condition, elapsed_s, row_count, truncated
    and columns. Result rows carry the input columns (without the text), ``row_pos`` and ``cells``, and with ``shown`` the
    values untouched for display; positions follow the statement's own ORDER BY. At the deadline a job is cancelled; a
    task stuck in one long computation ends with ``spark.task.reaper.enabled``.
    """
    if (database is None) != (sessions is None):
        raise ValueError("a database column and the sessions of its databases come together")
    spark = statements.sparkSession
    folder, records = new_folder(spark, "statements"), new_folder(spark, "runs")
    by = [sql] if database is None else [database, sql]
    distinct = statements.select(*by).where(F.coalesce(F.col(sql), F.lit("")) != "").distinct()
    texts = freeze(distinct.withColumn("text_id", F.monotonically_increasing_id()), "texts")
    opened: dict[str, SparkSession] = {}
    workers = max(1, workers)
    folders = [f"{folder}/worker={i}" for i in range(workers)]

    def batches() -> Iterator[tuple[SparkSession, list[tuple[int, str]]]]:
        """Up to ``batch`` texts of one database each."""
        name, held = None, []
        for row in (texts if database is None else texts.orderBy(database)).toLocalIterator():
            own = None if database is None else row[database]
            if held and (own != name or len(held) >= batch):
                yield opened.get(name, spark), held
                held = []
            if database is not None and own not in opened:
                opened[own] = sessions(own)
            name = own
            held.append((row["text_id"], row[sql]))
        if held:
            yield opened.get(name, spark), held

    def submitted(pool: ThreadPoolExecutor) -> Iterator[_Run]:
        """Runs in order of completion; as many batches are held as there are workers."""
        running = set()
        for own, part in batches():
            if len(running) >= workers:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for d in done:
                    yield from d.result()
            running.add(pool.submit(_run_batch, own, part, folders, timeout_s, max_rows, precision, shown))
        for r in running:
            yield from r.result()

    held: list[tuple] = []
    any_ran = False

    def store() -> None:
        spark.createDataFrame(held, _RUNS).coalesce(1).write.mode("append").parquet(records)
        held.clear()

    with ThreadPoolExecutor(max_workers=workers) as pool:
        for run in submitted(pool):
            any_ran = any_ran or run.error is None
            held.append((run.text_id, run.attempt, run.error, run.condition, run.elapsed_s, run.columns))
            if len(held) >= _RUNS_HELD:
                store()
        store()

    text_ids = texts.select("text_id", *by)
    runs = spark.read.schema(_RUNS).parquet(records)
    if any_ran:
        stored = spark.read.schema(_ROWS).parquet(folder).join(runs.where("error IS NULL").select("text_id", "attempt"), ["text_id", "attempt"], "left_semi")
    else:
        stored = spark.createDataFrame([], _ROWS)
    rows = stored.withColumn("_segment", F.shiftright("row_id", _PARTITION_BITS)).withColumn(
        "_offset", F.col("row_id").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    )
    # One row per statement and task that wrote some of its rows. Written once, as ``numbered`` below, so that Spark knows
    # how small it is: a shuffle by these keys would bring all rows of one text and task into one task.
    sizes = freeze(rows.groupBy("text_id", "_segment").agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    before = Window.partitionBy("text_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("text_id", "_segment", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(starts, ["text_id", "_segment"]).select(
        "text_id", (F.col("_start") + F.col("_offset")).alias("row_pos"), "cells", *(["shown"] if shown else [])
    )
    counted = sizes.groupBy("text_id").agg(F.sum("_rows").alias("row_count"))
    if max_rows is not None:
        placed = placed.where(F.col("row_pos") < max_rows)
    named = null_safe_join(statements, text_ids, by, "left")
    joined = named.join(runs.drop("attempt"), "text_id", "left").join(counted, "text_id", "left")
    total = F.coalesce("row_count", F.lit(0))
    cap = total if max_rows is None else F.least(total, F.lit(max_rows))
    executions = joined.select(
        *statements.columns,
        "error",
        "error_condition",
        F.coalesce("elapsed_s", F.lit(0.0)).alias("elapsed_s"),
        F.when(F.col("error").isNull() & F.col("text_id").isNotNull(), cap).alias("row_count"),
        (F.lit(False) if max_rows is None else F.coalesce(total > max_rows, F.lit(False))).alias("truncated"),
        "columns",
    )
    keys = [c for c in statements.columns if c != sql]
    numbered = freeze(named.select("text_id", *keys), "numbered")
    results = numbered.join(placed, "text_id").select(*keys, "row_pos", "cells", *(["shown"] if shown else []))
    return executions, results
