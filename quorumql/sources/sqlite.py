"""Reading tables out of SQLite files in parallel rowid ranges.

The files must lie where every executor can read them. A table is cut into ranges of its rowid, each read by its
own task over its own read-only connection in batches, so no task holds a table. A table without rowid is one range.

Cells may hold values of any type whatever their column declares. A value that its column's type cannot carry is an
error, never a null; ``as_text`` reads every column as text instead.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION = 1_000_000
ROWS_PER_BATCH = 10_000
#: Ranges that one table is cut into at most; sparse rowids make the ranges wider.
MOST_RANGES = 1000
_CATALOG_SQL = "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)


def _spark_type(declared: str) -> str:
    """Column type by the usual affinity rules; text for anything unclear, since cells may hold any type."""
    upper = (declared or "").upper()
    if "INT" in upper:
        return "bigint"
    if any(token in upper for token in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in upper:
        return "binary"
    if any(token in upper for token in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "string"


_FITTING = {"bigint": (int,), "double": (int, float), "binary": (bytes,)}
_CONVERT = {"bigint": int, "double": float, "binary": bytes, "string": lambda v: v.hex() if isinstance(v, bytes) else str(v)}


def _converted(name: str, kind: str, values: Sequence) -> list:
    fitting = _FITTING.get(kind)
    if fitting and (odd := next((v for v in values if v is not None and not isinstance(v, fitting)), None)) is not None:
        raise ValueError(f"column {name} is read as {kind} and holds {odd!r}; read the table as text")
    convert = _CONVERT[kind]
    return [None if v is None else convert(v) for v in values]


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[tuple[str, str]], rows_per_partition: int) -> None:
        self.path, self.table, self.columns, self.rows = path, table, columns, rows_per_partition

    def partitions(self) -> Sequence[InputPartition]:
        with _open(self.path) as connection:
            try:
                low, high = connection.execute(
                    f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}"
                ).fetchone()
            except sqlite3.OperationalError:  # a table without rowid is read as one range
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, 0)]
        width = max(self.rows, -(-(high + 1 - low) // MOST_RANGES))
        return [_Range(start, min(start + width, high + 1)) for start in range(low, high + 1, width)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_quoted(n) for n, _ in self.columns)
        query = f"SELECT {names} FROM {_quoted(self.table)}"
        bounds: tuple = ()
        if partition.low is not None:
            query, bounds = query + " WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)
        schema = pa.schema([(n, _ARROW[t]) for n, t in self.columns])
        with _open(self.path) as connection:
            cursor = connection.execute(query, bounds)
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                arrays = [
                    pa.array(_converted(n, t, values), type=_ARROW[t])
                    for (n, t), values in zip(self.columns, zip(*rows))
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class SQLiteTables(DataSource):
    """``spark.read.format("sqlite_table").options(path=..., table=...)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as connection:
            rows = connection.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        as_text = str(self.options.get("asText", "false")).lower() == "true"
        return [(r[1], "string" if as_text else _spark_type(r[2])) for r in rows]

    def schema(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in self._columns())

    def reader(self, schema) -> DataSourceReader:
        rows = int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION))
        return _Reader(self.options["path"], self.options["table"], self._columns(), rows)


def list_tables(path: str) -> list[str]:
    with _open(path) as connection:
        return [r[0] for r in connection.execute(_CATALOG_SQL)]


def read_sqlite(
    spark: SparkSession, path: str, table: str, rows_per_partition: int = ROWS_PER_PARTITION, as_text: bool = False
) -> DataFrame:
    spark.dataSource.register(SQLiteTables)
    return (
        spark.read.format("sqlite_table")
        .options(path=path, table=table, rowsPerPartition=str(rows_per_partition), asText=str(as_text).lower())
        .load()
    )


def ingest_sqlite(spark: SparkSession, files: dict[str, str], out_dir: str) -> dict[str, dict[str, str]]:
    """Write every table of every file (db_id -> path) to Parquet once; returns db_id -> table -> folder."""
    written: dict[str, dict[str, str]] = {}
    for db_id, path in files.items():
        for table in list_tables(path):
            target = f"{out_dir}/{db_id}/{table}"
            read_sqlite(spark, path, table).write.mode("error").parquet(target)
            written.setdefault(db_id, {})[table] = target
    return written
