"""Database contexts from stored profiles: a table is profiled once and again only when its files have changed."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumql.operators.dictionary import database_contexts, describe_tables, schema_text
from quorumql.operators.positions import null_safe_join
from quorumql.operators.profiling import MAX_COLUMNS, TOP_K, check_mode, profile_tables
from quorumql.session import freeze

Paths = Mapping[str, Mapping[str, str]]  # database -> table -> path of its files
_KEY = ["db_id", "table_name"]
_MARK = [*_KEY, "fingerprint"]
_PROFILES = ("db_id string, table_name string, ordinal int, column_name string, declared_type string, inferred_type string, row_count bigint, "
             "null_count bigint, null_rate double, min_value string, max_value string, distinct_count bigint, sample_values array<string>, fingerprint string")
_CATALOG = "db_id string, table_name string, ordinal int, column_name string, declared_type string, nullable boolean, fingerprint string"


def fingerprints(spark: SparkSession, paths: Paths, settings: str = "") -> DataFrame:
    """(db_id, table_name, fingerprint) by name, length and time of each table's files, whose contents are not read.

    ``settings`` takes part, so profiles made with other settings are not taken for these.
    """
    listed = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
            F.lit(db).alias("db_id"), F.lit(name).alias("table_name"), F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("mark"))
        for db, tables in sorted(paths.items()) for name, path in sorted(tables.items())]
    if not listed:
        raise ValueError("no tables to profile")
    files = reduce(DataFrame.unionAll, listed)
    return files.groupBy(*_KEY).agg(F.concat_ws(":", F.lit(settings), F.count(F.lit(1)).cast("string"), F.sum("mark").cast("string")).alias("fingerprint"))


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(folder) if found else spark.createDataFrame([], schema)


def refresh(spark: SparkSession, paths: Paths, store: str, max_columns: int = MAX_COLUMNS, top_k: int = TOP_K, fmt: str = "parquet") -> DataFrame:
    """Profile the tables whose fingerprint has nothing stored below ``store``; the tables' fingerprints now.

    Tables are read and profiled together, in the plan of ``profile_tables``. What is stored about earlier states of a
    table stays there and is not read again, until the state comes back.
    """
    now = freeze(fingerprints(spark, paths, f"{fmt}:{max_columns}:{top_k}"), "fingerprints")
    seen = _stored(spark, f"{store}/catalog", _CATALOG).select(*_MARK).distinct()
    changed = null_safe_join(now, seen, _MARK, "left_anti").collect()  # one row for each changed table
    if changed:
        tables = {(r.db_id, r.table_name): spark.read.format(fmt).load(paths[r.db_id][r.table_name]) for r in changed}
        marks = F.broadcast(spark.createDataFrame([tuple(r) for r in changed], "db_id string, table_name string, fingerprint string"))
        catalog = reduce(DataFrame.unionByName, [describe_tables(spark, {name: df}, db) for (db, name), df in tables.items()])
        profiles = profile_tables(tables, max_columns, top_k)
        # The catalog is written last: it says that a state's profiles are whole.
        for made, folder, schema in ((profiles, "profiles", _PROFILES), (catalog, "catalog", _CATALOG)):
            names = [c.strip().split()[0] for c in schema.split(", ")]
            null_safe_join(made, marks, _KEY).select(*names).write.mode("append").parquet(f"{store}/{folder}")
    return now


def stored_contexts(spark: SparkSession, paths: Paths, store: str, mode: str = "stats_and_samples", max_columns: int = MAX_COLUMNS,
                    top_k: int = TOP_K, fmt: str = "parquet") -> DataFrame:
    """What ``build_contexts`` gives for the tables at ``paths``, from stored profiles; only changed tables are read.

    A table that a failed run left half stored is profiled again; its rows are told apart by being equal, so they count once.
    """
    check_mode(mode)
    now = refresh(spark, paths, store, max_columns, top_k, fmt)
    catalog = null_safe_join(_stored(spark, f"{store}/catalog", _CATALOG), now, _MARK, "left_semi").drop("fingerprint").distinct()
    profiles = null_safe_join(_stored(spark, f"{store}/profiles", _PROFILES), now, _MARK, "left_semi").drop("fingerprint").distinct()
    return database_contexts(schema_text(catalog, max_columns), None if mode == "off" else profiles, mode)
