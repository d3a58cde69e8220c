"""Mergeable summaries of columns: approximate distinct counts by table and part, and proofs of the most frequent values.

A part (a day, say) is read once, when it is added; every column's values become one sketch of at most 2**LOG_K bytes.
Counts over any set of parts come from the union of their sketches, without the tables. Adding a part again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quorumql.operators.positions import null_safe_join
from quorumql.operators.profiling import (
    KEYS, MAX_COLUMNS, TOP_K, Tables, _family, _key_sql, _keyed, _name, _shown, _slots, _used_families, _visible, long_values, top_values,
    value_frequencies)
from quorumql.session import freeze

LOG_K = 14
_STORED = "table_name string, part string, version bigint, ordinal int, column_name string, row_count bigint, filled bigint, sketch binary"


def error_bound(log_k: int = LOG_K) -> float:
    """Relative error of a united sketch that one count in about 400 exceeds (three standard errors)."""
    return 3 * 1.04 / 2 ** (log_k / 2)


def part_sketches(df: DataFrame, table_name: str, part: str | Column, max_columns: int = MAX_COLUMNS, log_k: int = LOG_K) -> DataFrame:
    """One row for each part and column: rows, non-null values and the sketch of the values; null parts are a part named ''.

    All columns of the table are aggregated side by side, and sketches are merged within a task before the shuffle.
    """
    fields = _visible(df, max_columns)
    if not fields:
        raise ValueError("no columns to profile")
    made = df.select(F.coalesce((F.col(part) if isinstance(part, str) else part).cast("string"), F.lit("")).alias("part"),
                     *[F.expr(f"CASE WHEN {_name(f.name)} IS NOT NULL THEN xxhash64({_family(f.dataType, _name(f.name))[1]}) END").alias(f"c{i}") for i, f in enumerate(fields)])
    measures = [F.count(F.lit(1)).alias("row_count")]
    for i in range(len(fields)):
        measures += [F.count(f"c{i}").alias(f"n{i}"), F.hll_sketch_agg(f"c{i}", log_k).alias(f"s{i}")]
    wide = made.groupBy("part").agg(*measures)
    entries = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("filled"), F.col(f"s{i}").alias("sketch"))
                        for i, f in enumerate(fields)])
    return wide.select(F.lit(table_name).alias("table_name"), "part", "row_count", F.explode(entries).alias("c")).select("table_name", "part", "row_count", "c.*")


def add_parts(df: DataFrame, folder: str, table_name: str, part: str | Column, only: Sequence | None = None, max_columns: int = MAX_COLUMNS,
              log_k: int = LOG_K) -> None:
    """Sketch the parts of ``df`` (only those with the given values of ``part``, which reaches the scan as a filter) into ``folder``."""
    spark = df.sparkSession
    column = F.col(part) if isinstance(part, str) else part
    chosen = df if only is None else df.where(column.isin(list(only)))
    stored = _stored(spark, folder)
    version = (stored.agg(F.max("version")).first()[0] if stored is not None else None) or 0
    made = part_sketches(chosen, table_name, column, max_columns, log_k).withColumn("version", F.lit(version + 1).cast("bigint"))
    made.select(*[c.split()[0] for c in _STORED.split(", ")]).write.mode("append").parquet(folder)


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(_STORED).parquet(folder)


def stored_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest sketches of every part."""
    stored = _stored(spark, folder)
    if stored is None:
        return spark.createDataFrame([], _STORED)
    newest = stored.groupBy("table_name", "part").agg(F.max("version").alias("version"))
    return stored.join(newest, ["table_name", "part", "version"])


def approx_distinct(spark: SparkSession, folder: str, parts: Sequence[str] | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, row_count, filled, distinct_estimate) over the stored parts, or the given ones."""
    chosen = stored_parts(spark, folder)
    if parts is not None:
        chosen = chosen.where(F.col("part").isin([str(p) for p in parts]))
    united = chosen.groupBy("table_name", "ordinal", "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))
    return united.select("table_name", "ordinal", "column_name", "row_count", "filled", F.hll_sketch_estimate("sketch").alias("distinct_estimate"))


# Most frequent values by summaries.

#: Counters of a column's summary, and the size of the map that holds them (a power of two, 3/4 full at most).
COUNTERS, MAP_SIZE = 1536, 2048


def missed_at_most(rows: Column) -> Column:
    """How often a value may occur that a summary of ``rows`` values does not bring back.

    A summary of this kind errs by 3.5 / MAP_SIZE of its rows at most, merged or not. It brings back the values whose
    lower bound lies above the error, so others have an upper bound of twice the error.
    """
    return F.ceil(rows * F.lit(2 * 3.5 / MAP_SIZE)).cast("bigint")


def summaries(tables: Tables, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """One row for each column: its key, ``filled`` (non-null values), ``missed`` (see ``missed_at_most``) and ``items``,
    the typed values that may occur more often than that. One pass over each table, with all its columns side by side;
    only summaries are shuffled, which are merged within each task first."""
    keyed = _keyed(tables)
    used = _used_families(keyed, max_columns) or ["other"]
    parts = []
    for db_id, table_name, df in keyed:
        fields = _visible(df, max_columns)
        if not fields:
            continue
        families = [_family(f.dataType, _name(f.name)) for f in fields]
        # Wide decimals have no summary; they are counted in full.
        values = df.selectExpr(*[f"{value}{'.text' if family == 'wide' else ''} AS c{i}" for i, (family, value) in enumerate(families)])
        wide = values.selectExpr("count(1) AS row_count", *[f"count(c{i}) AS n{i}" for i in range(len(fields))],
                                 *[f"approx_top_k(c{i}, {COUNTERS}, {COUNTERS}) AS t{i}" for i in range(len(fields))])
        wide = wide.withColumn("missed", missed_at_most(F.col("row_count")))
        entries = ", ".join(
            f"struct({i} AS ordinal, n{i} AS filled, transform(filter(t{i}, x -> {'false' if family == 'wide' else 'x.item IS NOT NULL AND x.count > missed'}), "
            f"x -> {_slots(used, None) if family == 'wide' else _slots(used, family, 'x.item')}) AS items)" for i, (family, _) in enumerate(families))
        parts.append(wide.selectExpr("missed", f"explode(array({entries})) AS c").selectExpr(*_key_sql(db_id, table_name), "missed", "c.*"))
    if not parts:
        raise ValueError("no columns to profile")
    return reduce(DataFrame.unionAll, parts)


def top_values_by_summaries(tables: Tables, top_k: int = TOP_K, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """The rows of ``top_values``, without shuffling every distinct value of columns that have clear favourites.

    The candidates that summaries bring back, a few hundred for a column at most, are counted exactly in a second pass;
    only their counts are shuffled. A column is proven if its candidates are all its values, or if its k-th best exact
    count lies above what any other value can reach. Columns that are not proven are counted in full.
    """
    if top_k <= 0:
        raise ValueError("top_k must be > 0")
    found = freeze(summaries(tables, max_columns), "summaries")
    used = found.schema["items"].dataType.elementType.fieldNames()
    wanted = found.select(*KEYS, F.explode("items").alias("v")).select(*KEYS, "v.*")
    counted = freeze(_counted(tables, max_columns, wanted, used), "candidates")
    best = Window.partitionBy(*KEYS).orderBy(F.desc("freq"), *used)
    ranked = counted.withColumn("rank", F.row_number().over(best))
    proof = ranked.groupBy(*KEYS).agg(F.sum("freq").alias("counted"), F.max(F.when(F.col("rank") == top_k, F.col("freq"))).alias("kth"))
    judged = null_safe_join(found.drop("items"), proof, KEYS, "left").select(
        *KEYS, "filled", (F.coalesce(F.col("counted") == F.col("filled"), F.lit(False)) | F.coalesce(F.col("kth") > F.col("missed"), F.lit(False))).alias("proven"))
    judged = freeze(judged.where("filled > 0"), "judged")
    proven = null_safe_join(ranked.where(F.col("rank") <= top_k), judged.where("proven"), KEYS, "left_semi")
    rows = proven.select(*KEYS, "rank", "freq", _shown("", used).alias("value"))
    rest = judged.where("NOT proven").select(*KEYS)
    return rows if rest.isEmpty() else rows.unionByName(top_values(value_frequencies(tables, max_columns, rest), top_k))


def _counted(tables: Tables, max_columns: int, wanted: DataFrame, used: list[str]) -> DataFrame:
    """Exact counts of the wanted values (a few hundred for each column, so they are broadcast)."""
    columns = wanted.select(*KEYS).distinct()
    if columns.isEmpty():
        return wanted.withColumn("freq", F.lit(0).cast("bigint"))
    values = long_values(tables, max_columns, columns)
    kept = null_safe_join(values, F.broadcast(wanted.select(*KEYS, *used)), [*KEYS, *used], "left_semi")
    return kept.groupBy(*KEYS, *used).agg(F.count(F.lit(1)).alias("freq"))
