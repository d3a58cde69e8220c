"""Schema and dictionary text for prompts, assembled from catalog rows and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quorumql.functions.render import fixed_format
from quorumql.operators.profiling import MAX_COLUMNS, check_mode, profile_tables

_CATALOG = "db_id string, table_name string, ordinal int, column_name string, declared_type string, nullable boolean"


def _ordered_lines(order: Sequence[str], line: str = "line") -> Column:
    """Lines of one group in order; groups are the columns of a table or the tables of a database."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line)))
    return F.array_join(packed[line], "\n")


def dictionary_lines(profiles: DataFrame, include_samples: bool = True) -> DataFrame:
    """One text line per profiled column."""
    pieces = [
        F.concat(F.lit("type="), "inferred_type"),
        F.concat(F.lit("null_rate="), fixed_format(F.col("null_rate"), 3)),
        F.concat(F.lit("distinct="), F.col("distinct_count").cast("string")),
        F.concat(F.lit("min="), "min_value", F.lit(", max="), "max_value"),
    ]
    if include_samples:
        listed = F.concat(F.lit("samples=["), F.array_join("sample_values", ", "), F.lit("]"))
        pieces.append(F.when(F.size("sample_values") > 0, listed))
    line = F.concat(F.lit("  - "), "column_name", F.lit(": "), F.concat_ws(", ", *pieces))
    return profiles.select(
        "db_id", "table_name", "row_count", F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        F.coalesce(line, F.lit("  - <no columns>")).alias("line"),
    )


def table_dictionaries(profiles: DataFrame, include_samples: bool = True) -> DataFrame:
    """Dictionary text per table: a header with the row count, then one line per column."""
    header = F.concat(F.lit("TABLE "), "table_name", F.lit(" (rows="), F.col("row_count").cast("string"), F.lit(")\n"))
    return (
        dictionary_lines(profiles, include_samples)
        .groupBy("db_id", "table_name", "row_count")
        .agg(_ordered_lines(["ordinal"]).alias("body"))
        .select("db_id", "table_name", F.concat(header, "body").alias("dictionary_text"))
    )


def dictionary_text(profiles: DataFrame, include_samples: bool = True) -> DataFrame:
    """Dictionary text per database, tables in name order."""
    per_table = table_dictionaries(profiles, include_samples).withColumnRenamed("dictionary_text", "line")
    return per_table.groupBy("db_id").agg(_ordered_lines(["table_name"]).alias("data_dictionary_text"))


def describe_tables(spark: SparkSession, tables: Mapping[str, DataFrame], db_id: str | None = None) -> DataFrame:
    """Catalog rows of the given tables, one per column (one with null column for a table without any)."""
    rows: list[tuple] = []
    for name, df in sorted(tables.items()):
        if not df.columns:
            rows.append((db_id, name, None, None, None, None))
        for i, field in enumerate(df.schema.fields):
            rows.append((db_id, name, i, field.name, field.dataType.simpleString().upper(), field.nullable))
    return spark.createDataFrame(rows, _CATALOG)


def sample_rows(
    tables: Mapping[str, DataFrame], order_by: Mapping[str, Sequence[str]], n: int, db_id: str | None = None
) -> DataFrame:
    """First ``n`` rows of each table in its given order, one JSON line each."""
    if n <= 0:
        raise ValueError("n must be > 0")
    parts = []
    for name, df in sorted(tables.items()):
        order = order_by[name]
        top = df.orderBy(*order).limit(n)
        rank = F.row_number().over(Window.orderBy(*order))  # over the n rows kept, never over a table
        parts.append(top.select(
            F.lit(db_id).cast("string").alias("db_id"), F.lit(name).alias("table_name"), rank.alias("rank"),
            F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_text"),
        ))
    return reduce(DataFrame.unionByName, parts)


def schema_text(
    catalog: DataFrame,
    max_columns: int = MAX_COLUMNS,
    keys: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Schema text per table.

    ``keys`` (db_id, table_name, column_name, is_pk, not_null) and ``foreign_keys`` (db_id, table_name, seq,
    from_column, to_table, to_column) carry constraints, which column files do not hold; ``samples`` comes from
    ``sample_rows``.
    """
    place = ["db_id", "table_name"]
    if keys is None:
        tagged = catalog.withColumn("tags", F.lit(""))
    else:
        marks = keys.select(
            F.col("db_id").alias("_db"), F.col("table_name").alias("_table"), F.col("column_name").alias("_column"),
            F.concat_ws(" ", F.when(F.col("is_pk"), F.lit("pk")), F.when(F.col("not_null"), F.lit("not_null"))).alias("marks"),
        )
        same = (
            F.col("db_id").eqNullSafe(F.col("_db"))
            & (F.col("table_name") == F.col("_table")) & (F.col("column_name") == F.col("_column"))
        )
        tagged = catalog.join(marks, same, "left").withColumn(
            "tags", F.when(F.length("marks") > 0, F.concat(F.lit(" ["), "marks", F.lit("]"))).otherwise(F.lit(""))
        )
    column_line = F.coalesce(
        F.concat(
            F.lit("  - "), "column_name", F.lit(": "),
            F.coalesce(F.nullif("declared_type", F.lit("")), F.lit("UNKNOWN")), "tags",
        ),
        F.lit("  columns: <none>"),
    )
    ordinal = F.coalesce("ordinal", F.lit(0))
    heads = catalog.select(*place).distinct().select(
        *place, F.lit(0).alias("section"), F.lit(0).alias("rank"), F.concat(F.lit("TABLE "), "table_name").alias("line")
    )
    columns = tagged.where(ordinal < max_columns).select(
        *place, F.lit(1).alias("section"), ordinal.alias("rank"), column_line.alias("line")
    )
    rest = catalog.groupBy(*place).agg(F.count("column_name").alias("n")).where(F.col("n") > max_columns).select(
        *place, F.lit(2).alias("section"), F.lit(0).alias("rank"),
        F.concat(F.lit("  - ... "), (F.col("n") - max_columns).cast("string"), F.lit(" more columns")).alias("line"),
    )
    lines = heads.unionByName(columns).unionByName(rest)
    if foreign_keys is not None:
        titles = foreign_keys.select(*place).distinct().select(
            *place, F.lit(3).alias("section"), F.lit(0).alias("rank"), F.lit("  foreign_keys:").alias("line")
        )
        links = foreign_keys.select(
            *place, F.lit(4).alias("section"), F.col("seq").cast("int").alias("rank"),
            F.concat(F.lit("    - "), "from_column", F.lit(" -> "), "to_table", F.lit("."), "to_column").alias("line"),
        )
        lines = lines.unionByName(titles).unionByName(links)
    if samples is not None:
        titles = samples.select(*place).distinct().select(
            *place, F.lit(5).alias("section"), F.lit(0).alias("rank"), F.lit("  sample_rows:").alias("line")
        )
        shown = samples.select(
            *place, F.lit(6).alias("section"), "rank", F.concat(F.lit("    - "), "row_text").alias("line")
        )
        lines = lines.unionByName(titles).unionByName(shown)
    return lines.groupBy(*place).agg(_ordered_lines(["section", "rank"]).alias("schema_text"))


def database_contexts(schemas: DataFrame, profiles: DataFrame | None = None, mode: str = "stats_and_samples") -> DataFrame:
    """One row per database: schema text of its tables in name order, and dictionary text unless mode is off."""
    check_mode(mode)
    texts = schemas.withColumnRenamed("schema_text", "line").groupBy("db_id").agg(
        _ordered_lines(["table_name"]).alias("schema_text")
    )
    if mode == "off" or profiles is None:
        return texts.withColumn("data_dictionary_text", F.lit(None).cast("string"))
    words = dictionary_text(profiles, include_samples=mode == "stats_and_samples")
    joined = texts.join(words.withColumnRenamed("db_id", "_db"), F.col("db_id").eqNullSafe(F.col("_db")), "left")
    return joined.select("db_id", "schema_text", "data_dictionary_text")


def build_contexts(
    spark: SparkSession,
    databases: Mapping[str, Mapping[str, DataFrame]],
    mode: str = "stats_and_samples",
    max_columns: int = MAX_COLUMNS,
    top_k: int = 3,
) -> DataFrame:
    """Contexts of several databases straight from their tables."""
    check_mode(mode)
    catalog = reduce(DataFrame.unionByName, [describe_tables(spark, t, d) for d, t in sorted(databases.items())])
    profiles = None
    if mode != "off":
        tables = {(db, name): df for db, found in databases.items() for name, df in found.items()}
        profiles = profile_tables(tables, max_columns, top_k)
    return database_contexts(schema_text(catalog, max_columns), profiles, mode)
