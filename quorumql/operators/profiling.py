"""Column profiles of whole tables in two passes, however many columns there are.

Pass one is a single aggregation per table with every count, minimum, maximum and text-class count side by side. Pass two
counts value frequencies of all columns of all tables in one shuffle, from which exact distinct counts and top values follow.
Both pre-aggregate on the map side, so a value held by a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quorumql.functions.render import general_format, quoted_text

# What makes a column numeric or date-like, and the shares of its values needed.
NUMERIC_TYPE_TOKENS = ("INT", "REAL", "NUM", "DEC", "DOUB", "FLOA")
DATE_TYPE_TOKENS = ("DATE", "TIME")
DATE_NAME_TOKENS = ("date", "time", "year", "month", "day")
DATE_PATTERNS = ("____-__-__%", "____/__/__%", "__/__/____%")
NUMERIC_SHARE = 0.9
DATE_SHARE = 0.8
MODES = ("off", "stats", "stats_and_samples")
MEASURES = ("types", "ranges")
MAX_COLUMNS = 80
TOP_K = 3

KEYS = ("db_id", "table_name", "ordinal")
Tables = Mapping[str | tuple[str, str], DataFrame]

_NUMERIC_TEXT = r"\A[0-9.\-]*[0-9][0-9.\-]*\z"
_NESTED = (T.ArrayType, T.StructType, T.MapType)

# Families of typed value columns; each profiled column fills exactly one, so values sort in their own order.
_FAMILIES = {
    "whole": "bigint",
    "exact": "decimal(38,18)",
    # Digits beyond the shared decimal: what lies below a whole number is kept apart, so that values sort by size.
    "wide": "struct<whole:decimal(38,0),rest:decimal(38,38),text:string>",
    "real": "double",
    "day": "date",
    "moment": "timestamp_ntz",
    "text": "string",
    "other": "string",
}


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown dictionary mode {mode!r}; expected one of {', '.join(MODES)}")
    return mode


def numeric_looking(text: Column) -> Column:
    """At least one digit and nothing but digits, dots and minus signs once spaces are trimmed.

    This takes 2024-01-01 as numeric and leaves out 1e5, +3 and 1,000.
    """
    return F.trim(text).rlike(_NUMERIC_TEXT)


def date_looking(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.like(p) for p in DATE_PATTERNS])


_NUMERIC_SQL = "trim({}) RLIKE r'" + _NUMERIC_TEXT + "'"


def _date_sql(column: str) -> str:
    return " OR ".join(f"{column} LIKE '{p}'" for p in DATE_PATTERNS)


def declared_class(dtype: T.DataType, name: str) -> str | None:
    """``numeric`` or ``date-ish`` by declared type, then by column name; None when only values can tell."""
    if isinstance(dtype, T.BooleanType):
        return "numeric"
    atomic = not isinstance(dtype, (*_NESTED, T.DayTimeIntervalType, T.YearMonthIntervalType))
    declared = dtype.simpleString().upper()
    if atomic and any(token in declared for token in NUMERIC_TYPE_TOKENS):
        return "numeric"
    if atomic and any(token in declared for token in DATE_TYPE_TOKENS):
        return "date-ish"
    if any(token in name.lower() for token in DATE_NAME_TOKENS):
        return "date-ish"
    return None


def _visible(df: DataFrame, max_columns: int) -> list[T.StructField]:
    if max_columns <= 0:
        raise ValueError("max_columns must be > 0")
    return df.schema.fields[:max_columns]


def _name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def _literal(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _family(dtype: T.DataType, value: str) -> tuple[str, str]:
    """Family of a column type, and the SQL that brings a value of that type into it."""
    if isinstance(dtype, T.BooleanType):
        return "whole", f"CAST(CAST({value} AS INT) AS BIGINT)"
    if isinstance(dtype, T.IntegralType):
        return "whole", f"CAST({value} AS BIGINT)"
    if isinstance(dtype, T.DecimalType):
        if dtype.precision - dtype.scale <= 20 and dtype.scale <= 18:
            return "exact", f"CAST({value} AS DECIMAL(38, 18))"
        whole = f"CAST(floor({value}) AS DECIMAL(38, 0))"
        return "wide", f"struct({whole} AS whole, CAST({value} - floor({value}) AS DECIMAL(38, 38)) AS rest, CAST({value} AS STRING) AS text)"
    if isinstance(dtype, T.FractionalType):
        return "real", f"CAST({value} AS DOUBLE)"
    if isinstance(dtype, T.DateType):
        return "day", value
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "moment", f"CAST({value} AS TIMESTAMP_NTZ)"
    if isinstance(dtype, T.StringType):
        return "text", value
    if isinstance(dtype, T.BinaryType):
        return "other", f"lower(hex({value}))"
    if isinstance(dtype, _NESTED):
        return "other", f"to_json({value}, map('ignoreNullFields', 'false'))"
    return "other", f"CAST({value} AS STRING)"


def _slots(used: list[str], family: str | None, value: str = "NULL") -> str:
    """Struct with one slot per family in use, all null but the given one.

    Unpivoting gives all structs the type of the first, so a slot must count as nullable even for a column without
    nulls; the CASE makes it so.
    """
    filled = f"CASE WHEN {value}{'.text' if family == 'wide' else ''} IS NOT NULL THEN {value} END"
    parts = [f"CAST({filled if f == family else 'NULL'} AS {_FAMILIES[f]}) AS {f}" for f in used]
    return f"struct({', '.join(parts)})"


def _keyed(tables: Tables) -> list[tuple[str | None, str, DataFrame]]:
    if not tables:
        raise ValueError("no tables to profile")
    found = [(*(key if isinstance(key, tuple) else (None, key)), df) for key, df in tables.items()]
    return sorted(found, key=lambda entry: (entry[0] or "", entry[1]))


def _key_sql(db_id: str | None, table_name: str) -> list[str]:
    return [f"{_literal(db_id)} AS db_id", f"{_literal(table_name)} AS table_name"]


def _used_families(tables: list[tuple[str | None, str, DataFrame]], max_columns: int) -> list[str]:
    found = {_family(f.dataType, "x")[0] for _, _, df in tables for f in _visible(df, max_columns)}
    return [name for name in _FAMILIES if name in found]


def _shown(prefix: str, used: list[str]) -> Column:
    """Printable form of the one typed value that is filled."""
    forms = {
        "whole": lambda c: c.cast("string"),
        "exact": lambda c: F.rtrim(F.rtrim(c.cast("string"), F.lit("0")), F.lit(".")),
        "wide": lambda c: c["text"],
        "real": general_format,
        "day": lambda c: c.cast("string"),
        "moment": lambda c: c.cast("string"),
        "text": quoted_text,
        "other": lambda c: c,
    }
    shown = [forms[f](F.col(f"{prefix}{f}")) for f in used]
    return F.coalesce(*shown) if shown else F.lit(None).cast("string")


def _raw_stats(
    db_id: str | None, table_name: str, df: DataFrame, max_columns: int, used: list[str], asked: Sequence[str]
) -> DataFrame:
    """Counts and typed ranges of one table in long form. Expressions over many columns are written as SQL text:
    one call builds them all, where a call per column operation would make planning slower than running."""
    measures, entries = ["count(1) AS rows"], []
    for i, field in enumerate(_visible(df, max_columns)):
        column, dtype = _name(field.name), field.dataType
        by_declaration = declared_class(dtype, field.name)
        is_text = isinstance(dtype, T.StringType)
        measures.append(f"count({column}) AS filled_{i}")
        classed = "types" in asked and by_declaration is None and is_text
        if classed:
            measures.append(f"count_if({_NUMERIC_SQL.format(column)}) AS numeric_{i}")
            measures.append(f"count_if({_date_sql(column)}) AS dates_{i}")
        ranged = "ranges" in asked and not isinstance(dtype, _NESTED) and (by_declaration is not None or is_text)
        if ranged:
            measures += [f"min({column}) AS low_{i}", f"max({column}) AS high_{i}"]

        def side(name: str) -> str:
            return _slots(used, *_family(dtype, f"{name}_{i}")) if ranged else _slots(used, None)

        entries.append(
            f"struct({i} AS ordinal, {_literal(field.name)} AS column_name, "
            f"{_literal(dtype.simpleString().upper())} AS declared_type, {_literal(by_declaration)} AS declared_class, "
            f"filled_{i} AS filled, {f'numeric_{i}' if classed else 'CAST(NULL AS BIGINT)'} AS numeric, "
            f"{f'dates_{i}' if classed else 'CAST(NULL AS BIGINT)'} AS dates, {side('low')} AS low, {side('high')} AS high)"
        )
    if not entries:  # a table without columns still has a row count
        nothing = "CAST(NULL AS STRING)"
        entries.append(
            f"struct(CAST(NULL AS INT) AS ordinal, {nothing} AS column_name, {nothing} AS declared_type, "
            f"{nothing} AS declared_class, rows AS filled, CAST(NULL AS BIGINT) AS numeric, CAST(NULL AS BIGINT) AS dates, "
            f"{_slots(used, None)} AS low, {_slots(used, None)} AS high)"
        )
    long = df.selectExpr(*measures).selectExpr("rows", f"explode(array({', '.join(entries)})) AS c")
    return long.selectExpr(*_key_sql(db_id, table_name), "rows", "c.*")


def column_stats(tables: Tables, max_columns: int = MAX_COLUMNS, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per column: row and null counts, inferred type, and the rendered range of numeric and date columns.

    ``measures`` names what is worked out beside the counts; what is left out is null and costs nothing. Ranges need
    types, which tell whose range is shown.

    Each table is one aggregation with all its columns side by side. Types and printed ranges are worked out on
    the long form of all tables together, so the plan stays small.
    """
    asked = tuple(measures)
    if not set(asked) <= set(MEASURES) or asked == ("ranges",):
        raise ValueError(f"measures must be among {', '.join(MEASURES)}, ranges with types; not {asked!r}")
    keyed = _keyed(tables)
    used = _used_families(keyed, max_columns) or ["other"]
    raw = reduce(DataFrame.unionByName, [_raw_stats(d, n, df, max_columns, used, asked) for d, n, df in keyed])
    typed = raw.selectExpr("*", f"""
        CASE WHEN column_name IS NULL OR {"types" not in asked} THEN NULL ELSE coalesce(declared_class, CASE
          WHEN filled = 0 THEN 'unknown'
          WHEN try_divide(numeric, filled) >= {NUMERIC_SHARE} THEN 'numeric'
          WHEN try_divide(dates, filled) >= {DATE_SHARE} THEN 'date-ish'
          ELSE 'text' END) END AS inferred_type""")
    ranged = F.col("inferred_type").isin("numeric", "date-ish")
    return typed.select(
        *KEYS, "column_name", "declared_type", "inferred_type",
        F.expr("rows AS row_count"), F.expr("rows - filled AS null_count"),
        F.expr("coalesce(try_divide(rows - filled, rows), 0.0D) AS null_rate"),
        F.when(ranged, _shown("low.", used)).alias("min_value"),
        F.when(ranged, _shown("high.", used)).alias("max_value"),
    )


def long_values(tables: Tables, max_columns: int = MAX_COLUMNS, only: DataFrame | None = None) -> DataFrame:
    """Every non-null value of every column: the column's key and one typed value.

    ``only`` (db_id, table_name, ordinal), a few rows known to the driver, leaves the other columns unread.
    """
    keyed = _keyed(tables)
    used = _used_families(keyed, max_columns) or ["other"]
    wanted = None if only is None else {tuple(row) for row in only.select(*KEYS).collect()}
    parts = []
    for db_id, table_name, df in keyed:
        fields = [(i, f) for i, f in enumerate(_visible(df, max_columns)) if wanted is None or (db_id, table_name, i) in wanted]
        if not fields:
            continue
        wide = df.selectExpr(*[
            f"CASE WHEN {_name(f.name)} IS NOT NULL THEN {_slots(used, *_family(f.dataType, _name(f.name)))} END AS `{i}`"
            for i, f in fields
        ])
        long = wide.unpivot([], wide.columns, "ordinal", "value").where("value IS NOT NULL")
        parts.append(long.selectExpr(*_key_sql(db_id, table_name), "CAST(ordinal AS INT) AS ordinal", "value.*"))
    if not parts:
        raise ValueError("no columns to profile")
    return reduce(DataFrame.unionAll, parts)


def value_frequencies(tables: Tables, max_columns: int = MAX_COLUMNS, only: DataFrame | None = None) -> DataFrame:
    """Count of every distinct non-null value of every column: the column's key, one typed value, ``freq``.

    All columns of all tables go through one shuffle, with counts combined before it.
    """
    values = long_values(tables, max_columns, only)
    return values.groupBy(*values.columns).agg(F.count(F.lit(1)).alias("freq"))


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    """Distinct values per column. Reading ``freq`` keeps this branch equal to that of ``top_values``, so a plan with
    both shuffles the frequencies once."""
    return frequencies.groupBy(*KEYS).agg(F.count_if(F.col("freq") > 0).alias("distinct_count"))


def top_values(frequencies: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The ``top_k`` most frequent values per column, ties by value in its own order, rendered for print.

    The rank filter becomes a per-task limit before the shuffle, so each task sends at most k rows per column.
    """
    if top_k <= 0:
        raise ValueError("top_k must be > 0")
    used = [c for c in frequencies.columns if c in _FAMILIES]
    best = Window.partitionBy(*KEYS).orderBy(F.desc("freq"), *used)
    return (
        frequencies.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
        .select(*KEYS, "rank", "freq", _shown("", used).alias("value"))
    )


def profile_tables(tables: Tables, max_columns: int = MAX_COLUMNS, top_k: int = TOP_K) -> DataFrame:
    """Full profiles, one row per column. Sample lists hold at most ``top_k`` values.

    ``tables`` maps a table name, or a (db_id, table name) pair, to its DataFrame.
    """
    stats = column_stats(tables, max_columns)
    none = F.array().cast("array<string>")
    if not any(df.columns for df in tables.values()):
        return stats.select("*", F.lit(0).cast("bigint").alias("distinct_count"), none.alias("sample_values"))
    frequencies = value_frequencies(tables, max_columns)
    counted = distinct_counts(frequencies).select(
        *KEYS, "distinct_count", F.lit(None).cast("struct<rank:int,value:string>").alias("best"))
    best = top_values(frequencies, top_k).select(
        *KEYS, F.lit(None).cast("bigint").alias("distinct_count"), F.struct("rank", "value").alias("best"))
    # At most 1 + top_k rows per column meet here.
    found = counted.unionAll(best).groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(
        F.max("distinct_count").alias("distinct_count"),
        F.array_sort(F.collect_list("best"))["value"].alias("sample_values"),
    )
    same = F.expr("db_id <=> _db_id AND table_name = _table_name AND ordinal = _ordinal")
    return stats.join(found, same, "left").select(
        *stats.columns,
        F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
        F.coalesce("sample_values", none).alias("sample_values"),
    )
