"""Profiles, dictionary and schema text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quorumql.functions.render import render_value
from quorumql.operators import dictionary, profiling, sketches
from quorumql.session import new_folder
from quorumql.plans.stored_contexts import stored_contexts
from testbed import inputs
from testbed.registry import query

# Schemas of the profiled tables, for writing the SQL side.
INT, BIG, TEXT, REAL, TS = "INT", "BIGINT", "STRING", "DOUBLE", "TIMESTAMP_NTZ"
SCHEMAS = {
    "customer": [("c_custkey", BIG), ("c_name", TEXT), ("c_nationkey", INT), ("c_acctbal", REAL), ("c_mktsegment", TEXT)],
    "events": [("event_id", BIG), ("ts", TS), ("user_id", BIG), ("event_type", TEXT), ("value", REAL), ("props", TEXT)],
    "lineitem": [
        ("l_orderkey", BIG), ("l_partkey", BIG), ("l_suppkey", BIG), ("l_linenumber", INT), ("l_quantity", REAL),
        ("l_extendedprice", REAL), ("l_discount", REAL), ("l_tax", REAL), ("l_returnflag", TEXT),
        ("l_linestatus", TEXT), ("l_shipdate", TS)],
    "orders": [
        ("o_orderkey", BIG), ("o_custkey", BIG), ("o_orderstatus", TEXT), ("o_totalprice", REAL),
        ("o_orderdate", TS), ("o_orderpriority", TEXT)],
    "part": [
        ("p_partkey", BIG), ("p_name", TEXT), ("p_brand", TEXT), ("p_type", TEXT), ("p_size", INT),
        ("p_retailprice", REAL)],
    "supplier": [("s_suppkey", BIG), ("s_name", TEXT), ("s_nationkey", INT), ("s_acctbal", REAL)],
}
TEXT_SQL = """texts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS a_num, strftime(o_orderdate, '%Y-%m-%d') AS b_iso,
         strftime(o_orderdate, '%Y/%m/%d') AS c_slash,
         CASE WHEN o_orderkey % 10 < 8 THEN CAST(o_orderkey AS VARCHAR) ELSE 'n/a' END AS d_mix,
         nullif(o_orderstatus, o_orderstatus) AS e_null, nullif(o_orderstatus, 'F') AS f_part,
         strftime(o_orderdate, '%Y-%m-%d %H:%M') AS g_moment
  FROM orders)"""
TEXT_COLUMNS = [(c, TEXT) for c in ("a_num", "b_iso", "c_slash", "d_mix", "e_null", "f_part", "g_moment")]
PROFILED = {**SCHEMAS, "texts": TEXT_COLUMNS}


def _tables(spark, folder) -> dict[str, DataFrame]:
    found = {name: inputs.table(spark, folder, name) for name in SCHEMAS}
    return {**found, "texts": inputs.text_columns(spark, folder)}


def _stats(spark, folder, measures=profiling.MEASURES) -> DataFrame:
    return profiling.column_stats(_tables(spark, folder), measures=measures)


def _rendered(column: str, kind: str) -> str:
    if kind == TEXT:
        return f"'''' || replace({column}, '''', '''''') || ''''"
    if kind == REAL:
        return f"printf('%.6g', {column} + 0.0)"
    return f"CAST({column} AS VARCHAR)"


def _per_column(make) -> str:
    """UNION ALL of ``make(table, ordinal, column, type)`` over all profiled columns."""
    return f"WITH {TEXT_SQL} " + "\nUNION ALL ".join(
        make(t, i, c, k) for t, columns in PROFILED.items() for i, (c, k) in enumerate(columns)
    )


def _numeric(c: str) -> str:
    return f"regexp_full_match(trim({c}, ' '), '[0-9.-]*[0-9][0-9.-]*')"


def _date(c: str) -> str:
    return f"({c} LIKE '____-__-__%' OR {c} LIKE '____/__/__%' OR {c} LIKE '__/__/____%')"


def _type_sql(c: str, k: str) -> str:
    if k in (INT, BIG, REAL):
        return "any_value('numeric')"
    if k == TS or any(w in c.lower() for w in ("date", "time", "year", "month", "day")):
        return "any_value('date-ish')"
    share = lambda flag: f"count(*) FILTER (WHERE {flag}) / CAST(count({c}) AS DOUBLE)"
    return (
        f"CASE WHEN count({c}) = 0 THEN 'unknown' WHEN {share(_numeric(c))} >= 0.9 THEN 'numeric' "
        f"WHEN {share(_date(c))} >= 0.8 THEN 'date-ish' ELSE 'text' END"
    )


def _range_sql(c: str, k: str, side: str) -> str:
    return f"CASE WHEN {_type_sql(c, k)} IN ('numeric', 'date-ish') THEN {_rendered(f'{side}({c})', k)} END"


@query("profile_row_count", f"WITH {TEXT_SQL} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in PROFILED))
def _row_count(spark, folder):
    return _stats(spark, folder, ()).where("ordinal = 0").select("table_name", "row_count")


@query("profile_nulls", _per_column(lambda t, i, c, k: (
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count, "
    f"round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS null_rate FROM {t}")))
def _nulls(spark, folder):
    return _stats(spark, folder, ()).select("table_name", "column_name", "null_count", F.round("null_rate", 6).alias("null_rate"))


@query("profile_types", _per_column(lambda t, i, c, k: (
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS declared_type, {_type_sql(c, k)} AS inferred_type FROM {t}")))
def _types(spark, folder):
    return _stats(spark, folder, ("types",)).select("table_name", "column_name", "declared_type", "inferred_type")


@query("profile_minmax", _per_column(lambda t, i, c, k: (
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_range_sql(c, k, 'min')} AS min_value, "
    f"{_range_sql(c, k, 'max')} AS max_value FROM {t}")))
def _minmax(spark, folder):
    return _stats(spark, folder).select("table_name", "column_name", "min_value", "max_value")


@query("profile_distinct", _per_column(lambda t, i, c, k: (
    f"SELECT '{t}' AS table_name, {i} AS ordinal, count(DISTINCT {c}) AS distinct_count FROM {t} HAVING count({c}) > 0")))
def _distinct(spark, folder):
    return profiling.distinct_counts(profiling.value_frequencies(_tables(spark, folder))).drop("db_id")


@query("profile_topk", _per_column(lambda t, i, c, k: (
    f"SELECT * FROM (SELECT '{t}' AS table_name, {i} AS ordinal, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, "
    f"count(*) AS freq, {_rendered(c, k)} AS value FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3")))
def _topk(spark, folder):
    return profiling.top_values(profiling.value_frequencies(_tables(spark, folder)), 3).drop("db_id")


@query("profile_topk_summaries", _per_column(lambda t, i, c, k: (
    f"SELECT * FROM (SELECT '{t}' AS table_name, {i} AS ordinal, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, "
    f"count(*) AS freq, {_rendered(c, k)} AS value FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3")))
def _topk_summaries(spark, folder):
    return sketches.top_values_by_summaries(_tables(spark, folder), 3).drop("db_id")


#: The column that deals a table into parts: a month, or a value.
PARTS = {"events": ("ts", True), "lineitem": ("l_shipdate", True), "orders": ("o_orderdate", True), "customer": ("c_mktsegment", False), "part": ("p_brand", False)}


@query("profile_distinct_approx", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS ordinal, count(*) AS row_count, count({c}) AS filled, count(DISTINCT {c}) AS distinct_count, true AS abs_error_ok FROM {t}"
    for t in PARTS for i, (c, _) in enumerate(SCHEMAS[t])))
def _distinct_approx(spark, folder):
    """Sketches by part, the last part of every table added after the others; compared with exact counts."""
    place = new_folder(spark, "sketches")
    tables = {t: inputs.table(spark, folder, t) for t in PARTS}
    for name, (column, dated) in PARTS.items():
        part = F.date_format(column, "yyyy-MM") if dated else F.col(column)
        last = tables[name].agg(F.max(part)).first()[0]
        sketches.add_parts(tables[name].where(part != F.lit(last)), place, name, part)
        sketches.add_parts(tables[name], place, name, part, only=[last])
    exact = profiling.distinct_counts(profiling.value_frequencies(tables))
    both = sketches.approx_distinct(spark, place).join(exact, ["table_name", "ordinal"])
    close = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.col("distinct_count") * sketches.error_bound()
    return both.select("table_name", "ordinal", "row_count", "filled", "distinct_count", close.alias("abs_error_ok"))


_DOCUMENT_CLASSES = """SELECT lang, count(*) AS texts, count(*) FILTER (WHERE {0}) AS looking FROM (
  SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY lang"""


def _words(spark, folder) -> DataFrame:
    return inputs.table(spark, folder, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))


@query("infer_numeric_text", _DOCUMENT_CLASSES.format(_numeric("word")))
def _infer_numeric(spark, folder):
    return _words(spark, folder).groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(profiling.numeric_looking(F.col("word"))).alias("looking"))


@query("infer_date_text", _DOCUMENT_CLASSES.format(_date("word")))
def _infer_date(spark, folder):
    return _words(spark, folder).groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(profiling.date_looking(F.col("word"))).alias("looking"))


@query("render_values", """SELECT c.conv_id, c.turn,
'''' || replace(CASE WHEN length(t) > 40 THEN t[1:37] || '...' ELSE t END, '''', '''''') || '''' AS value
FROM (SELECT *, trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(13)) AS t FROM conversations) c""")
def _render_values(spark, folder):
    df = inputs.table(spark, folder, "conversations")
    return df.select("conv_id", "turn", render_value(F.col("text"), df.schema["text"].dataType).alias("value"))


@query("render_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
printf('%.6g', l_extendedprice) AS price, printf('%.6g', l_extendedprice * 1000) AS large,
printf('%.6g', l_tax / 1000) AS small FROM lineitem""")
def _render_numbers(spark, folder):
    df = inputs.table(spark, folder, "lineitem")
    real = df.schema["l_tax"].dataType
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", render_value(price, real).alias("price"),
        render_value(price * 1000, real).alias("large"), render_value(tax / 1000, real).alias("small"))


def _line_sql(t: str, i: int, c: str, k: str) -> str:
    top = (
        f"(SELECT string_agg({_rendered('v', k)}, ', ' ORDER BY n DESC, v) FROM "
        f"(SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 3))"
    )
    return (
        f"SELECT '{t}' AS table_name, {i} AS ordinal, count(*) AS n, '  - {c}: type=' || {_type_sql(c, k)} "
        f"|| printf(', null_rate=%.3f', 1 - count({c}) / CAST(count(*) AS DOUBLE)) || ', distinct=' || count(DISTINCT {c}) "
        f"|| coalesce(', min=' || {_range_sql(c, k, 'min')} || ', max=' || {_range_sql(c, k, 'max')}, '') "
        f"|| coalesce(', samples=[' || {top} || ']', '') AS line FROM {t}"
    )


def _dictionary_sql() -> str:
    return f"{TEXT_SQL}, lines AS (" + "\nUNION ALL ".join(
        _line_sql(t, i, c, k) for t, columns in PROFILED.items() for i, (c, k) in enumerate(columns)
    ) + """), dictionaries AS (
  SELECT table_name, 'TABLE ' || table_name || ' (rows=' || any_value(n) || ')' || chr(10)
         || string_agg(line, chr(10) ORDER BY ordinal) AS dictionary_text FROM lines GROUP BY table_name)"""


@query("dictionary_text", f"WITH {_dictionary_sql()} SELECT table_name, dictionary_text FROM dictionaries")
def _dictionary_text(spark, folder):
    profiles = profiling.profile_tables(_tables(spark, folder))
    return dictionary.table_dictionaries(profiles, include_samples=True).select("table_name", "dictionary_text")


@query("profile_column_cap", f"WITH {TEXT_SQL} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM {t}"
    for t, columns in PROFILED.items() for c, _ in columns[:2]))
def _column_cap(spark, folder):
    # The cap on columns is the feature; all rows are read.
    return profiling.profile_tables(_tables(spark, folder), max_columns=2).select("table_name", "column_name", "distinct_count")


# Sample rows are part of the schema text; the first column of each table orders them here, with more where it repeats.
_ORDER = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"]}
_FOREIGN_KEYS = [("orders", 0, "o_custkey", "customer", "c_custkey")]
_KEYS = [("customer", "c_custkey", True, True), ("orders", "o_orderkey", True, False), ("part", "p_name", False, True)]


def _json_value(column: str, kind: str) -> str:
    if kind == TEXT:
        return f"""'"' || replace({column}, '"', '\\"') || '"'"""
    if kind == TS:
        return f"""'"' || strftime({column}, '%Y-%m-%dT%H:%M:%S.%g') || '"'"""
    return f"CAST({column} AS VARCHAR)"


def _sample_sql(t: str) -> str:
    """The first two rows in key order, every column of them as JSON text."""
    entries = " || ',' || ".join(f"""'"{c}":' || coalesce({_json_value(c, k)}, 'null')""" for c, k in SCHEMAS[t])
    key = _ORDER[t][0]
    return f"SELECT '{t}' AS table_name, row_number() OVER (ORDER BY {key}) AS rank, '{{' || {entries} || '}}' AS row_text FROM (SELECT * FROM {t} ORDER BY {key} LIMIT 2)"


def _keyed_tables(spark, folder) -> dict[str, DataFrame]:
    return {n: inputs.table(spark, folder, n) for n in _ORDER}


@query("schema_samples", " UNION ALL ".join(
    f"SELECT table_name, CAST(rank AS INTEGER) AS rank, row_text FROM ({_sample_sql(t)})" for t in _ORDER))
def _schema_samples(spark, folder):
    return dictionary.sample_rows(_keyed_tables(spark, folder), _ORDER, 2).select("table_name", "rank", "row_text")


def _schema_sql(t: str) -> str:
    marks = {(n, c): " [" + " ".join(w for w, on in (("pk", p), ("not_null", q)) if on) + "]" for n, c, p, q in _KEYS}
    head = [f"TABLE {t}"] + [f"  - {c}: {k}{marks.get((t, c), '')}" for c, k in SCHEMAS[t][:4]]
    if len(SCHEMAS[t]) > 4:
        head.append(f"  - ... {len(SCHEMAS[t]) - 4} more columns")
    links = [f"    - {a} -> {b}.{c}" for n, _, a, b, c in _FOREIGN_KEYS if n == t]
    if links:
        head += ["  foreign_keys:", *links]
    text = " || chr(10) || ".join(f"'{line}'" for line in [*head, "  sample_rows:"])
    return (
        f"SELECT '{t}' AS table_name, {text} || chr(10) || (SELECT string_agg('    - ' || row_text, chr(10) ORDER BY rank) "
        f"FROM ({_sample_sql(t)})) AS schema_text"
    )


@query("schema_text", " UNION ALL ".join(_schema_sql(t) for t in _ORDER))
def _schema_text(spark, folder):
    tables = _keyed_tables(spark, folder)
    shown = dictionary.sample_rows(tables, _ORDER, 2)
    keys = spark.createDataFrame(
        [(None, *k) for k in _KEYS], "db_id string, table_name string, column_name string, is_pk boolean, not_null boolean")
    links = spark.createDataFrame(
        [(None, *f) for f in _FOREIGN_KEYS],
        "db_id string, table_name string, seq int, from_column string, to_table string, to_column string")
    catalog = dictionary.describe_tables(spark, tables)
    return dictionary.schema_text(catalog, 4, keys, links, shown).select("table_name", "schema_text")


_DATABASES = {"sales": ["customer", "lineitem", "orders", "part", "supplier"], "web": ["events", "texts"]}


def _plain_schema(t: str) -> str:
    return " || chr(10) || ".join(f"'{line}'" for line in [f"TABLE {t}"] + [f"  - {c}: {k}" for c, k in PROFILED[t]])


@query("db_context", f"WITH {_dictionary_sql()} " + " UNION ALL ".join(
    f"SELECT '{db}' AS db_id, {' || chr(10) || '.join(_plain_schema(t) for t in names)} AS schema_text, "
    f"(SELECT string_agg(dictionary_text, chr(10) ORDER BY table_name) FROM dictionaries "
    f"WHERE table_name IN ({', '.join(repr(t) for t in names)})) AS data_dictionary_text"
    for db, names in _DATABASES.items()))
def _db_context(spark, folder):
    tables = _tables(spark, folder)
    return dictionary.build_contexts(spark, {db: {n: tables[n] for n in names} for db, names in _DATABASES.items()})


_STORED_TABLES = {"sales": ["customer", "orders", "part", "supplier"], "web": ["events", "lineitem"]}


@query("db_context_stored", f"WITH {_dictionary_sql()} " + " UNION ALL ".join(
    f"SELECT '{db}' AS db_id, {' || chr(10) || '.join(_plain_schema(t) for t in names)} AS schema_text, "
    f"(SELECT string_agg(dictionary_text, chr(10) ORDER BY table_name) FROM dictionaries "
    f"WHERE table_name IN ({', '.join(repr(t) for t in names)})) AS data_dictionary_text"
    for db, names in _STORED_TABLES.items()))
def _db_context_stored(spark, folder):
    """The first call profiles all tables, the second finds them stored."""
    paths = {db: {t: f"{folder}/{t}.parquet" for t in names} for db, names in _STORED_TABLES.items()}
    store = new_folder(spark, "contexts")
    stored_contexts(spark, paths, store)
    return stored_contexts(spark, paths, store)
