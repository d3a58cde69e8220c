import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from quorumql.operators import dictionary, profiling


def profile(spark, rows, schema, **kwargs):
    df = spark.createDataFrame(rows, schema)
    return {r.column_name: r for r in profiling.profile_tables({"t": df}, **kwargs).collect()}


def test_type_ladder(spark):
    rows = [(str(i), "2024-01-01", "2024-01-01 10:00", str(i) if i < 8 else "x", None, b"a", [i], True, Decimal("1.50"), datetime.date(2024, 1, 2))
            for i in range(10)]
    found = profile(spark, rows, "a string, b string, c string, d string, e string, f binary, g array<int>, h boolean, i decimal(10,2), j date")
    assert {k: v.inferred_type for k, v in found.items()} == {
        "a": "numeric", "b": "numeric", "c": "date-ish", "d": "text", "e": "unknown", "f": "text", "g": "text",
        "h": "numeric", "i": "numeric", "j": "date-ish"}
    assert found["a"].min_value == "'0'" and found["a"].max_value == "'9'" and found["d"].min_value is None
    assert found["e"].null_rate == 1.0 and found["e"].distinct_count == 0 and found["e"].sample_values == []
    assert found["i"].sample_values == ["1.5"] and found["h"].sample_values == ["1"] and found["j"].min_value == "2024-01-02"
    assert found["g"].distinct_count == 10 and found["f"].sample_values == ["61"]


def test_shares_at_the_threshold(spark):
    rows = [("1" if i < 9 else "x", "2024/01/01" if i < 8 else "x") for i in range(10)]
    found = profile(spark, rows, "p string, q string")
    assert found["p"].inferred_type == "numeric" and found["q"].inferred_type == "date-ish"


def test_names_that_read_like_dates(spark):
    found = profile(spark, [("x", "x", "x", 1)], "updated string, holiday string, plain string, birthday int")
    assert [found[c].inferred_type for c in ("updated", "holiday", "plain", "birthday")] == ["date-ish", "date-ish", "text", "numeric"]
    assert profiling.declared_class(T.ArrayType(T.IntegerType()), "x") is None


def test_samples_order_typed_and_with_a_hot_value(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(-F.col("id")).alias("n"),
        F.when(F.col("id") < 2, F.lit(-505.97)).when(F.col("id") < 4, F.lit(-35.84)).otherwise(F.lit(None)).alias("r"))
    found = {r.column_name: r for r in profiling.profile_tables({"t": df}).collect()}
    assert found["n"].sample_values == ["7", "-2999", "-2998"] and found["n"].distinct_count == 2001
    assert found["r"].sample_values == ["-505.97", "-35.84"]


def test_odd_names_and_empty_tables(spark):
    df = spark.createDataFrame([("v",)], "`we'ird`` na.me\\` string")
    found = profiling.profile_tables({"it's": df, ("db", "empty"): df.where("false")}).collect()
    assert {(r.db_id, r.table_name, r.row_count, r.null_rate) for r in found} == {(None, "it's", 1, 0.0), ("db", "empty", 0, 0.0)}
    assert {r.column_name for r in found} == {df.columns[0]}


def test_checks(spark):
    df = spark.range(1)
    for bad in ({"max_columns": 0}, {"top_k": 0}):
        with pytest.raises(ValueError):
            profiling.profile_tables({"t": df}, **bad)
    with pytest.raises(ValueError):
        profiling.check_mode("all")
    with pytest.raises(ValueError):
        profiling.profile_tables({})


def test_dictionary_and_contexts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b's")], "n int, s string")
    profiles = profiling.profile_tables({"t": df})
    text = dictionary.dictionary_text(profiles).collect()[0].data_dictionary_text
    assert text == (
        "TABLE t (rows=3)\n  - n: type=numeric, null_rate=0.333, distinct=2, min=1, max=2, samples=[1, 2]\n"
        "  - s: type=text, null_rate=0.000, distinct=2, samples=['a', 'b''s']")
    assert "samples" not in dictionary.dictionary_text(profiles, False).collect()[0].data_dictionary_text
    contexts = {r.db_id: r for r in dictionary.build_contexts(spark, {"one": {"t": df}, "two": {"u": df, "t": df}}).collect()}
    assert contexts["one"].schema_text == "TABLE t\n  - n: INT\n  - s: STRING"
    assert contexts["two"].schema_text.startswith("TABLE t\n") and "TABLE u (rows=3)" in contexts["two"].data_dictionary_text
    assert dictionary.build_contexts(spark, {"one": {"t": df}}, mode="off").collect()[0].data_dictionary_text is None


def test_schema_text_of_a_table_without_columns(spark):
    bare = spark.createDataFrame([()], T.StructType([]))
    catalog = dictionary.describe_tables(spark, {"bare": bare})
    assert dictionary.schema_text(catalog).collect()[0].schema_text == "TABLE bare\n  columns: <none>"


def test_profiling_runs_a_fixed_number_of_scans(spark, folder):
    """One scan for the counts and one for the frequencies, whatever the number of columns."""
    for table in ("region", "lineitem"):
        plan = profiling.profile_tables({table: spark.read.parquet(f"{folder}/{table}.parquet")})
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") == 3  # the frequencies feed both distinct counts and top values
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text


def test_chosen_measures_alone_are_in_the_plan(spark, folder):
    tables = {"orders": spark.read.parquet(f"{folder}/orders.parquet")}
    counts = profiling.column_stats(tables, measures=())
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan and "RLIKE" not in plan and "max(" not in plan
    row = counts.first()
    assert row.row_count == tables["orders"].count() and row.inferred_type is None and row.min_value is None
    types = profiling.column_stats(tables, measures=("types",)).where("column_name = 'o_totalprice'").first()
    assert types.inferred_type == "numeric" and types.max_value is None
    with pytest.raises(ValueError, match="measures"):
        profiling.column_stats(tables, measures=("ranges",))


def test_frequencies_are_shuffled_once(spark, folder):
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("nation", "region")}
    profiles = profiling.profile_tables(tables)
    profiles.collect()
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
