"""Summaries of columns: top values with proof, and approximate distinct counts by part, against exact counts."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quorumql.operators import profiling, sketches
from quorumql.operators.sketches import add_parts, approx_distinct, error_bound, top_values_by_summaries


def rows_of(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def skewed(spark, n=30_000):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("unique"),  # no favourite: not proven
        F.when(k % 3 == 0, "often").when(k % 7 == 0, "less").when(k % 11 == 0, "rare").otherwise(F.concat(F.lit("x"), k)).alias("favourites"),
        (k % 2).cast("int").alias("few"), F.when(k % 5 == 0, F.lit(None)).otherwise(k % 900).alias("ties"),
        F.when(k % 10 < 3, 0.0).when(k % 10 < 5, -0.0).when(k % 10 < 7, F.lit(2.5)).otherwise(k / 7).alias("doubles"),
        F.lit(None).cast("string").alias("nothing"), (k % 4 == 0).alias("flag"),
        F.expr("date_add(DATE'2020-01-01', cast(pow(rand(3), 4) * 4000 AS int))").alias("day"),
        (F.when(k % 9 < 4, 12).otherwise(k) / 4).cast("decimal(12,2)").alias("money"),
        F.when(k % 9 < 4, F.lit("1" * 30)).when(k % 9 < 8, "9").otherwise("-5.5").cast("decimal(38,2)").alias("wide"))


def test_top_values_by_summaries_equal_full_counts(spark):
    tables = {"skewed": skewed(spark).repartition(5), "tiny": spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, y string"),
              "empty": spark.createDataFrame([], "z int")}
    for k in (1, 3, 7):
        assert rows_of(top_values_by_summaries(tables, k)) == rows_of(profiling.top_values(profiling.value_frequencies(tables), k))
    with pytest.raises(ValueError, match="top_k"):
        top_values_by_summaries(tables, 0)


def test_only_candidates_are_shuffled(spark, monkeypatch):
    counted_in_full = []
    real = sketches.value_frequencies
    monkeypatch.setattr(sketches, "value_frequencies", lambda *a, **b: counted_in_full.append(sorted(r.ordinal for r in a[2].collect())) or real(*a, **b))
    table = {"t": skewed(spark).select("favourites", "few", "day", "unique")}
    found = sketches.summaries(table).collect()
    assert all(len(r["items"]) <= sketches.MAP_SIZE // 7 for r in found)
    top_values_by_summaries(table, 2).collect()
    assert counted_in_full == [[3]]  # 'unique' has no favourite; the other columns are proven without a full count
    plan = sketches._counted(table, 80, sketches.summaries(table).select(*profiling.KEYS, F.explode("items").alias("v")).select(*profiling.KEYS, "v.*"),
                             ["whole", "day", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan


def test_wide_decimals_sort_by_value(spark):
    values = ["9", "10", "-3.25", "-3.75", "1" * 30 + ".5", "2" * 30, None]
    df = spark.createDataFrame([(Decimal(v) if v else None,) for v in values], "d decimal(38,2)")
    top = profiling.top_values(profiling.value_frequencies({"t": df}), 6).orderBy("rank").collect()
    assert [r.value for r in top] == ["-3.75", "-3.25", "9.00", "10.00", "1" * 30 + ".50", "2" * 30 + ".00"]
    stats = profiling.column_stats({"t": df}).collect()[0]
    assert (stats.min_value, stats.max_value) == ("-3.75", "2" * 30 + ".00")


def test_sketches_unite_and_parts_are_replaced(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(20_000), f"v{rng.randrange(50)}", rng.choice([None, 0.0, -0.0, 1.5]), Decimal(i), f"d{i % 4}") for i in range(40_000)]
    df = spark.createDataFrame(rows, "n long, word string, real double, wide decimal(38,2), part string")
    exact = {r.ordinal: r.distinct_count for r in profiling.distinct_counts(profiling.value_frequencies({"t": df})).collect()}
    folder = str(tmp_path / "sketches")
    assert approx_distinct(spark, folder).count() == 0
    for parts in (["d0"], ["d1", "d2"], ["d3"]):
        add_parts(df, folder, "t", "part", only=parts)
    add_parts(df.where("part = 'd2' AND n < 100"), folder, "t", "part")  # a part that has changed since
    add_parts(df, folder, "t", "part", only=["d2"])  # and back
    add_parts(df.limit(10).withColumn("part", F.lit(None).cast("string")), folder, "other", "part")
    found = {(r.table_name, r.ordinal): r for r in approx_distinct(spark, folder).collect()}
    for i, n in exact.items():
        r = found["t", i]
        assert abs(r.distinct_estimate - n) <= n * error_bound() and r.row_count == 40_000
    assert found["t", 2].distinct_estimate == 2 and found["t", 1].distinct_estimate == 50 and found["other", 0].row_count == 10
    one = {r.ordinal: r for r in approx_distinct(spark, folder, ["d1"]).collect()}
    assert one[3].row_count == 10_000 and abs(one[3].distinct_estimate - 10_000) <= 10_000 * error_bound()


def test_adding_a_part_reads_that_part_only(spark, tmp_path):
    source = str(tmp_path / "table")
    spark.range(1000).selectExpr("id", "id % 10 AS day").write.partitionBy("day").parquet(source)
    chosen = spark.read.parquet(source).where(F.col("day").isin([3]))
    made = sketches.part_sketches(chosen, "t", "day")
    assert "PartitionFilters: [isnotnull(day" in made._jdf.queryExecution().executedPlan().toString()
    assert len(chosen.inputFiles()) > 0 and made.count() == 2
