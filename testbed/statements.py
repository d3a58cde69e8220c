"""The gold-query pack: each query by itself, and the whole pack run and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumql.operators import compare
from quorumql.operators.statements import run_statements
from quorumql.plans.gold_pack import PACK, VARIANTS, gold_pack, register_tables
from quorumql.session import freeze
from testbed.registry import query


def _portable(sql: str) -> str:
    """The one function the two dialects name differently."""
    return sql.replace("get_json_object(props, '$.k')", "regexp_extract(props, '[0-9]+')")


def _gold_query(gold):
    def run(spark, folder):
        register_tables(spark, folder)
        return spark.sql(gold.gold)

    return run


for _gold in PACK:
    query(f"gq_{_gold.query_id}", _portable(_gold.gold))(_gold_query(_gold))


def _count(sql: str) -> str:
    return f"(SELECT count(*) FROM ({_portable(sql)}))"


@query("run_sql_capped", " UNION ALL ".join(
    f"SELECT '{g.query_id}' AS query_id, '{v}' AS variant, {str(v != 'failing').lower()} AS ran, "
    + (f"least({_count(getattr(g, v))}, 20) AS row_count, {_count(getattr(g, v))} > 20 AS truncated"
       if v != "failing" else "NULL AS row_count, false AS truncated")
    for g in PACK for v in VARIANTS))
def _run_sql_capped(spark, folder):
    # The row cap is the operator under test.
    register_tables(spark, folder)
    executions, _ = run_statements(gold_pack(spark), max_rows=20, timeout_s=600)
    return executions.select("query_id", "variant", F.col("error").isNull().alias("ran"), "row_count", "truncated")


@query("exec_match_pack", " UNION ALL ".join(
    f"SELECT '{g.query_id}' AS query_id, '{v}' AS variant, {str(v != 'failing').lower()} AS executable, "
    f"{str(v == 'equivalent').lower()} AS exec_match, {_count(g.gold)} AS gold_rows"
    for g in PACK for v in VARIANTS if v != "gold"))
def _exec_match_pack(spark, folder):
    register_tables(spark, folder)
    executions, results = run_statements(gold_pack(spark), timeout_s=600)
    keys = ["query_id", "variant"]
    variants = executions.where(F.col("variant") != "gold")
    # Written once, so that Spark knows how small it is: a shuffle by query would bring all its gold rows into one task.
    pairs = freeze(variants.select(*keys), "variants")

    def per_variant(df):
        """Gold side of every variant."""
        return df.where(F.col("variant") == "gold").drop("variant").join(pairs, "query_id")

    gold = per_variant(executions).select(*keys, "error", "row_count")
    matches = compare.multiset_match(
        results.where(F.col("variant") != "gold"), per_variant(results).select(*keys, "row_pos", "cells"), keys)
    judged = compare.execution_match(variants, gold, matches, keys)
    return judged.join(variants, keys).join(gold.withColumnRenamed("row_count", "gold_rows").drop("error"), keys).select(
        *keys, F.col("error").isNull().alias("executable"), "exec_match", "gold_rows")


_PARITY_PACK = (
    "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "SELECT max(o_orderkey) FROM orders",
)


@query("run_sql_per_database", " UNION ALL ".join(
    f"""SELECT 'db_{d}' AS db_id, {i} AS statement, count(*) AS row_count, CAST(sum(length(v)) AS BIGINT) AS text_length
    FROM (WITH orders AS (SELECT * FROM main.orders WHERE o_orderkey % 2 = {p})
          SELECT {cells} AS v FROM ({sql}) q)"""
    for d, p in (("a", 0), ("b", 1)) for i, (sql, cells) in enumerate(zip(_PARITY_PACK, (
        "o_orderstatus || n || customers", "CAST(o_orderkey AS VARCHAR) || o_custkey", "CAST(\"max(o_orderkey)\" AS VARCHAR)")))))
def _run_sql_per_database(spark, folder):
    """The same texts over two databases whose table of one name holds different rows."""
    def session(name):
        own = spark.newSession()
        parity = {"db_a": 0, "db_b": 1}[name]
        own.read.parquet(f"{folder}/orders.parquet").where(F.col("o_orderkey") % 2 == parity).createOrReplaceTempView("orders")
        return own

    rows = [(db, i, sql) for db in ("db_a", "db_b") for i, sql in enumerate(_PARITY_PACK)]
    statements = spark.createDataFrame(rows, "db_id string, statement int, sql string")
    _, results = run_statements(statements, timeout_s=600, database="db_id", sessions=session)
    values = F.concat_ws("", F.transform("cells", lambda c: F.substring(c, F.lit(3), F.length(c))))
    return results.groupBy("db_id", "statement").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.length(values)).alias("text_length"))
