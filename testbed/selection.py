"""Examples: reading, choosing, splitting, batching, grids, prompts, strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumql.operators import grid, prompts, selection, strategies
from quorumql.operators.positions import with_position
from quorumql.session import new_folder
from quorumql.sources.examples import read_examples
from testbed import inputs
from testbed.registry import query

EXAMPLES_SQL = """examples AS (
  SELECT o_orderkey AS "index", o_orderkey AS question_id, 'db_' || (o_custkey % 11) AS db_id,
         o_orderpriority AS question,
         CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE ' status ' || o_orderstatus || chr(10) END AS evidence,
         'SELECT ' || o_orderkey AS gold_sql, o_orderstatus AS difficulty
  FROM orders)"""
SHUFFLED_SQL = f"""{EXAMPLES_SQL},
shuffled AS (
  SELECT *, row_number() OVER (ORDER BY md5('7:' || "index"), "index") - 1 AS place FROM examples)"""

#: Records of one array file.
ARRAY_ROWS = 10_000


@query("read_examples", f"WITH {EXAMPLES_SQL} SELECT * REPLACE (coalesce(nullif(difficulty, 'P'), 'unknown') AS difficulty) FROM examples")
def _read_examples(spark, folder):
    path = new_folder(spark, "examples")
    raw = inputs.examples(spark, folder).withColumn("difficulty", F.nullif("difficulty", F.lit("P")))
    raw.withColumnRenamed("gold_sql", "SQL").write.json(path)
    return read_examples(spark, path, "jsonl")


@query("read_examples_array", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "index", o_orderkey AS question_id,
'db_' || o_custkey % 11 AS db_id, o_orderpriority AS question, 'SELECT ' || o_orderkey AS gold_sql, 'unknown' AS difficulty FROM orders""")
def _read_examples_array(spark, folder):
    # One file for each block of places, so no value grows with the table.
    path = new_folder(spark, "examples-array")
    raw = inputs.examples(spark, folder).select(
        F.col("index").alias("question_id"), "db_id", "question", "evidence", F.col("gold_sql").alias("SQL"))
    placed = with_position(raw, ["question_id"], "_place", key=["question_id"])
    blocks = placed.groupBy((F.col("_place") - F.col("_place") % ARRAY_ROWS).alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("_place", F.struct(*raw.columns).alias("record")))).alias("all"))
    blocks.select("first", F.to_json("all.record").alias("value")).write.partitionBy("first").text(path)
    return read_examples(spark, path, "json_arrays").select("index", "question_id", "db_id", "question", "gold_sql", "difficulty")


#: Signs that an array's structure is made of, and escapes, inside strings.
AWKWARD = '}, {"a\\": [1] ' + "\\"


@query("read_examples_one_array", f"""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "index", o_orderkey AS question_id,
'db_' || o_custkey % 11 AS db_id, o_orderpriority || '{AWKWARD}' || o_orderstatus AS question, '' AS evidence,
'SELECT "{{' || o_orderkey || '"' AS gold_sql, CASE WHEN o_orderkey % 2 = 0 THEN '{AWKWARD}' ELSE 'unknown' END AS difficulty FROM orders""")
def _read_examples_one_array(spark, folder):
    # All of orders as one JSON array in one file, which a single task writes record by record; many tasks sort and read it.
    path = new_folder(spark, "examples-one-array")
    orders = inputs.table(spark, folder, "orders")
    record = F.struct(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("db_"), F.col("o_custkey") % 11).alias("db_id"),
        F.concat("o_orderpriority", F.lit(AWKWARD), "o_orderstatus").alias("question"),
        F.concat(F.lit('SELECT "{'), "o_orderkey", F.lit('"')).alias("SQL"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(AWKWARD)).alias("difficulty"))
    least = orders.agg(F.min("o_orderkey")).first()[0]
    lines = orders.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") == F.lit(least), "[").otherwise(","), F.to_json(record)).alias("value"))
    end = spark.createDataFrame([(None, "]")], "o_orderkey bigint, value string")
    inputs.write_one_file(lines.unionByName(end).orderBy(F.asc_nulls_last("o_orderkey")).select("value"), path)
    return read_examples(spark, path)


@query("filter_by_db", f"WITH {EXAMPLES_SQL} SELECT \"index\", db_id FROM examples WHERE db_id = 'db_4'")
def _filter_by_db(spark, folder):
    return selection.filter_by_db(inputs.examples(spark, folder), "db_4").select("index", "db_id")


@query("slice_examples", f"""WITH {EXAMPLES_SQL}
SELECT "index", question FROM examples WHERE db_id = 'db_4' ORDER BY "index" LIMIT 500 OFFSET 100""")
def _slice_examples(spark, folder):
    # The slice is the operator under test.
    return selection.select_examples(inputs.examples(spark, folder), "db_4", 100, 500).select("index", "question")


@query("slice_strict", f"""WITH {EXAMPLES_SQL} SELECT "index", db_id FROM examples ORDER BY "index" OFFSET 2000""")
def _slice_strict(spark, folder):
    return selection.slice_strict(inputs.examples(spark, folder), 2000, 0).select("index", "db_id")


@query("seeded_shuffle", f'WITH {SHUFFLED_SQL} SELECT "index", place AS position FROM shuffled')
def _seeded_shuffle(spark, folder):
    return selection.seeded_shuffle(inputs.examples(spark, folder), seed=7).select("index", "position")


@query("train_eval_split", f"""WITH {SHUFFLED_SQL}
SELECT "index", 'train' AS split, place - 10 AS position FROM shuffled WHERE place >= 10 AND place < 910
UNION ALL
SELECT "index", 'eval' AS split, place - 800 AS position FROM shuffled WHERE place >= 800 AND place < 1200""")
def _train_eval_split(spark, folder):
    split = selection.train_eval_split(
        inputs.examples(spark, folder), train_offset=10, train_limit=900, eval_offset=800, eval_limit=400, seed=7
    )
    return selection.require_train_rows(split).select("index", "split", "position")


@query("batch_assign", f"""WITH {SHUFFLED_SQL}
SELECT "index", CAST(floor(place / 16) AS BIGINT) AS batch_index, place % 16 AS group_index FROM shuffled""")
def _batch_assign(spark, folder):
    shuffled = selection.seeded_shuffle(inputs.examples(spark, folder), seed=7)
    return selection.assign_batches(shuffled, 16).select("index", "batch_index", "group_index")


@query("batch_counts", f"""WITH {EXAMPLES_SQL}
SELECT db_id, count(*) AS num_groups, CAST(ceil(count(*) / 16.0) AS BIGINT) AS num_batches FROM examples GROUP BY db_id""")
def _batch_counts(spark, folder):
    return selection.count_batches(inputs.examples(spark, folder), 16, ["db_id"])


@query("group_replicate", f"""WITH {EXAMPLES_SQL}
SELECT "index", CAST(r AS INTEGER) AS rollout_index FROM examples, range(4) t(r)""")
def _group_replicate(spark, folder):
    return selection.replicate(inputs.examples(spark, folder).select("index"), 4)


@query("distinct_dbs", f"WITH {EXAMPLES_SQL} SELECT DISTINCT db_id FROM examples")
def _distinct_dbs(spark, folder):
    return selection.distinct_dbs(inputs.examples(spark, folder))


@query("preview_counts", f"""WITH {EXAMPLES_SQL}
SELECT db_id, count(*) AS num_examples, 1 AS num_databases FROM examples GROUP BY db_id
UNION ALL SELECT NULL, count(*), count(DISTINCT db_id) FROM examples""")
def _preview_counts(spark, folder):
    return selection.preview(inputs.examples(spark, folder))


GRID = {"learning_rate": ["1e-05", "3e-05"], "group_size": [8, 16], "temperature": ["0.8", "1.0"]}
GRID_SQL = """grid AS (
  SELECT p_partkey, p_brand, lr.v AS learning_rate, gs.v AS group_size, te.v AS temperature,
         lr.i * 4 + gs.i * 2 + te.i AS arm_index
  FROM part, (VALUES (0, '1e-05'), (1, '3e-05')) lr(i, v), (VALUES (0, 8), (1, 16)) gs(i, v),
       (VALUES (0, '0.8'), (1, '1.0')) te(i, v))"""


def _grid(spark, folder):
    base = inputs.table(spark, folder, "part").select("p_partkey", "p_brand", F.col("p_size").alias("group_size"))
    return grid.config_grid(base, GRID)


@query("config_grid", f"WITH {GRID_SQL} SELECT * FROM grid")
def _config_grid(spark, folder):
    return _grid(spark, folder)


@query("config_tag", f"""WITH {GRID_SQL} SELECT p_partkey, arm_index,
'lr' || learning_rate || '_gs' || group_size || '_t' || temperature || '_p_br' || p_brand AS tag FROM grid""")
def _config_tag(spark, folder):
    tag = grid.config_tag([*GRID, "p_brand"])
    return _grid(spark, folder).select("p_partkey", "arm_index", tag.alias("tag"))


@query("gold_oracle", f"""WITH {EXAMPLES_SQL}
SELECT "index", CAST(s AS INTEGER) AS sample_index, gold_sql AS sql, 0.0::DOUBLE AS latency_s FROM examples, range(2) t(s)""")
def _gold_oracle(spark, folder):
    return strategies.strategy("gold_oracle")(inputs.examples(spark, folder), samples=2).select(
        "index", "sample_index", "sql", "latency_s"
    )


@query("stored_generations", f"""WITH {EXAMPLES_SQL},
stored AS (
  SELECT l_orderkey AS idx, l_linenumber - 1 AS s, max(l_suppkey) AS n, max(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2)
SELECT "index", CAST(r AS INTEGER) AS sample_index,
       CASE WHEN n IS NULL OR n % 5 = 0 THEN '' ELSE 'SELECT ' || n END AS sql,
       CASE WHEN n IS NULL THEN 'no generation was stored for this sample' WHEN n % 5 = 0 THEN 'failed' END AS generation_error,
       nullif(n % 3, 0) AS prompt_tokens, q AS latency_s
FROM examples CROSS JOIN range(3) t(r) LEFT JOIN stored ON idx = "index" AND s = r""")
def _stored_generations(spark, folder):
    n = F.col("n")
    stored = (
        inputs.table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("index"), (F.col("l_linenumber") - 1).alias("sample_index"))
        .agg(F.max("l_suppkey").alias("n"), F.max("l_quantity").alias("latency_s"))
        .select(
            "index", "sample_index", "latency_s", F.concat(F.lit("SELECT "), n.cast("string")).alias("sql"),
            F.lit("").alias("raw_output"), F.when(n % 5 == 0, F.lit("failed")).alias("generation_error"),
            F.lit(0).alias("query_tool_calls"), (n % 3).alias("prompt_tokens"),
            F.lit(0).alias("completion_tokens"), F.lit(0).alias("total_tokens"),
        )
    )
    made = strategies.strategy("single_shot")(inputs.examples(spark, folder), stored, samples=3)
    return made.select("index", "sample_index", "sql", "generation_error", "prompt_tokens", "latency_s")


_USER_SQL = (
    "'Engine:' || chr(10) || 'Spark SQL' || chr(10) || chr(10) || 'Schema:' || chr(10) || 'tables of ' || db_id "
    "|| chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Instructions:' || chr(10) || '"
    + prompts.INSTRUCTIONS
    + "' || CASE WHEN trim(evidence) <> '' THEN chr(10) || chr(10) || 'Evidence:' || chr(10) || 'status ' || difficulty ELSE '' END "
    "|| chr(10) || chr(10) || 'Data dictionary:' || chr(10) || 'examples=' || n || chr(10) || chr(10) || '"
    + prompts.TOOL_NOTE + "'"
)


@query("build_prompts", f"""WITH {EXAMPLES_SQL}, counted AS (SELECT db_id, count(*) AS n FROM examples GROUP BY db_id)
SELECT "index", '{prompts.system_message(True)}' AS system_text, {_USER_SQL} AS user_text
FROM examples JOIN counted USING (db_id)""")
def _build_prompts(spark, folder):
    questions = inputs.examples(spark, folder)
    contexts = questions.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).select(
        "db_id", F.concat(F.lit("tables of "), "db_id").alias("schema_text"),
        F.concat(F.lit("examples="), F.col("n").cast("string")).alias("data_dictionary_text"),
    )
    made = prompts.build_prompts(questions, contexts, include_evidence=True, with_tool=True)
    return made.select(
        "index", F.col("messages")[0]["content"].alias("system_text"), F.col("messages")[1]["content"].alias("user_text")
    )
