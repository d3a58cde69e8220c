"""Executing, comparing, voting, recording and summarising."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quorumql.functions.cells import canonical_cells
from quorumql.operators import compare, metrics, voting
from quorumql.operators.positions import with_group_position
from quorumql.operators.runs import RunSettings, full_records, with_run_fields
from quorumql.operators.sweeps import sweep_metrics
from quorumql.plans.evaluation import evaluate
from quorumql.session import new_folder
from quorumql.sources import records
from quorumql.streaming import progress
from testbed import inputs
from testbed.registry import query

# Samples as SQL sees them: what a sample returned is named by ``outcome`` instead of hashed.
SAMPLES_SQL = """events_k AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
samples AS (
  SELECT user_id AS idx, event_id AS sample_index, value AS latency_s, k, event_type,
         k % 9 AS query_tool_calls, k AS prompt_tokens, nullif(k % 5, 0) AS completion_tokens,
         CASE WHEN k % 2 = 1 THEN k + k % 5 + 1 END AS total_tokens,
         CASE WHEN k % 17 = 0 THEN 'timeout' WHEN k % 17 = 1 THEN '' END AS generation_error,
         CASE WHEN event_type = 'error' THEN 'boom' END AS error,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'none' WHEN 'purchase' THEN 'p' || k % 3
              ELSE 'c' || k % 3 END AS outcome
  FROM events_k),
groups AS (
  SELECT idx, outcome, count(*) AS group_size, min(sample_index) AS first_sample FROM samples GROUP BY ALL),
best AS (
  SELECT idx, max(group_size) AS vote_size, count(*) AS distinct_results, CAST(sum(group_size) AS BIGINT) AS samples FROM groups GROUP BY idx),
votes AS (
  SELECT b.*, min(g.first_sample) AS selected_sample, count(*) AS tied_winners, vote_size / CAST(samples AS DOUBLE) AS vote_fraction
  FROM best b JOIN groups g ON g.idx = b.idx AND g.group_size = b.vote_size GROUP BY ALL),
gold AS (
  SELECT DISTINCT user_id AS idx, CASE WHEN user_id % 29 = 0 THEN 'gold failed' END AS gold_error,
         CASE user_id % 4 WHEN 3 THEN 'none' WHEN 2 THEN 'p' || user_id % 3 ELSE 'c' || user_id % 3 END AS gold_outcome
  FROM events),
rollup AS (
  SELECT idx, CAST(sum(query_tool_calls) AS BIGINT) AS query_tool_calls,
         CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens,
         CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens,
         CAST(sum(coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))) AS BIGINT) AS total_tokens,
         round(sum(latency_s), 4) AS total_latency_s,
         count(*) FILTER (WHERE generation_error <> '') AS num_generation_errors
  FROM samples GROUP BY idx),
records AS (
  SELECT v.idx, 'db_' || v.idx % 7 AS db_id,
         CASE v.idx % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty,
         v.selected_sample, v.vote_size, v.vote_fraction, v.tied_winners, v.distinct_results, v.samples,
         s.error, s.error IS NULL AS executable, s.k % 2 = 0 AS exact_match,
         s.error IS NULL AND g.gold_error IS NULL AND s.outcome = g.gold_outcome AS exec_match,
         CASE WHEN s.error IS NULL THEN CASE s.event_type WHEN 'signup' THEN 0 ELSE 2 END END AS row_count,
         g.gold_error, CASE WHEN g.gold_error IS NULL THEN CASE v.idx % 4 WHEN 3 THEN 0 ELSE 2 END END AS gold_row_count,
         s.generation_error, s.latency_s, r.query_tool_calls, r.prompt_tokens, r.completion_tokens, r.total_tokens,
         r.total_latency_s, r.num_generation_errors
  FROM votes v JOIN samples s ON s.idx = v.idx AND s.sample_index = v.selected_sample
  JOIN gold g ON g.idx = v.idx JOIN rollup r ON r.idx = v.idx
  UNION ALL
  SELECT -1 - c_custkey, 'db_' || c_custkey % 7, 'unanswered', NULL, NULL, NULL, NULL, NULL, 0, 'Empty SQL output', false, false,
         false, NULL, NULL, 2, NULL, NULL, 0, 0, 0, 0, 0, 0
  FROM customer)"""


def _evaluation(spark, folder):
    unanswered = inputs.unanswered(spark, folder)
    gold = inputs.gold(spark, folder).unionByName(unanswered.select(
        "index", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("elapsed_s"), F.lit(2).cast("bigint").alias("row_count")))
    return evaluate(
        inputs.users(spark, folder).unionByName(unanswered), inputs.samples(spark, folder), inputs.sample_results(spark, folder),
        gold, inputs.gold_results(spark, folder),
    )


def _keyed(spark, folder):
    return voting.vote_keys(inputs.samples(spark, folder), inputs.sample_results(spark, folder))


# ---- comparing -------------------------------------------------------------------------------------------------

_ORDER_ROWS_SQL = """gold_rows AS (
  SELECT l_orderkey AS idx, l_linenumber AS pos, l_partkey AS a, round(l_extendedprice, 6) AS b FROM lineitem),
pred_rows AS (
  SELECT l_orderkey AS idx, l_linenumber AS pos, l_partkey AS a,
         round(CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice + 1 WHEN l_orderkey % 13 = 0 THEN l_extendedprice + 1e-9
                    ELSE l_extendedprice END, 6) AS b
  FROM lineitem, range(2) t(copy)
  WHERE copy = 0 OR (l_orderkey % 11 = 0 AND l_linenumber = 1)),
signed AS (SELECT *, 1 AS w FROM pred_rows UNION ALL SELECT *, -1 AS w FROM gold_rows)"""


def _match_sql(group: str) -> str:
    return (
        f'WITH {_ORDER_ROWS_SQL} SELECT idx AS "index", max(abs(d)) = 0 AS rows_match '
        f"FROM (SELECT idx, sum(w) AS d FROM signed GROUP BY idx, {group}) GROUP BY idx"
    )


@query("result_match_unordered", _match_sql("a, b"))
def _match_unordered(spark, folder):
    return compare.multiset_match(inputs.order_results(spark, folder, "pred"), inputs.order_results(spark, folder, "gold"))


@query("result_match_fingerprint", _match_sql("a, b"))
def _match_fingerprint(spark, folder):
    runs = inputs.order_runs(spark, folder)
    matched = compare.fingerprint_match(
        runs, inputs.order_results(spark, folder, "pred"), runs, inputs.order_results(spark, folder, "gold"), samples=())
    return matched.withColumnRenamed("exec_match", "rows_match")


@query("result_match_ordered", """WITH placed AS (
  SELECT o_custkey AS idx, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p,
         row_number() OVER (PARTITION BY o_custkey
           ORDER BY CASE WHEN o_custkey % 5 < 2 THEN o_totalprice ELSE 0 END, o_orderkey) AS q FROM orders)
SELECT idx AS "index", bool_and(p = q) AS rows_match FROM placed GROUP BY idx""")
def _match_ordered(spark, folder):
    orders = inputs.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("index"), "o_orderkey",
        F.when(F.col("o_custkey") % 5 < 2, F.col("o_totalprice")).otherwise(0.0).alias("by_price"))

    def side(order):
        placed = with_group_position(orders, ["index"], order, "row_pos")
        return placed.select("index", "row_pos", canonical_cells(placed, ["o_orderkey"]).alias("cells"))

    return compare.multiset_match(side(["by_price", "o_orderkey"]), side(["o_orderkey"]), ordered=True)


_CELL_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'd:' || l_quantity::BIGINT AS quantity,
  'd:' || rtrim(rtrim(CAST(CAST(l_extendedprice AS DECIMAL(18, 6)) AS VARCHAR), '0'), '.') AS price,
  's:' || l_returnflag AS flag, CASE WHEN l_tax > 0.02 THEN 'd:' || rtrim(rtrim(CAST(CAST(l_tax AS DECIMAL(18, 6)) AS VARCHAR), '0'), '.') END AS tax,
  's:' || CAST(l_shipdate AS VARCHAR) AS shipped, CASE WHEN l_discount > 0.05 THEN 'd:1' ELSE 'd:0' END AS cheap FROM lineitem"""


@query("canonical_cells", _CELL_SQL)
def _canonical_cells(spark, folder):
    df = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"), "l_shipdate", (F.col("l_discount") > 0.05).alias("cheap"))
    cells = canonical_cells(df, ["l_quantity", "l_extendedprice", "l_returnflag", "tax", "l_shipdate", "cheap"])
    names = ["quantity", "price", "flag", "tax", "shipped", "cheap"]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[cells[i].alias(n) for i, n in enumerate(names)])


@query("exec_match", f'WITH {SAMPLES_SQL} SELECT idx AS "index", exec_match FROM records')
def _exec_match(spark, folder):
    return _evaluation(spark, folder).predictions.select("index", "exec_match")


@query("exec_match_all_samples", f"""WITH {SAMPLES_SQL}
SELECT idx AS "index", sample_index, outcome = gold_outcome AND gold_error IS NULL AS exec_match FROM samples JOIN gold USING (idx)""")
def _exec_match_all(spark, folder):
    return _all_samples(spark, folder)


def _all_samples(spark, folder):
    return compare.fingerprint_match(
        inputs.samples(spark, folder), inputs.sample_results(spark, folder), inputs.gold(spark, folder), inputs.gold_results(spark, folder))


@query("empty_sql_error", """SELECT event_id, CASE WHEN event_type = 'click' THEN coalesce(
    CASE WHEN event_id % 2 = 0 THEN 'no answer' END, 'Empty SQL output')
  WHEN event_type = 'error' THEN 'boom' END AS error FROM events""")
def _empty_sql_error(spark, folder):
    events = inputs.table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "click", F.lit("SELECT 1")).otherwise(F.lit("")).alias("sql"),
        F.when(F.col("event_id") % 2 == 0, F.lit("no answer")).otherwise(F.lit("")).alias("generation_error"),
        F.when(F.col("event_type") == "error", F.lit("boom")).alias("error"))
    return compare.with_empty_sql_error(events).select("event_id", "error")


@query("executable_flag", f"""WITH {SAMPLES_SQL} SELECT idx AS "index", sample_index, error IS NULL AS executable,
CAST(CASE WHEN error IS NULL THEN CASE event_type WHEN 'signup' THEN 0 ELSE 2 END END AS BIGINT) AS row_count FROM samples""")
def _executable_flag(spark, folder):
    return compare.prediction_status(inputs.samples(spark, folder)).select("index", "sample_index", "executable", "row_count")


# ---- voting ----------------------------------------------------------------------------------------------------


@query("vote_key", f"""WITH {SAMPLES_SQL} SELECT s.idx AS "index", s.sample_index, g.first_sample, g.group_size
FROM samples s JOIN groups g ON g.idx = s.idx AND g.outcome = s.outcome""")
def _vote_key(spark, folder):
    # Keys are hashes; what has to agree is which samples share one.
    keyed = _keyed(spark, folder)
    return keyed.join(voting.vote_groups(keyed), ["index", "vote_key"]).select(
        "index", "sample_index", "first_sample", "group_size")


@query("vote_key_audit", """SELECT user_id AS "index", count(*) AS disagreements FROM events
WHERE event_type = 'never' GROUP BY user_id UNION ALL SELECT -1, count(*) FROM events""")
def _vote_key_audit(spark, folder):
    keyed = _keyed(spark, folder)
    found = voting.audit_vote_keys(keyed, inputs.sample_results(spark, folder))
    checked = keyed.agg(F.lit(-1).cast("bigint").alias("index"), F.count(F.lit(1)).alias("disagreements"))
    return found.groupBy("index").agg(F.count(F.lit(1)).alias("disagreements")).unionByName(checked)


@query("majority_vote", f'WITH {SAMPLES_SQL} SELECT idx AS "index", selected_sample, vote_size FROM votes')
def _majority_vote(spark, folder):
    return voting.majority_vote(_keyed(spark, folder)).select("index", "selected_sample", "vote_size")


@query("vote_stats", f"""WITH {SAMPLES_SQL} SELECT idx AS "index", vote_size, round(vote_fraction, 6) AS vote_fraction,
tied_winners, distinct_results, samples FROM votes""")
def _vote_stats(spark, folder):
    return voting.majority_vote(_keyed(spark, folder)).select(
        "index", "vote_size", F.round("vote_fraction", 6).alias("vote_fraction"), "tied_winners", "distinct_results", "samples")


@query("sample_details", f"""WITH {SAMPLES_SQL} SELECT s.idx AS "index", s.sample_index, g.group_size,
g.first_sample = v.selected_sample AS selected_by_vote, s.k % 2 = 0 AS exact_match, s.error, s.query_tool_calls
FROM samples s JOIN groups g ON g.idx = s.idx AND g.outcome = s.outcome JOIN votes v ON v.idx = s.idx""")
def _sample_details(spark, folder):
    keyed = _keyed(spark, folder).join(inputs.users(spark, folder).select("index", "gold_sql"), "index")
    details = voting.sample_details(keyed, voting.majority_vote(keyed))
    return details.select(
        "index", "sample_index", "group_size", "selected_by_vote", "exact_match", "error", "query_tool_calls")


@query("question_rollup", f'WITH {SAMPLES_SQL} SELECT * EXCLUDE (idx), idx AS "index" FROM rollup')
def _question_rollup(spark, folder):
    rolled = voting.question_rollup(inputs.samples(spark, folder))
    return rolled.withColumn("total_latency_s", F.round("total_latency_s", 4))


_RECORD_COLUMNS = {
    "index": "idx", "db_id": "db_id", "difficulty": "difficulty",
    "self_consistency_selected_sample_index": "selected_sample", "self_consistency_vote_size": "vote_size",
    "self_consistency_num_tied_winners": "tied_winners", "self_consistency_distinct_execution_results": "distinct_results",
    "self_consistency_samples": "samples", "prediction_exec_error": "error", "executable": "executable",
    "exact_match": "exact_match", "exec_match": "exec_match", "prediction_row_count": "CAST(row_count AS BIGINT)",
    "gold_exec_error": "gold_error", "gold_row_count": "CAST(gold_row_count AS BIGINT)",
    "generation_error": "generation_error", "generation_latency_s": "latency_s", "query_tool_calls": "query_tool_calls",
    "prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "total_tokens": "total_tokens",
    "num_generation_errors": "num_generation_errors",
}
_RECORD_SQL = f"WITH {SAMPLES_SQL} SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _RECORD_COLUMNS.items()) + " FROM records"


@query("prediction_record", _RECORD_SQL)
def _prediction_record(spark, folder):
    return _evaluation(spark, folder).predictions.select(*_RECORD_COLUMNS)


@query("predictions_jsonl", _RECORD_SQL)
def _predictions_jsonl(spark, folder):
    made = _evaluation(spark, folder).predictions.select(*_RECORD_COLUMNS)
    path = new_folder(spark, "predictions")
    records.write_predictions(made.withColumn("run_id", F.col("index") % 3), path)
    return records.read_predictions(spark, path, made.schema).select(*_RECORD_COLUMNS)


# ---- metrics ---------------------------------------------------------------------------------------------------

_RATES = {
    "executable_rate": "avg(CAST(executable AS INT))", "execution_accuracy": "avg(CAST(exec_match AS INT))",
    "exact_match_accuracy": "avg(CAST(exact_match AS INT))",
    "avg_query_tool_calls_per_example": "avg(query_tool_calls)", "avg_prompt_tokens_per_example": "avg(prompt_tokens)",
    "avg_completion_tokens_per_example": "avg(completion_tokens)",
    "avg_total_tokens_per_example": "avg(prompt_tokens + completion_tokens)",
    "invalid_sql_rate": "1 - avg(CAST(executable AS INT))",
    "avg_self_consistency_vote_fraction": "avg(coalesce(vote_fraction, 0))", "avg_self_consistency_vote_size": "avg(coalesce(vote_size, 0))",
    "avg_self_consistency_distinct_execution_results": "avg(coalesce(distinct_results, 0))",
}
_COUNTS = {
    "num_examples": "count(*)", "num_dbs": "count(DISTINCT db_id)",
    "num_executable_predictions": "count(*) FILTER (WHERE executable)",
    "num_exec_matches": "count(*) FILTER (WHERE exec_match)", "num_exact_matches": "count(*) FILTER (WHERE exact_match)",
    "num_generation_errors": "CAST(sum(num_generation_errors) AS BIGINT)",
    "num_examples_with_generation_error": "count(*) FILTER (WHERE num_generation_errors > 0)",
    "num_gold_exec_errors": "count(gold_error)", "num_query_tool_calls": "CAST(sum(query_tool_calls) AS BIGINT)",
    "total_prompt_tokens": "CAST(sum(prompt_tokens) AS BIGINT)",
    "total_completion_tokens": "CAST(sum(completion_tokens) AS BIGINT)",
    "total_tokens": "CAST(sum(prompt_tokens + completion_tokens) AS BIGINT)",
    "num_self_consistency_tie_examples": "count(*) FILTER (WHERE tied_winners > 1)",
}
_SUMMARY_SQL = ", ".join(
    [f"{v} AS {k}" for k, v in _COUNTS.items()] + [f"round({v}, 6) AS {k}" for k, v in _RATES.items()])


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _RATES})


@query("run_summary", f"WITH {SAMPLES_SQL} SELECT {_SUMMARY_SQL} FROM records")
def _run_summary(spark, folder):
    return _rounded(_evaluation(spark, folder).summary())


_SETTINGS = RunSettings(
    "2024-05-01T10:00:00+00:00", "2024-05-01T10:01:30+00:00", "single_shot", "model-a", "runs/one", True, 6, 4, 5000)


@query("run_summary_fields", f"""WITH {SAMPLES_SQL} SELECT count(*) AS num_examples, '2024-05-01T10:00:00+00:00' AS started_at,
'single_shot' AS strategy, 'model-a' AS model, true AS ordered_result_compare, CAST(6 AS INTEGER) AS float_precision,
CAST(5000 AS INTEGER) AS self_consistency_samples, true AS self_consistency_enabled, 'runs/one' AS run_dir,
'runs/one/predictions.jsonl' AS predictions_path, round(avg(CAST(exec_match AS INT)), 6) AS execution_accuracy FROM records""")
def _run_summary_fields(spark, folder):
    made = with_run_fields(_evaluation(spark, folder).summary(), _SETTINGS)
    return made.select(
        "num_examples", "started_at", "strategy", "model", "ordered_result_compare", "float_precision", "self_consistency_samples",
        "self_consistency_enabled", "run_dir", "predictions_path", F.round("execution_accuracy", 6).alias("execution_accuracy"))


@query("summary_to_sweep", f"""WITH {SAMPLES_SQL} SELECT db_id AS arm_id, CAST(1 AS INTEGER) AS k, NULL::VARCHAR AS error, count(*) AS num_examples,
round(avg(CAST(exec_match AS INT)), 6) AS execution_accuracy, 90.0::DOUBLE AS duration_s, 'runs/one' AS run_dir,
'local/' || db_id || '/summary.json' AS local_summary_path FROM records GROUP BY db_id""")
def _summary_to_sweep(spark, folder):
    """Summaries written, read back and fed to the sweep table as they are; each database is an arm."""
    made = with_run_fields(_evaluation(spark, folder).summary(["db_id"]), _SETTINGS)
    path = new_folder(spark, "summaries")
    records.write_summary(made, path, run=None)
    stored = spark.read.schema(made.schema).json(path).withColumnRenamed("db_id", "arm_id")
    arms = stored.select("arm_id", F.lit(1).alias("k"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("local/"), "arm_id").alias("local_run_dir"))
    return sweep_metrics(arms, stored, stored.limit(0)).select(
        "arm_id", "k", "error", "num_examples", F.round("execution_accuracy", 6).alias("execution_accuracy"), "duration_s", "run_dir",
        "local_summary_path")


@query("full_records", f"""WITH {SAMPLES_SQL}
SELECT r.idx AS "index", 'single_shot' AS strategy, CASE WHEN count(s.sample_index) > 0 THEN CAST(count(s.sample_index) AS INTEGER) END AS num_samples,
CASE WHEN count(s.sample_index) > 0 THEN CAST(sum(s.sample_index) AS BIGINT) END AS sample_sum,
CASE WHEN count(s.sample_index) > 0 THEN count(*) FILTER (WHERE g.first_sample = v.selected_sample) END AS num_selected
FROM records r LEFT JOIN samples s ON s.idx = r.idx LEFT JOIN groups g ON g.idx = s.idx AND g.outcome = s.outcome LEFT JOIN votes v ON v.idx = s.idx
GROUP BY r.idx""")
def _full_records(spark, folder):
    done = _evaluation(spark, folder)
    most = done.samples.groupBy("index").count().agg(F.max("count")).first()[0] or 0
    made = full_records(done.predictions, voting.sample_details(done.samples, done.votes), replace(_SETTINGS, self_consistency_samples=most))
    listed = F.col("self_consistency_sampled_predictions")
    return made.select(
        "index", "strategy", F.nullif(F.size(listed), F.lit(-1)).alias("num_samples"),
        F.aggregate(listed, F.lit(0).cast("bigint"), lambda t, s: t + s["sample_index"]).alias("sample_sum"),
        F.aggregate(listed, F.lit(0).cast("bigint"), lambda t, s: t + s["selected_by_vote"].cast("int")).alias("num_selected"))


@query("full_records_file", f"""WITH {SAMPLES_SQL}
SELECT s.idx AS "index", s.sample_index, g.group_size, g.first_sample = v.selected_sample AS selected_by_vote, s.k % 2 = 0 AS exact_match, s.error,
s.query_tool_calls, CAST(s.prompt_tokens AS BIGINT) AS prompt_tokens, 'answer ' || s.event_type AS said, 'question ' || s.idx AS asked, 'answer ' || c.event_type AS chosen_said,
CAST(2 AS INTEGER) AS chosen_messages
FROM samples s JOIN groups g ON g.idx = s.idx AND g.outcome = s.outcome JOIN votes v ON v.idx = s.idx JOIN samples c ON c.idx = v.idx AND c.sample_index = v.selected_sample""")
def _full_records_file(spark, folder):
    """Records with the chosen sample's messages and the list of all samples, written as JSON lines and read again."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("question "), "index").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("raw_output").alias("content")))
    unanswered = inputs.unanswered(spark, folder)
    users = inputs.users(spark, folder).unionByName(unanswered)
    gold = inputs.gold(spark, folder).unionByName(unanswered.select(
        "index", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("elapsed_s"), F.lit(2).cast("bigint").alias("row_count")))
    samples = inputs.samples(spark, folder).withColumn("messages", said)
    done = evaluate(users, samples, inputs.sample_results(spark, folder), gold, inputs.gold_results(spark, folder))
    details = voting.sample_details(done.samples.join(users.select("index", "gold_sql"), "index"), done.votes)
    most = samples.groupBy("index").count().agg(F.max("count")).first()[0] or 0
    made = full_records(done.predictions, details, replace(_SETTINGS, self_consistency_samples=most))
    path = new_folder(spark, "full-records")
    records.write_predictions(made.withColumn("run_id", F.col("index") % 3), path)
    back = records.read_predictions(spark, path, made.schema)
    each = back.select("index", F.col("messages").alias("chosen"), F.explode("self_consistency_sampled_predictions").alias("s"))
    return each.select(
        "index", "s.sample_index", "s.group_size", "s.selected_by_vote", "s.exact_match", "s.error", "s.query_tool_calls", "s.prompt_tokens",
        F.col("s.messages")[1]["content"].alias("said"), F.col("s.messages")[0]["content"].alias("asked"), F.col("chosen")[1]["content"].alias("chosen_said"),
        F.size("chosen").alias("chosen_messages"))


@query("summary_by_group", f"""WITH {SAMPLES_SQL}
SELECT 'run' AS "grouping", 1 AS run_id, NULL AS db_id, NULL AS difficulty, {_SUMMARY_SQL} FROM records
UNION ALL SELECT 'db', 1, db_id, NULL, {_SUMMARY_SQL} FROM records GROUP BY db_id
UNION ALL SELECT 'difficulty', 1, NULL, difficulty, {_SUMMARY_SQL} FROM records GROUP BY difficulty""")
def _summary_by_group(spark, folder):
    predictions = _evaluation(spark, folder).predictions.withColumn("run_id", F.lit(1))
    return _rounded(metrics.summary_by_group(predictions))


@query("running_accuracy", """WITH placed AS (
  SELECT user_id AS run_id, row_number() OVER w AS completed, count(*) OVER (PARTITION BY user_id) AS n,
         round(avg(CAST(event_type = 'purchase' AS INT)) OVER w, 6) AS exec_acc,
         round(avg(CAST(event_type <> 'error' AS INT)) OVER w, 6) AS executable_rate
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run_id, completed, exec_acc, executable_rate FROM placed WHERE completed % 10 = 0 OR completed = n""")
def _running_accuracy(spark, folder):
    return metrics.running_accuracy(inputs.predictions(spark, folder), 10).select(
        "run_id", "completed", F.round("exec_acc", 6).alias("exec_acc"), F.round("executable_rate", 6).alias("executable_rate"))


@query("stream_progress", """SELECT user_id AS run_id, count(*) AS completed,
count(*) FILTER (WHERE event_type = 'purchase') AS exec_matches, count(*) FILTER (WHERE event_type <> 'error') AS executables,
round(avg(CAST(event_type = 'purchase' AS INT)), 6) AS exec_acc,
round(avg(CAST(event_type <> 'error' AS INT)), 6) AS executable_rate FROM events GROUP BY user_id""")
def _stream_progress(spark, folder):
    schema = inputs.table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    flags = arriving.select(
        F.col("user_id").alias("run_id"), (F.col("event_type") == "purchase").alias("exec_match"),
        (F.col("event_type") != "error").alias("executable"))
    out = new_folder(spark, "progress-out")
    started = progress.stream_progress(flags, out)
    started.awaitTermination()
    return progress.read_progress(spark, out).select(
        "run_id", "completed", "exec_matches", "executables", F.round("exec_acc", 6).alias("exec_acc"),
        F.round("executable_rate", 6).alias("executable_rate"))


@query("stream_running_accuracy", """WITH placed AS (
  SELECT user_id AS run_id, row_number() OVER w AS completed, count(*) OVER (PARTITION BY user_id) AS n,
         count(*) FILTER (WHERE event_type = 'purchase') OVER w AS exec_matches, count(*) FILTER (WHERE event_type <> 'error') OVER w AS executables
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run_id, completed, exec_matches, executables, round(exec_matches / completed, 6) AS exec_acc, round(executables / completed, 6) AS executable_rate
FROM placed WHERE completed % 10 = 0 OR completed = n""")
def _stream_running_accuracy(spark, folder):
    # The events arrive in three parts by their number; the query is ended after the first and goes on from its checkpoint.
    own = progress.keyed_state_session(spark)
    flags = inputs.predictions(own, folder)
    flags = flags.join(flags.groupBy("run_id").agg(F.count(F.lit(1)).alias("expected")), "run_id")
    cuts = flags.agg(F.percentile_approx("index", F.array(F.lit(0.3), F.lit(0.7)))).first()[0] or []
    arriving, out, state = (new_folder(spark, f"running-accuracy-{n}") for n in ("in", "out", "state"))
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col("index") > F.lit(cut)).cast("int")
    for i in range(len(cuts) + 1):
        flags.where(part == i).write.mode("append").parquet(arriving)
        if i != 1:
            stream = own.readStream.schema(flags.schema).parquet(arriving)
            progress.stream_running_accuracy(stream, out, 10, checkpoint=state).awaitTermination()
    told = progress.read_running_accuracy(spark, out)
    return told.select("run_id", "completed", "exec_matches", "executables", F.round("exec_acc", 6).alias("exec_acc"),
                       F.round("executable_rate", 6).alias("executable_rate"))


@query("k_accuracy_curve", f"""WITH {SAMPLES_SQL},
dense AS (SELECT idx, outcome, row_number() OVER (PARTITION BY idx ORDER BY sample_index) - 1 AS s FROM samples),
per_k AS (SELECT k.k, idx, outcome, count(*) AS n, min(s) AS first FROM dense JOIN (VALUES (1), (2), (4), (8)) k(k) ON s < k.k GROUP BY ALL),
winner AS (SELECT *, row_number() OVER (PARTITION BY k, idx ORDER BY n DESC, first) AS place FROM per_k)
SELECT k, count(*) AS num_examples, round(avg(CAST(outcome = gold_outcome AND gold_error IS NULL AS INT)), 6) AS execution_accuracy
FROM winner JOIN gold USING (idx) WHERE place = 1 GROUP BY k""")
def _k_curve(spark, folder):
    judged = _keyed(spark, folder).join(_all_samples(spark, folder), ["index", "sample_index"])
    dense = with_group_position(
        judged.select("index", F.col("sample_index").alias("event"), "vote_key", "exec_match"), ["index"], ["event"], "sample_index")
    curve = metrics.k_accuracy_curve(dense, [1, 2, 4, 8])
    return curve.withColumn("execution_accuracy", F.round("execution_accuracy", 6))
