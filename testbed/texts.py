"""SQL answers, messages, rewards and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumql.functions import messages, sqltext
from quorumql.functions.cells import canonical_cells
from quorumql.operators import answers, previews, rewards
from quorumql.plans import training
from testbed import inputs
from testbed.registry import query

# What each answer template must turn into; %s stands for the row's number.
_N = "CAST(o_custkey AS VARCHAR)"
_CLEANED = (
    f"'SELECT ' || {_N}", f"'SELECT ' || {_N}", f"'select ' || {_N}", f"'<think>still thinking about ' || {_N}", "'select 1'",
    f"'select '';'' ' || chr(10) || ', ' || {_N}", f"'select ' || {_N}", f"'select' || {_N}", f"'select ''it''''s;'' , ' || {_N}",
    f"'a ''unterminated ; ' || {_N}", f"'DROP TABLE t' || {_N}", f"'select ''drop'', ' || {_N}",
    f"'SELECT REPLACE(a, ''x'', ''y''), ' || {_N}", f"'( select ' || {_N} || ')'", f"'((select ' || {_N} || '))'", "''",
)
_READ_ONLY = (True, True, True, False, True, True, True, True, True, False, False, True, False, False, True, False)
_STATEMENTS = (1, 1, 1, 1, 2, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 0)


def _case(values) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE o_orderkey % {len(inputs.ANSWER_TEMPLATES)} {whens} END"


def _raw_case() -> str:
    def text(template: str) -> str:
        quoted = template.replace("'", "''").replace("\n", "' || chr(10) || '")
        return f"replace('{quoted}', '{{n}}', {_N})"

    return _case([text(t) for t in inputs.ANSWER_TEMPLATES])


_ANSWERS_SQL = f"""answers AS (SELECT o_orderkey AS "index", {_raw_case()} AS raw, {_case(_CLEANED)} AS sql,
{_case(_READ_ONLY)} AS is_read_only, CAST({_case(_STATEMENTS)} AS INTEGER) AS n_statements FROM orders)"""


def _cleaned(spark, folder):
    return answers.clean_answers(inputs.answers(spark, folder))


@query("strip_think", f"""WITH {_ANSWERS_SQL} SELECT "index", trim(regexp_replace(raw, '<think>.*?</think>', '', 'gs'), ' ' || chr(10)) AS text FROM answers""")
def _strip_think(spark, folder):
    return inputs.answers(spark, folder).select("index", sqltext.strip_think(F.col("raw_output")).alias("text"))


@query("extract_fence", f"""WITH {_ANSWERS_SQL} SELECT "index", CASE WHEN regexp_matches(raw, '```(?:sql)?\\s*(.*?)```', 'si')
THEN trim(regexp_extract(raw, '```(?:sql)?\\s*(.*?)```', 1, 'si'), ' ' || chr(10)) ELSE raw END AS text FROM answers""")
def _extract_fence(spark, folder):
    return inputs.answers(spark, folder).select("index", sqltext.extract_fence(F.col("raw_output")).alias("text"))


@query("split_statements", f"""WITH {_ANSWERS_SQL} SELECT "index", n_statements, nullif(sql, '') AS first_statement FROM answers""")
def _split_statements(spark, folder):
    split = inputs.answers(spark, folder).withColumn(
        "statements", sqltext.split_statements(sqltext.extract_fence(sqltext.strip_think(F.col("raw_output")))))
    return split.select("index", F.size("statements").alias("n_statements"),
                        F.try_element_at("statements", F.lit(1)).alias("first_statement"))


@query("extract_sql", f'WITH {_ANSWERS_SQL} SELECT "index", sql FROM answers')
def _extract_sql(spark, folder):
    return _cleaned(spark, folder).select("index", "sql")


@query("read_only_gate", f'WITH {_ANSWERS_SQL} SELECT "index", is_read_only FROM answers')
def _read_only_gate(spark, folder):
    return _cleaned(spark, folder).select("index", "is_read_only")


@query("sql_answer_report", f"""WITH {_ANSWERS_SQL}, classed AS (
  SELECT *, CASE WHEN sql = '' THEN 'empty' WHEN NOT is_read_only THEN 'mutating' WHEN n_statements > 1 THEN 'multi_statement'
    ELSE 'read_only' END AS answer_class FROM answers)
SELECT answer_class, count(*) AS num_answers, CAST(sum(n_statements) AS BIGINT) AS num_statements FROM classed GROUP BY answer_class""")
def _answer_report(spark, folder):
    return answers.answer_report(inputs.answers(spark, folder))


@query("document_statements", """SELECT doc_id, length(text) AS chars,
CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 0 ELSE 1 END AS pieces FROM documents""")
def _document_statements(spark, folder):
    # The tables' documents hold no separator, so each stays whole; tests/test_functions.py has those that do.
    documents = inputs.table(spark, folder, "documents")
    text = F.col("text")
    return documents.select("doc_id", F.length(text).cast("bigint").alias("chars"), F.size(sqltext.split_statements(text)).alias("pieces"))


@query("normalize_sql", f"""WITH {_ANSWERS_SQL} SELECT "index",
trim(regexp_replace(rtrim(lower(trim(raw, ' ' || chr(10))), ';'), '\\s+', ' ', 'g')) AS normal FROM answers""")
def _normalize_sql(spark, folder):
    return inputs.answers(spark, folder).select("index", sqltext.normalize_sql(F.col("raw_output")).alias("normal"))


@query("exact_match", f"""WITH {_ANSWERS_SQL} SELECT "index", sql <> '' AND lower(sql) = 'select ' || {_N} AS exact_match
FROM answers JOIN orders ON o_orderkey = "index" """)
def _exact_match(spark, folder):
    gold = inputs.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("index"), F.concat(F.lit(" Select\n"), F.col("o_custkey").cast("string"), F.lit(";")).alias("gold_sql"))
    return _cleaned(spark, folder).join(gold, "index").select(
        "index", sqltext.exact_match(F.col("sql"), F.col("gold_sql")).alias("exact_match"))


# ---- messages and rewards --------------------------------------------------------------------------------------


@query("last_assistant_text", """SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS final_text
FROM conversations GROUP BY conv_id""")
def _last_assistant(spark, folder):
    return rewards.last_assistant_text(inputs.table(spark, folder, "conversations"))


@query("count_role_messages", """SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS num_messages FROM conversations GROUP BY conv_id""")
def _count_roles(spark, folder):
    return rewards.count_messages(inputs.table(spark, folder, "conversations"), role="user", name=None)


_CALLS_SQL = """turns AS (SELECT user_id AS conv_id, event_id AS turn, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
calls AS (
  SELECT conv_id, turn, p AS pos, CASE WHEN p = 0 AND event_type = 'signup' THEN 'search' ELSE 'query' END AS name,
         CASE WHEN p = 0 OR k % 4 = 3 THEN 'select ' || k ELSE '' END AS sql
  FROM turns, range(3) t(p) WHERE p <> 1 OR k % 2 = 0)"""


@query("count_tool_messages", f"""WITH {_CALLS_SQL} SELECT conv_id, count(*) FILTER (WHERE event_type = 'click') AS num_messages
FROM turns GROUP BY conv_id""")
def _count_tools(spark, folder):
    return rewards.count_messages(inputs.call_messages(spark, folder))


@query("flatten_content", f"""WITH {_CALLS_SQL} SELECT conv_id, turn,
CASE WHEN k % 3 = 0 THEN 'plain ' || k ELSE 'hm ' || k || chr(10) || ' ' || chr(10) || chr(10) || 'say ' || event_type END AS with_thinking,
CASE WHEN k % 3 = 0 THEN 'plain ' || k ELSE 'say ' || event_type END AS text_only FROM turns""")
def _flatten_content(spark, folder):
    return inputs.call_messages(spark, folder).select(
        "conv_id", "turn",
        messages.flatten_content(F.col("content"), F.col("parts"), True).alias("with_thinking"),
        messages.flatten_content(F.col("content"), F.col("parts"), False).alias("text_only"))


@query("tool_call_sql", f"WITH {_CALLS_SQL} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, name, sql FROM calls")
def _tool_call_sql(spark, folder):
    return rewards.tool_calls(inputs.call_messages(spark, folder)).select("conv_id", "turn", "pos", "name", "sql")


@query("tool_budget", f"""WITH {_CALLS_SQL}, served AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM calls),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY turn, pos) AS n FROM served WHERE r <= 24)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos,
CASE WHEN name <> 'query' THEN 'unsupported' WHEN n <= 20 THEN 'run' ELSE 'over_budget' END AS status FROM numbered""")
def _tool_budget(spark, folder):
    calls = rewards.tool_calls(inputs.call_messages(spark, folder))
    return rewards.serve_calls(calls, 20).select("conv_id", "turn", "pos", "status")


@query("tool_budget_steps", f"""WITH {_CALLS_SQL}, served AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM calls),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY turn, pos) AS n FROM served WHERE r <= 9)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos,
CASE WHEN name <> 'query' THEN 'unsupported' WHEN n <= 5 THEN 'run' ELSE 'over_budget' END AS status FROM numbered""")
def _tool_budget_steps(spark, folder):
    # The two limits one after the other.
    calls = rewards.served_rounds(rewards.tool_calls(inputs.call_messages(spark, folder)), 5)
    return rewards.apply_tool_budget(calls, 5).select("conv_id", "turn", "pos", "status")


@query("token_usage", f"""WITH {_CALLS_SQL} SELECT conv_id, CAST(sum(k) AS BIGINT) AS prompt_tokens,
CAST(sum(k % 5) AS BIGINT) AS completion_tokens, CAST(sum(k + k % 5) AS BIGINT) AS total_tokens FROM turns GROUP BY conv_id""")
def _token_usage(spark, folder):
    return rewards.token_usage(inputs.call_messages(spark, folder))


_OUTCOME_SQL = """outcomes AS (SELECT event_id, user_id, event_type = 'purchase' AS exec_match, event_type <> 'error' AS executable,
CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 2 = 0 AS exact_match, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 4 AS query_tool_calls, value, event_type FROM events),
rewarded AS (SELECT *, round(1.0 * CAST(exec_match AS INT) + 0.25 * CAST(executable AS INT) + 0.125 * CAST(exact_match AS INT), 6)::DOUBLE AS reward FROM outcomes)"""


def _rewarded(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    outcomes = inputs.table(spark, folder, "events").select(
        "event_id", "user_id", (F.col("event_type") == "purchase").alias("exec_match"),
        (F.col("event_type") != "error").alias("executable"), (k % 2 == 0).alias("exact_match"),
        F.when(F.col("event_type") != "view", F.lit("select 1")).otherwise(F.lit("")).alias("sql"), (k % 4).alias("query_tool_calls"))
    return rewards.outcome_reward(outcomes, 1.0, 0.25, 0.125)


@query("outcome_reward", f"WITH {_OUTCOME_SQL} SELECT event_id, reward FROM rewarded")
def _outcome_reward(spark, folder):
    return _rewarded(spark, folder).select("event_id", "reward")


@query("reward_metrics", f"""WITH {_OUTCOME_SQL} SELECT user_id, count(*) AS rollouts, round(avg(reward), 6) AS reward,
round(avg(CAST(exec_match AS INT)), 6) AS exec_match, round(avg(CAST(executable AS INT)), 6) AS executable,
round(avg(CAST(exact_match AS INT)), 6) AS exact_match, round(avg(CAST(event_type <> 'view' AS INT)), 6) AS prediction_has_sql,
round(avg(query_tool_calls), 6) AS query_tool_calls, 1.0::DOUBLE AS query_tool_enabled FROM rewarded GROUP BY user_id""")
def _reward_metrics(spark, folder):
    means = rewards.reward_metrics(_rewarded(spark, folder), True, ["user_id"])
    return means.withColumns({c: F.round(c, 6) for c in ("reward", "exec_match", "executable", "exact_match", "prediction_has_sql", "query_tool_calls")})


@query("reward_rollouts", """WITH finals AS (
  SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS final_text FROM conversations GROUP BY conv_id),
flags AS (SELECT conv_id, trim(final_text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS has_sql, conv_id % 3 = 0 AS same FROM finals)
SELECT conv_id, has_sql AND conv_id % 2 = 0 AS executable, has_sql AND conv_id % 4 = 0 AS exec_match, has_sql AND same AS exact_match,
(CASE WHEN has_sql AND conv_id % 4 = 0 THEN 1.0 ELSE 0 END + CASE WHEN has_sql AND conv_id % 2 = 0 THEN 0.25 ELSE 0 END
 + CASE WHEN has_sql AND same THEN 0.125 ELSE 0 END)::DOUBLE AS reward FROM flags""")
def _reward_rollouts(spark, folder):
    messages_ = inputs.table(spark, folder, "conversations").withColumn("name", F.lit(None).cast("string"))
    key = F.col("conv_id")
    finals = rewards.last_assistant_text(messages_)
    gold = finals.select("conv_id", F.when(key % 3 == 0, F.concat("final_text", F.lit(";"))).otherwise(F.lit("select 1")).alias("gold_sql"))
    outcomes = finals.select("conv_id", (key % 2 == 0).alias("executable"), (key % 4 == 0).alias("exec_match"))
    made = training.reward_rollouts(messages_, gold, outcomes, exec_match=1.0, executable=0.25, exact_sql=0.125)
    return made.select("conv_id", "executable", "exec_match", "exact_match", "reward")


# ---- previews --------------------------------------------------------------------------------------------------


def _customer_results(spark, folder):
    """Orders per customer as result rows, in order of their key."""
    orders = inputs.table(spark, folder, "orders")
    cells = canonical_cells(orders, ["o_orderkey", "o_orderpriority"])
    return orders.select(F.col("o_custkey").alias("index"), F.col("o_orderkey").alias("row_pos"), cells.alias("cells"))


@query("preview_rows", """SELECT o_custkey AS "index", o_orderkey AS row_pos, n > 5 AS rows_truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
WHERE r <= 5""")
def _preview_rows(spark, folder):
    # The row cap is the operator under test.
    results = _customer_results(spark, folder)
    return previews.preview_rows(results, 5).join(previews.row_counts(results, 5), "index").select(
        "index", "row_pos", "rows_truncated")


@query("clip_cells", """SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS cell FROM documents""")
def _clip_cells(spark, folder):
    return inputs.table(spark, folder, "documents").select("doc_id", previews.clip_cell(F.col("text"), 200).alias("cell"))


def _preview_queries(spark, folder):
    key = F.col("c_custkey")
    return inputs.table(spark, folder, "customer").select(
        key.alias("index"),
        F.when(key % 10 == 0, F.lit("")).when(key % 10 == 1, F.lit("drop table t"))
        .otherwise(F.concat(F.lit("select "), key.cast("string"))).alias("sql"),
        F.when(key % 10 == 2, F.lit("boom")).alias("error"),
        F.array(F.lit("key"), F.lit("priority")).alias("columns"))


_STATUS_SQL = """CASE c_custkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'not_read_only' WHEN 2 THEN 'error' ELSE 'ok' END"""


@query("preview_status", f'SELECT c_custkey AS "index", {_STATUS_SQL} AS status FROM customer')
def _preview_status(spark, folder):
    return previews.preview_status(_preview_queries(spark, folder)).select("index", "status")


@query("budget_preview", f"""WITH rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, '[' || o_orderkey || ', "' || o_orderpriority || '"]' AS t FROM orders),
kept AS (
  SELECT o_custkey, r, string_agg(t, ', ') OVER (PARTITION BY o_custkey ORDER BY r) AS body, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM rows_ WHERE r <= 30),
sized AS (
  SELECT o_custkey, n, r, body, (SELECT count(*) FROM orders q WHERE q.o_custkey = kept.o_custkey) > 30 AS cut FROM kept
  UNION ALL SELECT c_custkey, coalesce((SELECT least(count(*), 30) FROM orders WHERE o_custkey = c_custkey), 0), 0, '',
    coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) > 30 FROM customer),
texts AS (
  SELECT o_custkey, n, r, '{{"ok": true, "sql": "select ' || o_custkey || '", "columns": ["key", "priority"], "rows": [' || body
    || '], "returned_rows": ' || r || ', "row_limit": 30, "rows_truncated": ' || cut || CASE WHEN r < n THEN ', "output_truncated": true' ELSE '' END || '}}' AS payload FROM sized),
best AS (SELECT o_custkey, arg_max(payload, r) AS payload, max(r) AS r FROM texts WHERE length(payload) <= 600 GROUP BY o_custkey)
SELECT c_custkey AS "index", {_STATUS_SQL} AS status, CAST(CASE WHEN c_custkey % 10 > 2 THEN r ELSE 0 END AS INTEGER) AS returned_rows,
CASE c_custkey % 10 WHEN 0 THEN '{{"ok": false, "error": "{previews.MISSING_SQL}"}}' WHEN 1 THEN '{{"ok": false, "error": "{previews.NOT_READ_ONLY}"}}'
  WHEN 2 THEN '{{"ok": false, "error": "boom", "sql": "select ' || c_custkey || '"}}' ELSE payload END AS payload
FROM customer JOIN best ON o_custkey = c_custkey""")
def _budget_preview(spark, folder):
    return previews.previews(_preview_queries(spark, folder), _customer_results(spark, folder), max_rows=30, max_output_chars=600)
