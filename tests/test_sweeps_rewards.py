import json

import pytest
from pyspark.sql import functions as F

from quorumql.operators.runs import RunSettings, run_config
from quorumql.operators import answers, previews, prompts, rewards, sweeps
from quorumql.plans.training import reward_rollouts, training_rows
from quorumql.sources import records


def test_pareto(spark):
    points = spark.createDataFrame(
        [(0, 1.0, .5), (1, 2.0, .5), (2, 2.0, .7), (3, 3.0, .6), (4, 2.0, .7), (5, None, .9), (6, 0.5, None)], "k int, x double, y double")
    assert sorted(r.k for r in sweeps.pareto_frontier(points, "x", "y").collect()) == [0, 2, 4]
    assert sweeps.pareto_frontier(points.where("k = 0"), "x", "y").count() == 0
    grouped = points.withColumn("g", (F.col("k") == 0).cast("int"))
    assert sorted(r.k for r in sweeps.pareto_frontier(grouped, "x", "y", ["g"]).collect()) == [2, 4]


def test_rank_arms(spark):
    arms = spark.createDataFrame([(4, .5), (1, None), (2, .5), (8, .75)], "k int, execution_accuracy double")
    rows = [(r.k, r.execution_accuracy_text) for r in sweeps.rank_arms(arms).orderBy("rank").collect()]
    assert rows == [(8, "0.7500"), (2, "0.5000"), (4, "0.5000"), (1, "n/a")]


def test_sweep_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, None), (2, None, "x")], "k int, execution_accuracy double, run_dir string")
    records.write_sweep(rows, str(tmp_path / "csv"), "csv")
    back = sweeps.coerce_metrics(records.read_sweep(spark, csv_path=str(tmp_path / "csv")), ["k"], ["execution_accuracy", "duration_s"])
    assert sorted((r.k, r.execution_accuracy, r.duration_s, r.run_dir) for r in back.collect()) == [(1, .5, None, None), (2, None, None, "x")]
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps([{"k": 3, "execution_accuracy": 0.25}, {"k": "bad"}]))
    read = sweeps.coerce_metrics(records.read_sweep(spark, json_path=str(path)), ["k"], ["execution_accuracy"])
    assert [(r.k, r.execution_accuracy) for r in read.collect()] == [(3, .25)]
    with pytest.raises(ValueError):
        records.read_sweep(spark)


def test_prediction_files_keep_order_nulls_and_text(spark, tmp_path):
    rows = spark.range(500).select(
        F.col("id").alias("index"), (F.col("id") % 2).alias("run_id"), F.lit("é").alias("question"), F.lit(None).cast("string").alias("error"))
    path = tmp_path / "predictions"
    records.write_predictions(rows.repartition(7), str(path))
    for run in (0, 1):
        lines = [json.loads(line) for part in sorted((path / f"run_id={run}").glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]
        assert [x["index"] for x in lines] == list(range(run, 500, 2)) and lines[0]["question"] == "é" and lines[0]["error"] is None
    assert records.read_predictions(spark, str(path), rows.schema).count() == 500


def test_last_record_and_alias(spark):
    log = spark.createDataFrame(
        [("a", 1, '{"loss": 9}'), ("a", 2, '{"optim/loss": 0.5, "train/loss": "x", "loss": 3, "env/all/exec_match": true}'), ("b", 1, "{}")],
        "run string, step int, metrics string")
    last = sweeps.last_record(sweeps.require_objects(log, "metrics"), ["run"], "step")
    found = {r.run: r for r in sweeps.metric_alias(last).collect()}
    assert found["a"]["train/loss"] == 0.5 and found["a"]["train/exec_match"] == 1.0 and found["b"]["train/loss"] is None
    bad = spark.createDataFrame([("[1]",)], "metrics string")
    with pytest.raises(Exception, match="expected a JSON object"):
        sweeps.require_objects(bad, "metrics").collect()


def test_answer_report(spark):
    texts = [("select 1",), ("",), ("drop table x",), ("select 1; select 2",), (None,)]
    report = answers.answer_report(spark.createDataFrame(texts, "raw_output string"))
    assert {r.answer_class: r.num_answers for r in report.collect()} == {"read_only": 1, "empty": 2, "mutating": 1, "multi_statement": 1}


def test_messages_and_budget(spark):
    call = "array<struct<id:string,name:string,arguments:string>>"
    rows = [
        (1, 0, "user", None, "hi", None), (1, 1, "assistant", None, "a", [("c1", "query", '{"sql":" s1 "}'), ("c2", "query", "x"), ("c3", "other", "{}")]),
        (1, 2, "tool", "query", "r", None), (1, 3, "assistant", None, "b", [("c4", "query", '{"sql":"s2"}'), (None, "query", "{}")]), (2, 0, "user", None, "q", None)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, name string, text string, tool_calls {call}")
    assert {r.conv_id: r.final_text for r in rewards.last_assistant_text(df).collect()} == {1: "b", 2: ""}
    assert {r.conv_id: r.num_messages for r in rewards.count_messages(df).collect()} == {1: 1, 2: 0}
    calls = rewards.tool_calls(df)
    assert sorted((r.call_id, r.sql) for r in calls.collect()) == [("c1", "s1"), ("c2", ""), ("c3", ""), ("c4", "s2")]
    status = {r.call_id: r.status for r in rewards.apply_tool_budget(calls, 2).collect()}
    assert status == {"c1": "run", "c2": "run", "c3": "unsupported", "c4": "over_budget"}
    assert {r.status for r in rewards.apply_tool_budget(calls, 0).collect()} == {"unsupported", "over_budget"}
    many = spark.range(20).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"))
    assert rewards.served_rounds(many, 3).count() == 7


def test_budget_with_a_hot_conversation(spark):
    calls = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 700).alias("conv_id"), F.col("id").alias("turn"), F.lit(0).alias("pos"), F.lit("query").alias("name"))
    found = rewards.apply_tool_budget(calls, 5).groupBy("conv_id", "status").count().collect()
    runs = {r.conv_id: r["count"] for r in found if r.status == "run"}
    assert runs[-1] == 5 and all(n <= 5 for n in runs.values()) and sum(r["count"] for r in found) == 6000


def test_reward_rollouts(spark):
    messages = spark.createDataFrame(
        [(1, 0, "assistant", None, "```sql\nSELECT 1;\n```"), (2, 0, "assistant", None, "  "), (3, 0, "user", None, "x"), (1, 1, "tool", "query", "r")],
        "conv_id int, turn int, role string, name string, text string")
    gold = spark.createDataFrame([(1, "select 1"), (2, ""), (3, "x")], "conv_id int, gold_sql string")
    outcomes = spark.createDataFrame([(1, True, True), (2, True, True)], "conv_id int, executable boolean, exec_match boolean")
    found = {r.conv_id: r for r in reward_rollouts(messages, gold, outcomes, exec_match=1.0, executable=0.5, exact_sql=0.25).collect()}
    assert found[1].reward == 1.75 and found[1].query_tool_calls == 1
    assert found[2].reward == 0.0 and found[3].reward == 0.0
    means = rewards.reward_metrics(spark.createDataFrame([tuple(r) for r in [(1.0, True, True, False, "x", 2)]], "reward double, exec_match boolean, executable boolean, exact_match boolean, sql string, query_tool_calls int"), False).collect()[0]
    assert (means.exec_match, means.exact_match, means.query_tool_calls, means.query_tool_enabled) == (1.0, 0.0, 2.0, 0.0)


def test_training_rows(spark):
    examples = spark.range(40).select(F.col("id").alias("index"), F.lit("d").alias("db_id"), F.lit("q").alias("question"), F.lit(" ").alias("evidence"))
    contexts = spark.createDataFrame([("d", "TABLE t", None)], "db_id string, schema_text string, data_dictionary_text string")
    rows = training_rows(examples, contexts, train_limit=20, eval_limit=5, group_size=3, groups_per_batch=8, include_evidence=True)
    counted = {(r.split, r.batch_index): r["count"] for r in rows.groupBy("split", "batch_index").count().collect()}
    assert counted == {("train", 0): 24, ("train", 1): 24, ("train", 2): 12, ("eval", 0): 5}
    message = rows.select("messages").first().messages
    assert [m.role for m in message] == ["system", "user"] and "Evidence" not in message[1].content and "TABLE t" in message[1].content
    with pytest.raises(ValueError):
        training_rows(examples, contexts, group_size=1)


def test_system_message():
    assert prompts.system_message(False) == prompts.SYSTEM_TEXT
    assert "Tool schema: {}" in prompts.system_message(True, "{}") and "schema" not in prompts.system_message(True)


def payloads(spark, sql, rows, columns=("a", "b"), error=None, **limits):
    queries = spark.createDataFrame([(0, sql, error, list(columns))], "index long, sql string, error string, columns array<string>")
    results = spark.createDataFrame([(0, i, r) for i, r in enumerate(rows)], "index long, row_pos long, cells array<string>")
    return previews.previews(queries, results, **limits).collect()[0]


def test_preview_payloads_are_json_within_budget(spark):
    rows = [[f"d:{i}", "s:" + "x" * 40 + '"'] for i in range(30)]
    for budget in (512, 700, 6000):
        made = payloads(spark, "select 1", rows, max_rows=20, max_output_chars=budget, max_cell_chars=30)
        content = json.loads(made.payload)
        assert len(made.payload) <= budget and content["returned_rows"] == made.returned_rows == len(content["rows"])
        assert content["rows_truncated"] is True and content["row_limit"] == 20
        assert content["rows"][0] == [0, "x" * 30 + "..."]
        if len(content["rows"]) < 20:
            # One more row would not have fitted.
            content["rows"].append(rows[made.returned_rows] and [made.returned_rows, "x" * 30 + "..."])
            content["returned_rows"] += 1
            assert content["output_truncated"] and len(json.dumps(content)) > budget


def test_preview_fallbacks(spark):
    wide = payloads(spark, "select 1", [["s:" + "y" * 190]] * 3, columns=["c" * 300, "d" * 300], max_output_chars=0, max_rows=5)
    assert json.loads(wide.payload) == {"ok": True, "output_truncated": True, "message": "Output truncated."}
    no_rows = payloads(spark, "select 1", [["s:" + "y" * 190] * 3] * 3, columns=["c" * 100], max_output_chars=0, max_rows=5)
    assert json.loads(no_rows.payload)["returned_rows"] == no_rows.returned_rows == 0
    empty = payloads(spark, "select 1", [], columns=["a"])
    assert json.loads(empty.payload)["rows"] == []
    assert json.loads(payloads(spark, "", []).payload)["error"] == previews.MISSING_SQL
    assert json.loads(payloads(spark, "drop x", []).payload)["error"] == previews.NOT_READ_ONLY
    failed = json.loads(payloads(spark, "select 1", [], error="boom\n").payload)
    assert failed == {"ok": False, "error": "boom\n", "sql": "select 1"}


def test_sweep_arrays_are_bounded_files(spark, tmp_path, monkeypatch):
    rows = spark.range(250).selectExpr("CAST(id AS STRING) AS k", "IF(id % 3 = 0, NULL, CAST(id / 7 AS STRING)) AS execution_accuracy", "concat('run \"', id, '\" ]}') AS run_dir").repartition(3)
    expected = sorted(tuple(r) for r in rows.collect())
    for most in (10_000, 20):
        monkeypatch.setattr(records, "ARRAY_ROWS", most)
        path = str(tmp_path / f"json{most}")
        records.write_sweep(rows, path, "json")
        back = records.read_sweep(spark, json_path=path).select("k", "execution_accuracy", "run_dir")
        assert sorted(tuple(r) for r in back.collect()) == expected
        files = spark.read.option("wholetext", True).text(path).collect()
        assert (len(files) == 1) == (most == 10_000) and max(r.value.count('"k"') for r in files) <= most
    records.write_sweep(rows.limit(0), str(tmp_path / "none"), "json")
    assert records.read_sweep(spark, json_path=str(tmp_path / "none")).count() == 0


def test_run_settings_are_written_and_read(spark, tmp_path):
    settings = RunSettings("2024-05-01T10:00:00+00:00", "2024-05-01T10:01:30+00:00", "single_shot", None, "runs/one", True, 6, 4, 5)
    made = run_config(spark, settings)
    records.write_summary(made, str(tmp_path / "config"), run=None)
    back = spark.read.schema(made.schema).json(str(tmp_path / "config")).collect()
    assert back == made.collect() and back[0].model is None and back[0].self_consistency_enabled and back[0].summary_path == "runs/one/summary.json"
