import random

import pytest
from pyspark.sql import functions as F

from quorumql.functions.cells import canonical_cells
from quorumql.operators import compare, metrics, voting
from quorumql.operators.strategies import gold_oracle
from quorumql.plans.evaluation import evaluate_answers

ROWS = "index long, row_pos long, cells array<string>"
CASES = [
    # predicted, gold, unordered, ordered
    ("SELECT * FROM VALUES (1), (2)", "SELECT * FROM VALUES (2), (1)", True, False),
    ("SELECT * FROM VALUES (1), (1)", "SELECT * FROM VALUES (1)", False, False),
    ("SELECT 0.1234561D", "SELECT 0.1234564D", True, True),
    ("SELECT 1", "SELECT 1.0D", True, True),
    ("SELECT * FROM VALUES (1), (10)", "SELECT * FROM VALUES (1.0D), (10.0D)", True, True),
    ("SELECT 1", "SELECT '1'", False, False),
    ("SELECT CAST(NULL AS INT)", "SELECT CAST(NULL AS STRING)", True, True),
    ("SELECT X'AB'", "SELECT 'ab'", True, True),
    ("SELECT 1 AS a, 2 AS b", "SELECT 2 AS b, 1 AS a", False, False),
    ("SELECT NULL, 'a'", "SELECT 'a', NULL", False, False),
    ("SELECT 1, 2", "SELECT 1", False, False),
]


def result_rows(spark, queries):
    parts = []
    for i, sql in enumerate(queries):
        df = spark.sql(sql).coalesce(1)
        plain = df.toDF(*[f"c{n}" for n in range(len(df.columns))])
        parts.append(plain.select(
            F.lit(i).cast("long").alias("index"), F.monotonically_increasing_id().alias("row_pos"), canonical_cells(plain).alias("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize("ordered", [False, True])
def test_result_match_cases(spark, ordered):
    predicted = result_rows(spark, [c[0] for c in CASES])
    gold = result_rows(spark, [c[1] for c in CASES])
    expected = [c[3] if ordered else c[2] for c in CASES]
    for left, right in ((predicted, gold), (gold, predicted)):
        exact = {r["index"]: r.rows_match for r in compare.multiset_match(left, right, ordered=ordered).collect()}
        assert [exact[i] for i in range(len(CASES))] == expected
        runs = spark.range(len(CASES)).selectExpr("id AS index", "CAST(NULL AS STRING) AS error")
        prints = {r["index"]: r.exec_match for r in compare.fingerprint_match(runs, left, runs, right, samples=(), ordered=ordered).collect()}
        assert [prints[i] for i in range(len(CASES))] == expected
    assert all(r.rows_match for r in compare.multiset_match(gold, gold, ordered=ordered).collect())


def test_execution_match_gate(spark):
    execs = "index long, error string"
    predicted = spark.createDataFrame([(0, None), (1, "e"), (2, None), (3, None), (4, "e"), (5, None)], execs)
    gold = spark.createDataFrame([(0, None), (1, None), (2, "e"), (3, None), (4, "e")], execs)
    matches = spark.createDataFrame([(0, True), (1, True), (2, True)], "index long, rows_match boolean")
    found = {r["index"]: r.exec_match for r in compare.execution_match(predicted, gold, matches).collect()}
    assert found == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False}


def keyed(spark, votes):
    rows = [(q, s, k) for q, keys in votes.items() for s, k in enumerate(keys)]
    return spark.createDataFrame(rows, "index long, sample_index int, vote_key string")


def test_majority_vote_rules(spark):
    votes = voting.majority_vote(keyed(spark, {0: "ABBA", 1: "EEA", 2: "XYA", 3: "Z", 4: "BAACC"}))
    found = {r["index"]: (r.selected_sample, r.vote_size, r.tied_winners, r.distinct_results, r.vote_fraction) for r in votes.collect()}
    assert found == {0: (0, 2, 2, 2, 0.5), 1: (0, 2, 1, 2, 2 / 3), 2: (0, 1, 3, 3, 1 / 3), 3: (0, 1, 1, 1, 1.0), 4: (1, 2, 2, 3, 0.4)}


def test_majority_vote_with_a_hot_question(spark):
    rng = random.Random(3)
    votes = {0: [rng.choice("ABCDEFG") for _ in range(3000)]}
    votes.update({q: [rng.choice("ABC") for _ in range(rng.randint(1, 9))] for q in range(1, 300)})
    found = {r["index"]: r for r in voting.majority_vote(keyed(spark, votes)).collect()}
    for q, keys in votes.items():
        best = max(keys.count(k) for k in keys)
        winners = [k for k in dict.fromkeys(keys) if keys.count(k) == best]
        assert found[q].selected_sample == keys.index(winners[0])
        assert (found[q].vote_size, found[q].tied_winners, found[q].samples) == (best, len(winners), len(keys))


def test_vote_keys(spark):
    executions = spark.createDataFrame(
        [(0, 0, None), (0, 1, None), (0, 2, "boom"), (0, 3, "boom"), (0, 4, None), (0, 5, None)], "index long, sample_index int, error string")
    results = spark.createDataFrame(
        [(0, 0, 0, ["d:1"]), (0, 0, 1, ["d:2"]), (0, 1, 0, ["d:2"]), (0, 1, 1, ["d:1"]), (0, 4, 0, [None]), (0, 4, 1, [None])],
        "index long, sample_index int, row_pos long, cells array<string>")
    keys = {r.sample_index: r.vote_key for r in voting.vote_keys(executions, results).collect()}
    assert keys[0] == keys[1] and keys[2] == keys[3] == "error::boom" and len(set(keys.values())) == 4
    ordered = {r.sample_index: r.vote_key for r in voting.vote_keys(executions, results, ordered=True).collect()}
    assert ordered[0] != ordered[1]
    voted = voting.vote_keys(executions, results)
    assert voting.audit_vote_keys(voted, results).count() == 0
    merged = voted.withColumn("vote_key", F.when(F.col("error").isNull(), F.lit("same")).otherwise(F.col("vote_key")))
    assert voting.audit_vote_keys(merged, results).count() > 0


def test_nested_samples(spark):
    rows = keyed(spark, {0: "AB", 1: "AAAAA"})
    details = voting.sample_details(rows, voting.majority_vote(rows))
    nested = {r["index"]: [s.sample_index for s in r.self_consistency_sampled_predictions] for r in voting.nest_samples(details, 5).collect()}
    assert nested == {0: [0, 1], 1: [0, 1, 2, 3, 4]}
    with pytest.raises(ValueError, match="5 samples"):
        voting.nest_samples(details, 3)


def test_fingerprint_match_has_every_sample(spark):
    runs = "index long, sample_index int, error string"
    predicted = spark.createDataFrame([(0, 0, None), (0, 1, "e"), (1, 0, None), (1, 1, None), (2, 0, None), (3, 0, None)], runs)
    rows = spark.createDataFrame([(1, 1, 0, ["d:1"]), (2, 0, 0, ["d:1"])], "index long, sample_index int, row_pos long, cells array<string>")
    gold = spark.createDataFrame([(0, None), (1, None), (2, "e")], "index long, error string")
    gold_rows = spark.createDataFrame([(1, 0, ["d:1"])], ROWS)
    found = {(r["index"], r.sample_index): r.exec_match for r in compare.fingerprint_match(predicted, rows, gold, gold_rows).collect()}
    # Empty against empty matches; an error, rows against none, a failed gold query and a missing one do not.
    assert found == {(0, 0): True, (0, 1): False, (1, 0): False, (1, 1): True, (2, 0): False, (3, 0): False}


def test_empty_sql_error(spark):
    df = spark.createDataFrame([("", None, None), ("", "gen", None), (None, "", None), ("x", "gen", "e")],
                               "sql string, generation_error string, error string")
    assert [r.error for r in compare.with_empty_sql_error(df).collect()] == ["Empty SQL output", "gen", "Empty SQL output", "e"]


def test_k_curve(spark):
    rows = [(0, s, k, k == "A") for s, k in enumerate("BAA")] + [(1, s, k, k == "A") for s, k in enumerate("ABB")]
    df = spark.createDataFrame(rows, "index long, sample_index int, vote_key string, exec_match boolean")
    curve = {r.k: r.execution_accuracy for r in metrics.k_accuracy_curve(df, [1, 2, 3]).collect()}
    assert curve == {1: 0.5, 2: 0.5, 3: 0.5}


def test_evaluate_answers_end_to_end(spark):
    spark.range(10).createOrReplaceTempView("ten")
    examples = spark.createDataFrame(
        [(0, "d", "simple", "SELECT id FROM ten"), (1, "d", "hard", "SELECT count(*) FROM ten"), (2, "e", "hard", "SELECT nope FROM ten")],
        "index long, db_id string, difficulty string, gold_sql string")
    texts = {
        (0, 0): "```sql\nSELECT id FROM ten WHERE id < 3\n```", (0, 1): "SELECT id + 0 AS x FROM ten ORDER BY 1 DESC;", (0, 2): "select id from ten",
        (1, 0): "DROP VIEW ten", (1, 1): "", (1, 2): "SELECT 1/0 FROM ten", (2, 0): "SELECT 1", (2, 1): "SELECT 1", (2, 2): "SELECT 1"}
    answers = spark.createDataFrame(
        [(q, s, t, None, 1.0, 2, 3, None, None) for (q, s), t in texts.items()],
        "index long, sample_index int, raw_output string, generation_error string, latency_s double, query_tool_calls int, "
        "prompt_tokens long, completion_tokens long, total_tokens long")
    done = evaluate_answers(examples, answers)
    records = {r["index"]: r for r in done.predictions.collect()}
    assert records[0].exec_match and records[0].self_consistency_selected_sample_index == 1 and records[0].prediction_row_count == 10
    assert records[0].self_consistency_vote_size == 2 and records[0].gold_row_count == 10
    assert not records[1].executable and records[1].self_consistency_num_tied_winners == 3
    assert spark.table("ten").count() == 10  # the DROP never ran
    assert records[2].executable and not records[2].exec_match and records[2].gold_exec_error
    summary = done.summary().collect()[0]
    assert (summary.num_examples, summary.num_exec_matches, summary.num_dbs, summary.num_gold_exec_errors) == (3, 1, 2, 1)
    assert summary.total_prompt_tokens == 27 and summary.num_query_tool_calls == 18


def test_gold_oracle_scores_full_marks(spark):
    spark.range(5).createOrReplaceTempView("five")
    examples = spark.createDataFrame(
        [(0, "d", "x", "SELECT id FROM five"), (1, "d", "x", "SELECT sum(id) FROM five WHERE id > 99")],
        "index long, db_id string, difficulty string, gold_sql string")
    done = evaluate_answers(examples, gold_oracle(examples, 2))
    summary = done.summary().collect()[0]
    assert summary.execution_accuracy == summary.exact_match_accuracy == summary.executable_rate == 1.0


def test_no_question_is_lost(spark):
    examples = spark.createDataFrame(
        [(0, "d", "x", "SELECT 1"), (1, "d", "x", "SELECT 2")], "index long, db_id string, difficulty string, gold_sql string")
    one = gold_oracle(examples, 1).where("index = 0")
    done = evaluate_answers(examples, one)
    records = {r["index"]: r for r in done.predictions.collect()}
    assert records[0].exec_match and not records[1].exec_match and not records[1].executable and not records[1].exact_match
    assert records[1].prediction_exec_error == "Empty SQL output" and records[1].gold_row_count == 1
    summary = done.summary().collect()[0]
    assert (summary.num_examples, summary.execution_accuracy) == (2, 0.5)


def test_no_selected_question_is_an_error(spark):
    examples = spark.createDataFrame([], "index long, db_id string, difficulty string, gold_sql string")
    with pytest.raises(ValueError, match="no questions"):
        evaluate_answers(examples, gold_oracle(examples))


def test_questions_run_on_their_own_database(spark):
    def session(name):
        own = spark.newSession()
        own.range({"small": 3, "large": 30}[name]).createOrReplaceTempView("t")
        return own

    examples = spark.createDataFrame(
        [(0, "small", "x", "SELECT count(*) FROM t"), (1, "large", "x", "SELECT count(*) FROM t")],
        "index long, db_id string, difficulty string, gold_sql string")
    answers = spark.createDataFrame(
        [(q, 0, "SELECT 3", None, 1.0, 0, 0, None, None) for q in (0, 1)],
        "index long, sample_index int, raw_output string, generation_error string, latency_s double, query_tool_calls int, "
        "prompt_tokens long, completion_tokens long, total_tokens long")
    done = evaluate_answers(examples, answers, sessions=session)
    assert {r["index"]: r.exec_match for r in done.predictions.collect()} == {0: True, 1: False}


def test_run_summary_of_no_records_has_no_row(spark):
    examples = spark.createDataFrame([(0, "d", "x", "SELECT 1")], "index long, db_id string, difficulty string, gold_sql string")
    done = evaluate_answers(examples, gold_oracle(examples))
    assert metrics.run_summary(done.predictions.where("false")).count() == 0
