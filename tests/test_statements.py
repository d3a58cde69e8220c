from quorumql.operators import statements as statements_module
from quorumql.operators.statements import describe_error, run_statements


def test_capped_rows_errors_and_order(spark):
    texts = [
        ("a", "SELECT id FROM range(100) ORDER BY id DESC"), ("b", "SELECT * FROM range(3)"), ("c", "SELECT nope"),
        ("d", "CREATE TABLE t AS SELECT 1"), ("e", "SELECT 1/0"), ("f", "SELECT 1 AS x, 2 AS x"), ("g", "SELECT 1 WHERE false"),
        ("h", "SELECT id FROM range(100) ORDER BY id DESC"), ("i", "VALUES (1), (2)"), ("j", "SELECT 1 -- note"), ("k", "")]
    statements = spark.createDataFrame(texts, "name string, sql string")
    executions, results = run_statements(statements, max_rows=5)
    found = {r.name: r for r in executions.collect()}
    assert (found["a"].row_count, found["a"].truncated, found["a"].error) == (5, True, None)
    assert (found["b"].row_count, found["b"].truncated) == (3, False)
    for failed in "cde":
        assert found[failed].error and found[failed].row_count is None
    assert found["f"].columns == ["x", "x"] and found["g"].row_count == 0 and found["j"].row_count == 1
    rows = {}
    for r in results.orderBy("name", "row_pos").collect():
        rows.setdefault(r.name, []).append((r.row_pos, r.cells))
    assert rows["a"] == rows["h"] == [(i, [f"d:{99 - i}"]) for i in range(5)]
    assert rows["f"] == [(0, ["d:1", "d:2"])] and set(rows) == set("abfhij")
    assert not spark.catalog.tableExists("t")


def test_positions_follow_order_by_across_partitions(spark):
    statements = spark.createDataFrame([("a", "SELECT id * 7919 % 100003 AS x FROM range(0, 20000, 1, 8) ORDER BY x")], "name string, sql string")
    _, results = run_statements(statements)
    values = [int(r.cells[0][2:]) for r in results.orderBy("row_pos").collect()]
    assert values == sorted(values) and len(values) == 20000
    assert [r.row_pos for r in results.orderBy("row_pos").collect()] == list(range(20000))


def test_zero_and_negative_caps(spark):
    statements = spark.createDataFrame([("a", "SELECT * FROM range(3)")], "name string, sql string")
    executions, results = run_statements(statements, max_rows=0)
    row = executions.collect()[0]
    assert (row.row_count, row.truncated, results.count()) == (0, True, 0)
    executions, results = run_statements(statements, max_rows=-1)
    assert "non-negative" in executions.collect()[0].error and results.count() == 0


def test_deadline(spark):
    # Many short tasks: a cancelled job ends with the tasks it has running.
    slow = "SELECT sum(sqrt(id)) FROM range(0, 100000000000, 1, 20000)"
    statements = spark.createDataFrame([("slow", slow), ("fast", "SELECT 1")], "name string, sql string")
    executions, _ = run_statements(statements, timeout_s=3)
    found = {r.name: r for r in executions.collect()}
    assert "deadline" in found["slow"].error and found["slow"].elapsed_s < 30
    assert found["fast"].error is None


def test_errors_differ_and_text_is_not_spliced(spark):
    texts = [("a", "SELECT aaa FROM range(1)"), ("b", "SELECT zzz FROM range(1)"), ("c", "SELECT 1) x, (SELECT 2"), ("d", "SELECT 1 /* open"),
             ("e", "SELECT * FROM no_table_a"), ("f", "SELECT * FROM no_table_b"), ("g", "SELECT aaa FROM range(1)")]
    executions, results = run_statements(spark.createDataFrame(texts, "name string, sql string"))
    found = {r.name: r for r in executions.collect()}
    assert all(r.error for r in found.values()) and results.count() == 0
    assert len({r.error for r in found.values()}) == 6 and found["a"].error == found["g"].error and "aaa" in found["a"].error
    assert found["a"].error_condition == found["b"].error_condition == "UNRESOLVED_COLUMN.WITH_SUGGESTION"


def test_equal_texts_of_two_databases(spark):
    def session(name):
        own = spark.newSession()
        own.sql(f"SELECT '{name}' AS owner").createOrReplaceTempView("t")
        return own

    rows = [(db, copy, "SELECT owner FROM t") for db in ("x", "y") for copy in (0, 1)]
    statements = spark.createDataFrame(rows, "db_id string, copy int, sql string")
    _, results = run_statements(statements, database="db_id", sessions=session)
    assert sorted((r.db_id, r.copy, r.cells[0]) for r in results.collect()) == [(db, c, f"s:{db}") for db in ("x", "y") for c in (0, 1)]


def _same(spark, texts, **options):
    """Rows and outcomes without times, by name."""
    executions, results = run_statements(spark.createDataFrame(texts, "name string, sql string"), **options)
    rows = {}
    for r in results.orderBy("name", "row_pos").collect():
        rows.setdefault(r.name, []).append((r.row_pos, r.cells))
    return {r.name: (r.error, r.error_condition, r.row_count, r.truncated, r.columns) for r in executions.collect()}, rows


def test_batches_give_what_each_text_gives_alone(spark):
    texts = [(f"good{i:04}", f"SELECT id % {i % 7 + 2} AS k, count(*) AS n FROM range({i + 1}) GROUP BY 1 ORDER BY 2 DESC, 1") for i in range(14)]
    texts += [(f"plain{i}", f"SELECT {i} AS a, 'x' AS b, 1.5D AS c") for i in range(6)]
    texts += [("zero", "SELECT 1/0"), ("late", "SELECT 1 / (id - 5) FROM range(10)"), ("cast", "SELECT cast(concat('a', id DIV 10) AS int) FROM range(3)"), ("gone", "SELECT nope FROM range(1)"),
              ("open", "SELECT (1"), ("empty", "SELECT 1 AS x WHERE false"), ("blank", " "), ("same", "SELECT 1/0"), ("many", "SELECT id FROM range(50) ORDER BY id DESC")]
    together = _same(spark, texts, max_rows=10, workers=3)
    alone = _same(spark, texts, max_rows=10, batch=1)
    assert together == alone
    assert [r[0] for r in together[1]["many"]] == list(range(10)) and together[1]["many"][0][1] == ["d:49"]
    assert {n for n, e in together[0].items() if e[0]} == {"zero", "late", "cast", "gone", "open", "same", "blank"}


def test_a_thousand_texts_are_few_jobs(spark, monkeypatch):
    written = []
    real = statements_module._write_together

    def counting(own, texts, folder, timeout_s):
        written.append((len(texts), folder))
        return real(own, texts, folder, timeout_s)

    monkeypatch.setattr(statements_module, "_write_together", counting)
    texts = [(f"t{i}", f"SELECT {i} AS x") for i in range(1000)]
    executions, results = run_statements(spark.createDataFrame(texts, "name string, sql string"), timeout_s=300, workers=2)
    assert len(written) <= 20 and sum(n for n, _ in written) == 1000 and len({f for _, f in written}) <= 2
    assert {(r.name, r.cells[0]) for r in results.collect()} == {(f"t{i}", f"d:{i}") for i in range(1000)}
    assert executions.where("error IS NULL AND row_count = 1").count() == 1000


def test_a_slow_text_does_not_take_others_with_it(spark):
    slow = "SELECT sum(sqrt(id)) AS s FROM range(0, 100000000000, 1, 20000)"
    texts = [(f"t{i}", f"SELECT {i} AS x") for i in range(12)] + [("slow", slow)]
    outcomes, rows = _same(spark, texts, timeout_s=4, workers=1)
    assert "deadline" in outcomes.pop("slow")[0]
    assert all(e[0] is None for e in outcomes.values()) and len(rows) == 12


def test_error_texts_keep_what_stands_in_the_statement(spark):
    texts = [("a", "SELECT `a#1` FROM range(1)"), ("b", "SELECT `a#2` FROM range(1)"), ("c", "SELECT `a#2` FROM range(1)"), ("d", "SELECT id, count(*) FROM range(3)")]
    first, _ = _same(spark, texts)
    again, _ = _same(spark, texts)
    assert first == again
    assert "a#1" in first["a"][0] and "a#2" in first["b"][0] and first["a"][0] != first["b"][0] and first["b"] == first["c"]
    assert describe_error(Exception("no column id#12L in x#3"), "SELECT `x#3`")[0] == "no column id in x#3"


def test_rows_of_a_text_are_not_brought_into_one_task(spark):
    statements = spark.createDataFrame([(1, "SELECT id FROM range(0, 3000, 1, 4)"), (2, "SELECT 5")], "index int, sql string")
    _, results = run_statements(statements, timeout_s=60)
    # Numbers of texts and of their parts are small and known to be, so large results stay where they were read.
    assert "SortMergeJoin" not in results._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["index"], r.row_pos) for r in results.collect()) == [(1, i) for i in range(3000)] + [(2, 0)]
