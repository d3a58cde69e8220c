import json
import random

import pytest
from pyspark.sql import functions as F

from quorumql.operators import grid, selection, strategies
from quorumql.operators.positions import running, with_group_position, with_position
from quorumql.operators.ranks import keys_at
from quorumql.sources.examples import read_examples


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("index"), F.concat(F.lit("db_"), F.col("id") % 2).alias("db_id"))


def indexes(df):
    return sorted(r["index"] for r in df.collect())


def test_with_position_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit("pad").alias("pad"))
    assert all(r.x == r.position for r in with_position(df, ["x"]).collect())


def test_positions_survive_one_heavy_value(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), "id")
    rows = with_position(df, ["hot", "id"]).collect()
    expected = {r: i for i, r in enumerate(sorted((x.hot, x.id) for x in rows))}
    assert all(expected[(r.hot, r.id)] == r.position for r in rows)


def test_group_position_and_running_with_a_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % 50).alias("g"), "id", (F.col("id") % 7).alias("v"))
    rows = running(with_group_position(df, ["g"], ["id"]), ["g"], ["id"], {"total": F.col("v")}).collect()
    expected, count = {}, {}
    for r in sorted(rows, key=lambda r: r.id):
        expected[r.g] = expected.get(r.g, 0) + r.v
        assert r.total == expected[r.g] and r.position == count.get(r.g, 0)
        count[r.g] = count.get(r.g, 0) + 1
    assert len(rows) == 4000


def test_running_max_without_the_row_itself(spark):
    df = spark.range(200).select("id", ((F.col("id") * 37) % 101).alias("v"))
    rows = sorted(running(df, [], ["id"], {"best": F.col("v")}, inclusive=False, combine="max").collect())
    best = None
    for r in rows:
        assert r.best == best
        best = r.v if best is None else max(best, r.v)


def test_slices(spark):
    five = numbers(spark, 5)
    assert indexes(selection.slice_rows(five, 1, 2)) == [1, 2]
    assert indexes(selection.slice_rows(five, -1)) == [0, 1, 2, 3, 4]
    assert indexes(selection.slice_rows(five, 0, 0)) == []
    assert indexes(selection.slice_rows(five, 3, 10)) == [3, 4]
    assert indexes(selection.slice_strict(five, 2, 0)) == [2, 3, 4]
    with pytest.raises(ValueError):
        selection.slice_strict(five, -1, 3)
    with pytest.raises(ValueError):
        selection.slice_rows(five, 0, -2)
    assert indexes(selection.select_examples(five, "db_0", 1, 5)) == [2, 4]
    assert indexes(selection.filter_by_db(five, "")) == [0, 1, 2, 3, 4]


def test_split_defaults_do_not_overlap(spark):
    split = selection.train_eval_split(numbers(spark, 100), train_limit=60, eval_limit=30).collect()
    train = {r["index"] for r in split if r.split == "train"}
    evaluation = {r["index"] for r in split if r.split == "eval"}
    assert len(train) == 60 and len(evaluation) == 30 and not train & evaluation


def test_split_edges(spark):
    ten = numbers(spark, 10)
    everything = selection.train_eval_split(ten, train_limit=0, eval_limit=5, seed=None).collect()
    assert {r.split for r in everything} == {"train"} and len(everything) == 10
    rows = selection.train_eval_split(ten, 0, 6, eval_offset=4, eval_limit=0, seed=None).collect()
    assert sorted(r["index"] for r in rows if r.split == "eval") == [4, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        selection.require_train_rows(selection.train_eval_split(ten, 10, 5))


def test_shuffle_depends_on_the_seed_only(spark):
    place = lambda seed, parts: [tuple(r) for r in sorted(
        selection.seeded_shuffle(numbers(spark, 50).repartition(parts), seed).select("index", "position").collect())]
    assert place(1, 2) == place(1, 7) != place(2, 2)


def test_batches(spark):
    placed = with_position(numbers(spark, 10), ["index"])
    assert indexes(selection.batch(placed, 2, 4)) == [8, 9]
    for bad in (-1, 3):
        with pytest.raises(IndexError):
            selection.batch(placed, bad, 4)
    with pytest.raises(ValueError):
        selection.assign_batches(placed, 0)
    assert selection.count_batches(placed, 4).collect()[0].num_batches == 3
    assert selection.replicate(placed, 3).count() == 30


def test_preview(spark):
    rows = {r.db_id: (r.num_examples, r.num_databases) for r in selection.preview(numbers(spark, 5)).collect()}
    assert rows == {"db_0": (3, 1), "db_1": (2, 1), None: (5, 2)}


def test_grid_order_and_tags(spark):
    base = spark.createDataFrame([("m", 1)], "model string, group_size int")
    arms = grid.config_grid(base, {"learning_rate": ["1e-05", "3e-05"], "group_size": [8, 16]})
    tags = arms.orderBy("arm_index").select(grid.config_tag(["learning_rate", "group_size", "model"])).collect()
    assert [t[0] for t in tags] == ["lr1e-05_gs8_modem", "lr1e-05_gs16_modem", "lr3e-05_gs8_modem", "lr3e-05_gs16_modem"]
    assert grid.config_grid(base, {"x": []}).count() == 0
    assert grid.config_grid(base, {}).count() == 1


RECORDS = [
    {"question_id": 5, "db_id": "d", "question": "q0", "evidence": "e", "SQL": "select 1", "difficulty": "simple"},
    {"db_id": "d", "question": "é", "SQL": "select 2"},
    {"question_id": "7", "db_id": "c", "question": "q2", "evidence": None, "SQL": "select 3"},
]


def test_read_examples_array(spark, tmp_path):
    path = tmp_path / "dev.json"
    path.write_text(json.dumps(RECORDS, indent=1), encoding="utf-8")
    rows = [tuple(r) for r in read_examples(spark, str(path)).orderBy("index").collect()]
    assert rows == [
        (0, 5, "d", "q0", "e", "select 1", "simple"),
        (1, -1, "d", "é", "", "select 2", "unknown"),
        (2, 7, "c", "q2", "", "select 3", "unknown"),
    ]


def test_read_examples_from_a_folder_of_arrays(spark, tmp_path):
    for first, records in ((0, RECORDS[:2]), (2, RECORDS[2:])):
        (tmp_path / f"first={first}").mkdir()
        (tmp_path / f"first={first}" / "part.json").write_text(json.dumps(records, indent=1), encoding="utf-8")
    rows = [(r["index"], r.question_id, r.question) for r in read_examples(spark, str(tmp_path), "json_arrays").orderBy("index").collect()]
    assert rows == [(0, 5, "q0"), (1, -1, "é"), (2, 7, "q2")]


def test_array_query_writes_bounded_files(spark, folder, monkeypatch):
    from testbed import selection as queries

    monkeypatch.setattr(queries, "ARRAY_ROWS", 100, raising=False)
    done = queries._read_examples_array(spark, folder)
    keys = sorted(r[0] for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey").collect())
    assert sorted((r["index"], r.question_id) for r in done.collect()) == list(enumerate(keys))
    assert len(done.inputFiles()) == -(-len(keys) // 100)


def test_read_examples_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_examples(spark, str(tmp_path / "none.json")).collect()
    path = tmp_path / "bad.json"
    path.write_text(json.dumps([{"db_id": "d", "SQL": "x"}]))
    with pytest.raises(Exception, match="without question"):
        read_examples(spark, str(path)).collect()


def test_strategies(spark):
    examples = spark.createDataFrame([(0, "select 1"), (1, "select 2")], "index long, gold_sql string")
    assert [r.sql for r in strategies.gold_oracle(examples).orderBy("index").collect()] == ["select 1", "select 2"]
    stored = spark.createDataFrame(
        [(0, 0, "x", "raw", None, 1.0, 1, 0, 5, 5), (0, 1, "y", "raw", "down", 1.0, 1, 1, 1, 2)],
        "index long, sample_index int, sql string, raw_output string, generation_error string, latency_s double, "
        "query_tool_calls int, prompt_tokens long, completion_tokens long, total_tokens long")
    rows = {(r["index"], r.sample_index): r for r in strategies.stored_generations(examples, stored, 2).collect()}
    assert len(rows) == 4
    assert rows[0, 0].sql == "x" and rows[0, 0].prompt_tokens is None and rows[0, 0].completion_tokens == 5
    assert rows[0, 1].sql == "" and rows[0, 1].generation_error == "down"
    assert rows[1, 0].sql == "" and rows[1, 0].generation_error == strategies.NO_GENERATION
    with pytest.raises(ValueError):
        strategies.strategy("other")


def test_slices_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, "x"), (3, "a"), (1, "b")], "index long, name string")
    assert sorted(r.name for r in selection.slice_rows(rows, 0, 2).collect()) == ["b", "x"]
    assert [r.name for r in selection.slice_rows(rows, 2, None).collect()] == ["a"]


def test_keys_at_ranks_equal_a_sort(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 0.0, -1.5, float("nan"), 2.0, 7.0]), None if i % 13 == 0 else f"k{rng.randrange(400):03}", i) for i in range(3000)]
    rows += [(2.0, "heavy", 5)] * 900  # one key that a quarter of the rows share
    df = spark.createDataFrame(rows, "a double, b string, c int").repartition(5)
    for order in (["a", "b", "c"], ["b", "c"], ["c"]):
        expected = [tuple(r) for r in df.select(*order).orderBy(*order).collect()]
        ranks = [0, 1, 777, 1500, 2800, 3899, 3900, -1]
        got = keys_at(df, order, ranks, splitters=8, small=50)
        assert [repr(k) for k in got] == [repr(expected[r]) if 0 <= r < len(expected) else "None" for r in ranks]


def test_slices_with_null_keys_and_no_sort(spark):
    df = spark.createDataFrame([(None, "n"), *((i, f"t{i}") for i in range(40))], "index int, text string").repartition(4)
    assert sorted(r.text for r in selection.slice_rows(df, 0, 3).collect()) == ["n", "t0", "t1"]
    assert sorted(r.text for r in selection.slice_rows(df, 39).collect()) == ["t38", "t39"]
    assert selection.slice_rows(df, 41).count() == selection.slice_rows(df, 100, 5).count() == 0
    plan = selection.slice_rows(df, 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan and "Join" not in plan
