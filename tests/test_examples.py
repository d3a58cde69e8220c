"""One JSON array read by many tasks, against the standard library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quorumql.sources.examples import json_array_records, read_examples
from testbed import inputs

AWKWARD = ['{', '}', '}, {', '"', '\\', '\\"', '\\\\"}', '],[', '[{"a": 1}]', "\n", "é😀", "", "}" * 40, '"}"', "\\u007d"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def stored(tmp_path, text):
    path = tmp_path / "split.json"
    path.write_text(text, encoding="utf-8")
    return str(path)


def records(n, rng):
    made = []
    for i in range(n):
        text = "".join(rng.choice(AWKWARD) for _ in range(rng.randrange(6)))
        made.append({"question_id": i * 3, "db_id": f"db{i % 3}", "question": text, "SQL": text[::-1] or "SELECT 1",
                     **({"evidence": text + "x"} if i % 2 else {}), **({"extra": {"deep": [{"a": [text, {}]}, []]}} if i % 5 == 0 else {})})
    return made


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "separators": (" ,\n", " : ")}])
def test_records_and_places_equal_the_standard_library(spark, tmp_path, small_splits, layout):
    made = records(150, random.Random(len(layout)))
    path = stored(tmp_path, json.dumps(made, **layout))
    raw = spark.read.option("lineSep", "}").text(path)
    assert raw.rdd.getNumPartitions() > 20
    found = {r.place: json.loads(r.record) for r in json_array_records(spark, path).collect()}
    assert found == dict(enumerate(made))
    read = read_examples(spark, path).orderBy("index").collect()
    assert [(r["index"], r.question_id, r.question, r.evidence, r.gold_sql, r.difficulty) for r in read] == [
        (i, m["question_id"], m["question"], m.get("evidence", ""), m["SQL"], "unknown") for i, m in enumerate(made)]


def test_small_arrays(spark, tmp_path):
    for text, n in (("[]", 0), (" [ \n ] \n", 0), ('[{"db_id": "d", "question": "q", "SQL": "s"}]', 1), ('\n[ {"db_id":"d","question":"}","SQL":"{"} ]\n', 1)):
        assert read_examples(spark, stored(tmp_path, text)).count() == n


@pytest.mark.parametrize("text", [
    "", "{}", '[{"db_id": "d"}', '[{"db_id": "d"} {"db_id": "d"}]', '[{"db_id": "d"},]', '[1, {"db_id": "d"}]', '[{"db_id": "d"}, 2]', '[{"db_id": "d"}]]',
    '[{"db_id": "d}]', '[{"db_id": "d", "question": "q", "SQL": "s"},, {"db_id": "d", "question": "q", "SQL": "s"}]', '[{"db_id" "d"}]', "[", "1"])
def test_broken_arrays_are_errors(spark, tmp_path, text):
    with pytest.raises(Exception):
        read_examples(spark, stored(tmp_path, text)).collect()


def test_no_task_holds_the_whole_array(spark, tmp_path, small_splits):
    path = stored(tmp_path, json.dumps(records(400, random.Random(1))))
    found = json_array_records(spark, path)
    assert found.count() == 400 and found.agg(F.max(F.length("record"))).first()[0] < 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan.lower()


def test_one_file_is_sorted_by_many_tasks_and_keeps_the_order(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        rows = spark.range(500).repartition(4).orderBy("id").select(F.concat_ws(":", F.spark_partition_id(), "id").alias("value"))
        inputs.write_one_file(rows, str(tmp_path / "one"))
    finally:
        spark.conf.set(name, before)
    (file,) = (tmp_path / "one").glob("part-*")
    tasks, ids = zip(*(line.split(":") for line in file.read_text().split()))
    assert list(map(int, ids)) == list(range(500))
    assert len(set(tasks)) == 4  # the task that writes has sorted none of them
