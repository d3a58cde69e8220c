import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quorumql.session import freeze, new_folder, scratch, shared_folder
from quorumql.sources.sqlite import ingest_sqlite, list_tables, read_sqlite
from quorumql.operators.metrics import running_accuracy
from quorumql.streaming.progress import (
    keyed_state_session, read_progress, read_running_accuracy, stream_progress, stream_running_accuracy)


def make_file(path, rows=5000):
    with sqlite3.connect(path) as connection:
        connection.execute('CREATE TABLE "odd name" (id INTEGER PRIMARY KEY, label TEXT, amount REAL, raw BLOB, loose)')
        connection.executemany('INSERT INTO "odd name" VALUES (?, ?, ?, ?, ?)', [
            (i * 2, f"n{i}" if i % 3 else None, i / 4, bytes([i % 256]), i if i % 2 else "text") for i in range(rows)])
        connection.execute("CREATE TABLE empty (x INT)")
        connection.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        connection.execute("INSERT INTO keyed VALUES ('a', 1)")
    connection.close()


def test_sqlite_tables_in_ranges(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    make_file(path)
    assert list_tables(path) == ["empty", "keyed", "odd name"]
    df = read_sqlite(spark, path, "odd name", rows_per_partition=1000)
    assert df.rdd.getNumPartitions() == 10
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "binary", "string"]
    row = df.agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.sum("amount").alias("total"), F.min("loose").alias("loose")).collect()[0]
    assert (row.n, row.labels, row.total, row.loose) == (5000, 3333, sum(i / 4 for i in range(5000)), "1")
    assert read_sqlite(spark, path, "empty").count() == 0
    assert read_sqlite(spark, path, "keyed").collect()[0].v == 1


def test_sqlite_values_are_never_lost(spark, tmp_path):
    path = str(tmp_path / "odd.sqlite")
    with sqlite3.connect(path) as connection:
        connection.execute("CREATE TABLE t (n INT, p POINT, r REAL)")
        connection.execute("INSERT INTO t VALUES (1, 2, 3.5), ('one', '(1,2)', 'x'), (2.5, NULL, 1)")
        connection.execute("CREATE TABLE sparse (id INTEGER PRIMARY KEY)")
        connection.execute("INSERT INTO sparse VALUES (-9000000000000000000), (0), (9000000000000000000)")
    connection.close()
    with pytest.raises(Exception, match="read the table as text"):
        read_sqlite(spark, path, "t").collect()
    rows = read_sqlite(spark, path, "t", as_text=True).collect()
    assert sorted(r.n for r in rows) == ["1", "2.5", "one"] and {r.p for r in rows} == {"2", "(1,2)", None}
    assert read_sqlite(spark, path, "sparse", rows_per_partition=10**18).count() == 3
    assert read_sqlite(spark, path, "sparse", rows_per_partition=1000).rdd.getNumPartitions() <= 1001


def test_ingest(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    make_file(path, 50)
    written = ingest_sqlite(spark, {"d": path}, str(tmp_path / "out"))
    assert set(written["d"]) == {"empty", "keyed", "odd name"}
    assert spark.read.parquet(written["d"]["odd name"]).count() == 50


def test_freeze_uses_the_shared_folder(spark):
    assert shared_folder(spark)
    frozen = freeze(spark.range(10))
    assert frozen.count() == 10 and all(shared_folder(spark).split(":")[-1] in f for f in frozen.inputFiles())


def test_stream_progress_over_arriving_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    flags = lambda low, high: spark.range(low, high).select(
        (F.col("id") % 3).alias("run_id"), (F.col("id") % 2 == 0).alias("exec_match"), (F.col("id") % 5 != 0).alias("executable"))
    seen = flags(0, 100)
    seen.write.parquet(source)
    stream = spark.readStream.schema(seen.schema).parquet(source)
    stream_progress(stream, out, checkpoint=state).awaitTermination()
    first = {r.run_id: r.completed for r in read_progress(spark, out).collect()}
    assert first == {0: 34, 1: 33, 2: 33}
    flags(100, 160).where("run_id = 1").write.mode("append").parquet(source)
    stream_progress(stream, out, checkpoint=state).awaitTermination()
    second = {r.run_id: (r.completed, r.exec_matches) for r in read_progress(spark, out).collect()}
    expected = flags(0, 160).where("run_id = 1").agg(F.count("*"), F.count_if("exec_match")).collect()[0]
    assert second[1] == tuple(expected) and second[0][0] == 34


class _Cluster:
    """A session as a cluster's would look: no local master, no shared folder set."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Cluster)


def test_scratch_removes_its_folders_alone(spark):
    kept = freeze(spark.range(3))
    with scratch(spark):
        inner = freeze(spark.range(4))
        gone = inner.inputFiles()[0].split(":", 1)[1]
        assert inner.count() == 4
        assert new_folder(spark, "x").startswith(shared_folder(spark))
    assert kept.count() == 3
    assert not os.path.exists(gone.replace("//", "/"))


def test_running_accuracy_of_a_stream_equals_the_batch_one(spark, tmp_path):
    own = keyed_state_session(spark)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(i * 7 % 3 if i < 90 else 3, i, None if i % 11 == 0 else i % 2 == 0, i % 5 != 0) for i in range(100)]
    flags = own.createDataFrame(rows, "run_id long, index long, exec_match boolean, executable boolean")
    whole = flags.join(flags.groupBy("run_id").agg(F.count("*").alias("expected")), "run_id")
    expected = {tuple(r) for r in running_accuracy(flags, 7).collect()}
    for low, high in ((0, 40), (40, 41), (41, 100)):  # each part in a query of its own, from the same checkpoint
        whole.where((F.col("index") >= low) & (F.col("index") < high)).repartition(3).write.mode("append").parquet(source)
        stream = own.readStream.schema(whole.schema).parquet(source)
        stream_running_accuracy(stream, out, 7, checkpoint=state).awaitTermination()
    told = read_running_accuracy(spark, out).collect()
    assert {(r.run_id, r.completed, r.exec_acc, r.executable_rate) for r in told} == expected and len(told) == len(expected)
    assert len({r.batch_id for r in told}) > 1
    with pytest.raises(ValueError, match="RocksDB"):
        stream_running_accuracy(spark.readStream.schema(whole.schema).parquet(source), out)
    with pytest.raises(ValueError, match="positive"):
        stream_running_accuracy(stream, out, 0)
