"""Stored profiles: same texts as built anew, no data read twice, changed tables alone profiled again."""

import os

from pyspark.sql import functions as F

from quorumql.operators.dictionary import build_contexts
from quorumql.plans import stored_contexts as plan
from quorumql.plans.stored_contexts import stored_contexts


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def texts(df):
    return sorted(tuple(r) for r in df.collect())


def test_contexts_come_from_stored_profiles(spark, tmp_path, monkeypatch):
    places = {db: {t: str(tmp_path / db / t) for t in ts} for db, ts in (("x", ("a", "b")), ("y", ("a",)))}
    for i, path in enumerate(p for ts in places.values() for p in ts.values()):
        write(spark, path, [(k, f"v{k % (i + 2)}", None if k % 3 else k / 7) for k in range(20 + i)], "id int, word string, day_share double")
    built = lambda **o: texts(build_contexts(spark, {db: {t: spark.read.parquet(p) for t, p in ts.items()} for db, ts in places.items()}, **o))
    profiled = []
    real = plan.profile_tables
    monkeypatch.setattr(plan, "profile_tables", lambda tables, *a: profiled.append(sorted(tables)) or real(tables, *a))
    store = str(tmp_path / "store")
    expected = built()
    assert texts(stored_contexts(spark, places, store)) == expected
    assert profiled == [[("x", "a"), ("x", "b"), ("y", "a")]]

    # Spoiled contents of the same name, length and time: the second run must not read them.
    data = [f for f in (tmp_path / "x" / "b").iterdir() if f.name.startswith("part-")][0]
    kept, stat = data.read_bytes(), os.stat(data)
    data.write_bytes(b"\0" * len(kept))
    os.utime(data, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert texts(stored_contexts(spark, places, store)) == expected and len(profiled) == 1
    data.write_bytes(kept)
    os.utime(data, ns=(stat.st_atime_ns, stat.st_mtime_ns))

    write(spark, places["x"]["b"], [(1, "new", 2.0)], "id int, word string, day_share double")
    changed = texts(stored_contexts(spark, places, store))
    assert profiled[1:] == [[("x", "b")]] and changed == built() != expected
    assert texts(stored_contexts(spark, places, store, mode="off")) == built(mode="off") and len(profiled) == 2
    stored_contexts(spark, places, store, top_k=1)
    assert len(profiled[2]) == 3  # other settings, other profiles
    assert texts(stored_contexts(spark, places, store)) == changed and len(profiled) == 3


def test_fingerprints_read_no_contents(spark, tmp_path):
    write(spark, str(tmp_path / "t"), [(1,)], "a int")
    found = plan.fingerprints(spark, {"d": {"t": str(tmp_path / "t")}})
    assert found.where(F.col("fingerprint").isNotNull()).count() == 1
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
