"""Exact and near duplicates against brute force, with the odd rows that tables hold."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quorumql.llm import simhash
from quorumql.llm.exact import chunks, drop_exact_copies, exact_groups
from quorumql.llm.graph import components
from quorumql.session import freeze

LONG = "Ein langer Satz ohne Ende " * 3000
ROWS = [
    (1, "Hello World.", "a", 0), (2, "hello world.", "b", 1), (3, "HELLO\nWORLD.", "c", 2), (4, None, None, 3), (5, "", "e", 4),
    (6, "École", "f", 5), (7, "école", "g", 6), (8, LONG, "h", 7), (9, LONG.upper(), "i", 8), (9, LONG.upper(), "i", 8),
    (10, LONG + "x", "j", 9), (None, "Hello World.", "k", 10), (None, "only once", None, 11), (11, "one two", "l", 12), (12, "one two", "l", 12),
    (12, "one two", "l", 12),
]
# Extra columns carry the names that the operators use inside.
SCHEMA = "doc_id long, text string, row string, fp int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return freeze(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "docs")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_equal_brute_force(spark, docs, weak):
    # A weak key puts different chunks under one key, which verification has to tell apart.
    options = {"hashed": lambda c: F.xxhash64(c) % 3, "least": 4, "most": 64} if weak else {}
    found = sorted((str(r.key), str(r.keep_key), r.group_size, r.sha) for r in exact_groups(docs, **options).collect())
    groups = {}
    for key, text, *_ in ROWS:
        groups.setdefault(lowered(text), []).append(key)
    expected = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected += [(str(k), str(keep), len(keys), digest) for k in keys]
    assert found == sorted(expected)


def test_one_of_each_group_stays(docs):
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r[1]) for r in ROWS})


def test_chunks_put_together_are_the_text(spark):
    texts = ["", "a", "x" * 5000, "One. Two! " * 400, "\n" * 300, LONG, "é😀" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", F.array_join(chunks(F.col("t")), "").alias("whole"), chunks(F.col("t")).alias("parts")).collect():
        assert row.t == row.whole and all(0 < len(p) <= 2049 for p in row.parts)


def test_empty_tables(spark):
    empty = freeze(spark.createDataFrame([], SCHEMA), "empty")
    assert exact_groups(empty).count() == simhash.near_groups(empty).count() == drop_exact_copies(empty).count() == 0
    assert simhash.drop_near_copies(empty).columns == empty.columns


def reference_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def brute_components(prints, bits=2):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def near_rows():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    rows = [(0, None, None, 0), (1, "", None, 1), (2, " \t\n", None, 2), (3, "one", None, 3), (4, "ONE", None, 4), (5, "one two", None, 5)]
    for i in range(20):
        base = [rng.choice(words) for _ in range(rng.choice((5, 60, 600)))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own), None, 0))
    return rows


def test_near_groups_equal_brute_force(spark):
    rows = near_rows()
    docs = freeze(spark.createDataFrame(rows, SCHEMA).repartition(4), "near")
    found = {r.key: r for r in simhash.near_groups(docs).collect()}
    prints = [reference_fingerprint(r[1]) for r in rows]
    assert [found[i].fp & (2**64 - 1) for i in range(len(rows))] == prints
    labels = brute_components(prints)
    assert [found[i].component for i in range(len(rows))] == labels
    assert sum(r.kept for r in found.values()) == len(set(labels)) == simhash.drop_near_copies(docs).count()


def test_null_keys_and_repeated_rows_leave_one(spark):
    rows = [(None, "same text here", "x", 1), (None, "same text here", "x", 1), (7, "same text here", "x", 1), (8, "quite another one of them", "y", 1)]
    docs = freeze(spark.createDataFrame(rows, SCHEMA).repartition(2), "nulls")
    assert simhash.drop_near_copies(docs).count() == 2
    assert {r.component for r in simhash.near_groups(docs).collect()} == {7, 8}


def test_links_of_large_lists_equal_those_of_small_ones(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (3, 40, 200):
        values = np.unique(rng.integers(0, 1 << 9, n).astype(np.uint64) | np.uint64(0xABCD << 40))
        small = simhash.list_links(values)
        monkeypatch.setattr(simhash, "TABLE", 1)
        large = simhash.list_links(values)
        monkeypatch.undo()
        assert (small == large).all()


def test_every_close_pair_meets_in_a_list(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    pairs = [(b, b ^ (1 << i) ^ (1 << j)) for b in base for i, j in [(rng.randrange(64), rng.randrange(64)) for _ in range(10)]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(x),) for x in {x for p in pairs for x in p}], "fp long")
    linked = {frozenset((r.a, r.b)) for r in simhash.links(simhash.postings(prints)).collect()}
    nodes = {r.node: r.root for r in components(spark.createDataFrame([tuple(p) for p in linked if len(p) == 2], "a long, b long")).collect()}
    root = lambda x: nodes.get(signed(x), signed(x))
    assert all(root(a) == root(b) for a, b in pairs)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 30)}}


@pytest.mark.parametrize("drop", [drop_exact_copies, simhash.drop_near_copies])
def test_stages_keep_their_rows_if_files_are_split_anew(spark, tmp_path, drop):
    texts = [f"story {i % 4} " + " ".join(f"w{i % 4}x{k}" for k in range(50 * (i % 4) + 40)) for i in range(8)]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, t)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        done = drop(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        assert sorted(r.text for r in done.collect()) == sorted(set(texts))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
