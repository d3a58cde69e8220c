"""The Jaccard join against all pairs, and the tree against all pairs."""

import random

import numpy as np
import pytest

from quorumql.llm import jaccard
from quorumql.llm.jaccard import CountTree, band_count, band_keys, close_enough, group_counts, least_apart, near_sets, needed, own_bands, parity_sketch, size_classes

SCHEMA = "doc_id long, text string, id string, label int, n int"


def shingles(text, words=3):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, num=90, den=100):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (key, *_) in enumerate(rows):
        keys = [r[0] for r, x in zip(rows, label) if x == label[i] and r[0] is not None]
        out.append((str(key), len(sets[i]), str(min(keys, default=None))))
    return sorted(out)


def found(df, **options):
    return sorted((str(r.key), r.n_shingles, str(r.component)) for r in near_sets(df, **options).collect())


def texts(seed=1, families=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, None, "x", 1, 1), (None, "", "x", 1, 1), (900, " \t\n\x0b", "y", 2, 1), (901, "One", "y", 2, 1), (902, "oNE", None, None, None), (903, "one two", "z", 3, 2),
            (904, "one two", "z", 3, 2), (904, "one two", "z", 3, 2), (905, "a b a b a b a b", "z", 1, 2), (906, "a\tb\fa b", "z", 1, 2), (907, "É é", "z", 1, 1), (908, "é É", "z", 1, 1)]
    for f in range(families):
        size = rng.choice((4, 9, 12, 19, 20, 40, 120, 700))
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.choice((1, 2, 3, 25))):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [own[k], rng.choice(vocabulary)]))
                own = own or ["w"]
            if rng.random() < 0.2:
                own = own + own[: size // 15]
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.3 else " ".join(own), "x", f, 0))
    common = " ".join(rng.choice(vocabulary) for _ in range(60))  # a passage that many documents share
    rows += [(2000 + i, common + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 8, 40)))), "p", 0, 0) for i in range(30)]
    chain = [rng.choice(vocabulary) for _ in range(100)]  # neighbours link, the ends don't
    for i in range(12):
        chain = chain[:-1] + [f"new{i}"] if i % 2 else [f"old{i}"] + chain[1:]
        chain[50 + i] = f"mid{i}"
        rows.append((3000 - i, " ".join(chain), "c", 0, 0))
    return rows


@pytest.mark.parametrize("windows", [jaccard.WINDOWS, (1, 4), (2,)])
def test_components_equal_brute_force(spark, windows):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df, windows=windows) == brute(rows)


def test_window_whose_members_come_in_several_batches(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):  # one long list, whose window of places 16 to 255 has trees over single batches
        own = list(base)
        own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own), "x", 0, 0))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "90")
        assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
        assert found(spark.createDataFrame(rows, SCHEMA), num=96) == brute(rows, num=96)
    finally:
        spark.conf.set(name, before)


def test_lower_thresholds_equal_brute_force(spark):
    rows = texts(seed=5, families=8)
    assert found(spark.createDataFrame(rows, SCHEMA), num=80) == brute(rows, num=80)


def test_table_without_links(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "all alone here", "", 0, 0), (2, None, "", 0, 0), (3, "nothing like the other one at all", "", 0, 0), (4, "word " * 200_000, "", 0, 0)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [("1", 1, "1"), ("2", 0, "2"), ("3", 5, "3"), ("4", 1, "4")]


@pytest.mark.parametrize("num", [90, 80, 60])
def test_linked_sets_agree_in_a_band_and_pass_the_bound(num):
    rng = np.random.default_rng(num)
    met = 0
    for size in [*range(1, 60), 200, 999, 4000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = rng.integers(0, len(a) * (100 - num) // num + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop // 2], rng.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
                met += 1
                assert set(band_keys(a, num)) & set(band_keys(b, num))
                p, q = group_counts(a)[None], group_counts(b)[None]
                assert close_enough(p, np.array([len(a)]), q, np.array([len(b)]), np.array([0]), np.array([0]), num).all()
    assert met > 50


@pytest.mark.parametrize("num", [90, 80, 60])
def test_sketches_bound_the_difference_from_below(num):
    rng = np.random.default_rng(num)
    sketches = lambda own: parity_sketch(own).view(np.uint64)[None]
    for size in [*range(1, 40), 200, 400, 999, 4000, 20000]:
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for share in (0.0, 0.02, 0.1, 0.3, 1.0):
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(share * len(a))], rng.integers(0, 2**63, int(share * len(a))).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            least = least_apart(sketches(a), sketches(b), np.array([0]), np.array([0]))[0]
            assert 0 <= least <= apart
            if 100 < size < 1000 and share < 0.2:
                assert least >= 0.8 * apart


def test_own_bands_come_first_and_link_sets_of_one_class():
    rng = np.random.default_rng(4)
    for size in [*range(0, 60), 200, 999]:
        own = rng.integers(0, 2**63, size).astype(np.uint64)
        starts = size_classes(90, 100, 5000)
        largest = starts[int(np.searchsorted(starts, size, side="right"))] - 1
        bands = band_count(largest)
        assert own_bands(size) == (bands if size and bands > 1 else 0) <= len(band_keys(own))


def test_texts_that_nearly_link_make_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):  # similar at about 0.86, so none links; one planted pair does
        own = list(base)
        for k in rng.sample(range(0, 400, 4), 5):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own), "x", 0, 0))
    rows.append((500, rows[7][1].replace("w200 ", "other "), "x", 0, 0))
    made, pairs = [], jaccard.window_pairs
    monkeypatch.setattr(jaccard, "window_pairs", lambda *a: made.append(pairs(*a).cache()) or made[-1])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = found(df)
    assert got == brute(rows) and len({c for _, _, c in got}) < 121
    assert sum(m.count() for m in made) < 3 * len(rows) * own_bands(398)  # before: with the square of the group's size


def test_long_lists_are_compared_block_by_block_with_guests(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(90):  # sizes on both sides of a class's end
        own = base[: rng.randrange(116, 130)]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(own), "x", 0, 0))
    assert found(spark.createDataFrame(rows, SCHEMA), windows=(1, 3)) == brute(rows)


def test_size_classes_of_partners_are_neighbours():
    for num in (60, 80, 90, 95):
        starts = size_classes(num, 100, 5000)
        place = lambda n: int(np.searchsorted(starts, n, side="right"))  # noqa: B023, E731
        assert all(place(n * 100 // num) - place(n) <= 1 for n in range(1, 4000))


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 12, (30, 16))
    points = np.concatenate([np.clip(base + rng.integers(-1, 2, base.shape), 0, None) for _ in range(9)]).astype(np.uint32)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = CountTree(points, sizes)
    assert len(tree.levels) > 3
    asked, got = tree.search(points[:80], sizes[:80])
    i, j = np.divmod(np.arange(80 * len(points)), len(points))
    kept = close_enough(points[:80], sizes[:80], points, sizes, i, j)
    assert sorted(zip(asked, got)) == sorted(zip(i[kept], j[kept])) and 80 < kept.sum() < 80 * len(points) // 2
