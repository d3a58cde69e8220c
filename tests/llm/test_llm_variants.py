"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from quorumql.llm import variants
from quorumql.llm.variants import near_pairs, spelling_variants, word_counts


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_counts(rows, least=6):
    counts = Counter()
    for key, text, *_ in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_count=5, ratio=5):
    words = {w: n for w, n in brute_counts(rows).items() if n >= least_count}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return out


def found(df, **options):
    rows = spelling_variants(df, **options).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["strasse", "straße", "Ünïcode", "÷×÷×÷×", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(5, 60)):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "c" + w[k:], w[:k] + "c" + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "_", "中", "\n"]).join(words), "x", i))
    return rows


ROWS = texts() + [(None, "doubled word doubled word " * 3, None, 1), (1000, None, "a", None), (1001, "", "b", 2), (1002, "😀 ĀāŁł ŒœŸ", "c", 3), (1003, "longword " * 40_000, "d", 4)]
ROWS += [ROWS[3], ROWS[3]]  # repeated rows
SCHEMA = "doc_id long, text string, word string, n int"


@pytest.mark.parametrize("block, parts", [(2048, 3), (3, 3), (5, 1), (4, 6)])
def test_variants_equal_brute_force(spark, block, parts):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert found(df, block=block, parts=parts) == brute(ROWS)


def test_counts_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 10)
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.word: r.n for r in word_counts(df).collect()} == brute_counts(ROWS)


def test_tiles_hold_every_near_pair_in_one_piece():
    rng = random.Random(8)
    for length in (6, 7, 11):
        words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (length, length - 1) for _ in range(150)})
        left = [w for w in words if len(w) == length]
        for parts in (1, 2, 3, 4):
            ranges, pairs = variants.pieces(length, parts), []
            for piece, (head, tail) in enumerate(ranges):
                ends = lambda w: (w[:head], w[len(w) - tail :])  # noqa: B023, E731
                for group in {ends(w) for w in left}:
                    one, two = [w for w in left if ends(w) == group], [w for w in words if ends(w) == group]
                    for i, j in near_pairs(one, two, length, piece, parts):
                        pairs += [(one[p], two[q]) for p, q in zip(i.tolist(), j.tolist())]
            assert sorted(pairs) == sorted((a, b) for a in left for b in words if one_edit(a, b))


def test_ties_chains_and_no_words(spark):
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdeh"] * 25 + ["abcxeg"] * 125 + ["qqqqqq"] * 4))]
    assert not any(zlib.crc32(f"1:{w}".encode()) % 199 == 0 for w in ("abcdef", "abcdeg", "abcdeh", "abcxeg"))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {"abcdef": (5, 2, "abcdeg", 25, "abcxeg"), "abcdeg": (25, 3, "abcxeg", 125, "abcxeg"), "abcdeh": (25, 2, None, None, "abcdeh"), "abcxeg": (125, 1, None, None, "abcxeg")}
    for empty in ([], [(1, None)], [(1, "short ones only")]):
        assert found(spark.createDataFrame(empty, "doc_id long, text string")) == {}
