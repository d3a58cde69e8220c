"""Spelling variants grouped by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly if they are different, their lengths differ by
at most one, and their common prefix and common suffix together reach the longer length less one. A *tile* compares two
blocks of words at once: the words are rows of padded code-point matrices, one aligned at the start and one at the end,
and columns are compared until no pair of the tile agrees any more, which gives all prefix and suffix lengths.

Which blocks meet: with a pair's longer length l, an edit leaves the first p and the last l-1-p code points alone for
some p. The range of p is cut into ``PARTS`` pieces; a piece (from, to) shares the first ``from`` and the last l-to code
points for every p in it. Words are dealt by (l, piece, those code points), as the longer or the shorter word of l. Each
such group is dealt into blocks of at most ``BLOCK`` words, so that a task holds two blocks however common a beginning or
an ending is. A pair is counted in the first piece that it agrees with. Tiles return one row for each word with a near
word (how many, and the best one), never pairs.

Counting reads every text once: runs of letters up to U+00FF, in lower case for A-Z, and, for runs whose hash with the
document's key says so, less one code point. Counts of a task's words are added up in bounded tables before the shuffle.

Defined results: a null or empty text has no runs; a null key takes part in the hash as an empty text; repeated rows
count each time; a table without words gives no rows. Ties for a form go to the smaller word in code-point order. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumql.llm.common import slices
from quorumql.session import freeze

LEAST_LENGTH, LEAST_COUNT, RATIO, NOISE = 6, 5, 5, 199
PARTS, BLOCK = 3, 2048
#: Words that a task counts before it hands its counts on, and pairs of words that a step compares.
HELD, PAIRS = 200_000, 1 << 21
#: Latin-1 bytes to lower-case letters, anything else to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of letters in Latin-1; code points above U+00FF end a run like any other sign."""
    return text.encode("latin-1", "replace").translate(LETTERS).split(b" ") if text else []


def spelled(key: str, found: Counter, least: int = LEAST_LENGTH) -> Iterator[tuple[bytes, int]]:
    """(word, times) of one document's runs."""
    start = crc32(f"{key}:".encode())
    for run, times in found.items():
        if len(run) < least:
            continue
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, times


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all documents."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for own, words in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    for word, times in spelled(own, Counter(runs(words)), least):
                        counts[word] += times
                if len(counts) > HELD:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pieces(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Ranges of the prefix length, 0 to length - 1, as (from, code points kept at the end)."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return [(low, length - high) for low, high in zip(cuts, cuts[1:]) if low < high]


def dealt(words: DataFrame, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """(group, left and right block, side, word, n): every word in the tiles that it takes part in."""
    size = F.char_length("word")

    def postings(length: Column, longer: bool) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(
            length.alias("length"), i.alias("piece"), F.lit(longer).alias("longer"),
            F.floor(length * i / parts).cast("int").alias("head"), (length - F.floor(length * (i + 1) / parts)).cast("int").alias("tail")))

    posted = words.select("word", "n", F.explode(F.concat(postings(size, True), postings(size + 1, False))).alias("p"))
    group = F.struct(F.col("p.length").alias("length"), F.col("p.piece").alias("piece"),
                     F.substring("word", F.lit(1), F.col("p.head")).alias("head"),
                     F.when(F.col("p.tail") > 0, F.substring("word", -F.col("p.tail"), F.col("p.tail"))).otherwise("").alias("tail"))
    posted = posted.select("word", "n", group.alias("group"), F.col("p.longer").alias("longer"))
    sizes = posted.groupBy("group").agg(F.count("*").alias("all"), F.count_if("longer").alias("longer_ones")).filter("longer_ones > 0 AND `all` > 1")
    sizes = sizes.select("group", F.ceil(F.col("longer_ones") / block).cast("int").alias("left_blocks"), F.ceil(F.col("all") / block).cast("int").alias("right_blocks"))
    both = posted.join(sizes, "group")
    hashed = F.xxhash64("word")
    left = both.filter("longer").select("group", F.pmod(hashed, F.col("left_blocks")).cast("int").alias("l"),
                                        F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("r"), F.lit(0).alias("side"), "word", "n")
    right = both.select("group", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("l"),
                        F.pmod(hashed, F.col("right_blocks")).cast("int").alias("r"), F.lit(1).alias("side"), "word", "n")
    return left.unionByName(right)


def padded(words: list[str], width: int, at_end: bool) -> np.ndarray:
    """Code points of the words as rows, the shorter ones padded with zero behind or, with ``at_end``, before."""
    texts = [w.rjust(width, "\0") if at_end else w.ljust(width, "\0") for w in words]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, how many leading columns agree."""
    total = np.zeros((len(left), len(right)), np.int16)
    alive = np.ones(total.shape, bool)
    for k in range(left.shape[1]):
        alive &= left[:, k, None] == right[None, :, k]
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(left: list[str], right: list[str], length: int, piece: int, parts: int = PARTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``left``, in ``right``) of the near pairs of a tile that ``piece`` is the first to hold.

    Words of ``left`` have ``length`` code points, words of ``right`` as many or one less.
    """
    ranges = pieces(length, parts)
    low, tail = ranges[piece]
    a, b = padded(left, length, False), padded(right, length, False)
    x, y = padded(left, length, True)[:, ::-1], padded(right, length, True)[:, ::-1]
    sizes = np.array([len(w) for w in right], np.int16)
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        # All words of a group agree in their first and last code points already.
        prefix = low + agreeing(a[at : at + step, low:], b[:, low:])
        suffix = tail + agreeing(x[at : at + step, tail:], y[:, tail:])
        prefix, suffix = np.minimum(prefix, sizes), np.minimum(suffix, sizes)
        near = (prefix + suffix >= length - 1) & ((prefix < length) | (sizes < length))
        for head, end in ranges[:piece]:
            near &= ~((prefix >= head) & (suffix >= end))
        i, j = np.nonzero(near)
        yield i + at, j


def tile_rows(batches: Iterator[pa.RecordBatch], parts: int = PARTS) -> Iterator[pa.RecordBatch]:
    """One row (word, near words, best near word and its count) for each word with near words in one of its tiles.

    The rows arrive sorted by tile and side; a tile is gone through as soon as its last row is there.
    """
    names = ["word", "found", "best_n", "best"]

    def table(counts: dict[str, list]) -> pa.RecordBatch:
        found = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([f[0] for f in found], pa.int64()),
                                           pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], names)

    def add(counts: dict[str, list], word: str, other: str, n: int) -> None:
        now = counts.setdefault(word, [0, -1, ""])
        now[0] += 1
        if n > now[1] or n == now[1] and other < now[2]:
            now[1:] = n, other

    def compare(tile: tuple, sides: tuple[list, list], counts: dict[str, list]) -> None:
        (length, piece), (left, right) = tile[:2], sides
        if not left or not right:
            return
        for i, j in near_pairs([w for w, _ in left], [w for w, _ in right], length, piece, parts):
            for p, q in zip(i.tolist(), j.tolist()):
                (one, n), (other, m) = left[p], right[q]
                add(counts, one, other, m)
                if len(other) < length:  # words of equal length meet from both sides
                    add(counts, other, one, n)

    now, sides, counts = None, ([], []), {}
    for batch in batches:
        group = batch.column("group").flatten()
        tiles = zip(*(c.to_pylist() for c in (*group, batch.column("l"), batch.column("r"))))
        for tile, side, word, n in zip(tiles, *(batch.column(c).to_pylist() for c in ("side", "word", "n"))):
            if tile != now:
                if now is not None:
                    compare(now, sides, counts)
                now, sides = tile, ([], [])
                if len(counts) > HELD:
                    yield table(counts)
                    counts = {}
            sides[side].append((word, n))
    if now is not None:
        compare(now, sides, counts)
    yield table(counts)


def near_words(words: DataFrame, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n) that have near words."""
    tiles = dealt(words, block, parts).repartition("group", "l", "r").sortWithinPartitions("group", "l", "r", "side")
    found = tiles.mapInArrow(lambda batches: tile_rows(batches, parts), "word string, found long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) by following forms (word, form). Counts grow by ``ratio`` with each step, which bounds their number;
    each round doubles the steps already followed."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(max(2.0, log(max(2, largest), ratio) + 1)))):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = freeze(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, ratio: int = RATIO, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least ``least_length`` code points and ``least_count`` occurrences.

    ``form`` is the near word of largest count if that is at least ``ratio`` times the word's own.
    """
    words = freeze(word_counts(docs, text, key, least_length).filter(F.col("n") >= least_count), "words")
    near = near_words(words, block, parts)
    takes = F.col("best_n") >= ratio * F.col("n")
    known = freeze(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "near_words")
    largest = known.agg(F.max("n")).first()[0] or 0
    followed = roots(known.filter("form IS NOT NULL"), largest, ratio)
    return known.join(followed, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
