"""Join of near-equal word n-gram sets by a count-vector R-tree.

A document's set holds its distinct word shingles, as 64-bit hashes. Sets link if their Jaccard similarity is at least
NUM/DEN. Hashing the shingles into ``GROUPS`` groups and counting each group gives a point; two sets share at most the sum
over groups of the smaller count. An R-tree over points keeps for each box the largest count of every group and the range
of set sizes, so the same sum bounds all sets of a box from above: a box whose bound lies below the least overlap that a
link needs is left out whole. Pairs that survive down to the points must pass a second bound, by sketches of parities,
which says in how many shingles two sets differ at least; what is left is verified on the sets themselves. Without it a
large group of texts that nearly link (similar at 0.8 to 0.9) gives pairs with the square of its size.

One tree over the whole table would prune little above its leaves: independent texts of like length differ by a few
counts in each group, less than the difference that a link allows. The upper levels are therefore dealt by equality
instead of boxes. For a smaller set of size n a link allows at most d = n * (DEN - NUM) / NUM differing shingles; with the
shingles hashed into d + 1 bands, linked sets agree in one whole band at least. Sets are posted by (size class, band, content of
the band), in their own size class and as guests in the class below, which a smaller partner may lie in. Guests of a list
meet in their own class, so they are compared with its owners alone. Lists of one set or of guests alone are dropped;
inside a list the tree does the search. No link is lost, whatever the table.

Equal sets are one node. Rounds work through the lists in windows of places (0; 1-15; 16-255; ...): everybody is compared
with the window's members unless both already belong to one component, so a large group of near copies is mostly joined
by its first members and costs a number of verifications in proportion to its size. A round's links join the components
of the rounds before. Beyond the last window a list is dealt into blocks, and only members outside its most frequent
component are compared with all of them.

Defined results: a null text, an empty one and one without words have an empty set and link with nothing, so each is its
own component; fewer words than a shingle make one shingle of all words. Null keys are ignored when the smallest key of a
component is chosen (null if it has no other). Repeated rows stay rows of their own. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.llm.common import map_texts
from quorumql.llm.graph import components
from quorumql.session import freeze

WORDS, NUM, DEN, SEED = 3, 90, 100, 42
GROUPS, LEAF = 64, 16
#: Groups of a parity sketch (2 to this power), and bits kept of each.
SKETCH_POWER, PLANES = 9, 4
#: Ends of the windows of places in a list, the last also the size of the blocks beyond; pairs that one step of the tree bounds.
WINDOWS, PAIRS = (1, 16, 256, 4096), 1 << 15
#: A candidate pair and the components that its nodes are in so far.
PAIR = ["a", "b", "from_a", "from_b"]
#: What a list's members are compared by; a window may carry a tree over them as well, which goes when members join it.
MEMBER = ("id", "n", "label", "point", "sketch")
#: Bits of the filter that says which sets are needed again: 4 MB, whatever the table.
FILTER_BITS = 1 << 25
#: Hashes of texts that a task keeps to return a set that repeats only once.
SEEN = 200_000


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the lower-cased (A-Z) text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    shingles = set(map(b" ".join, zip(*(found[i:] for i in range(words))))) if len(found) > words else {b" ".join(found)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    high, low = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), ">i8").tolist()
    return high, low


@lru_cache(maxsize=None)
def size_classes(num: int, den: int, most: int) -> tuple[int, ...]:
    """First sizes of the classes up to ``most``: a set and a larger partner lie in one class or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * den // num + 1)
    return tuple(starts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def band_count(largest: int, num: int = NUM, den: int = DEN) -> int:
    """Bands of the size class that ends at ``largest``; with fewer than two only equal sets link, and they are one node."""
    return largest * (den - num) // num + 1


def own_bands(n: int, num: int = NUM, den: int = DEN) -> int:
    """How many of a set's band keys are of its own size class; they come first."""
    if not n:
        return 0
    starts = size_classes(num, den, 1 << max(16, n.bit_length()))
    bands = band_count(starts[int(np.searchsorted(starts, n, side="right"))] - 1, num, den)
    return bands if bands > 1 else 0


def band_keys(own: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of the set's bands in its own size class and, where a smaller partner may lie there, in the one below."""
    n = len(own)
    if not n:
        return np.zeros(0, np.int64)
    starts = size_classes(num, den, 1 << max(16, n.bit_length()))
    at = int(np.searchsorted(starts, n, side="right")) - 1
    blurred, keys = mixed(own), []
    for c in (at, at - 1):
        if c < 0:
            continue
        largest = starts[c + 1] - 1
        bands = band_count(largest, num, den)
        if bands < 2 or (c < at and n * num > largest * den):
            continue
        sums = np.zeros(bands, np.uint64)
        np.add.at(sums, (own % np.uint64(bands)).astype(np.int64), blurred)
        keys.append(mixed(sums + mixed(np.arange(bands, dtype=np.uint64) + np.uint64((c + 1) << 32))))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def group_counts(own: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The set's point: how many of its shingles hash into each group."""
    return np.bincount((own >> np.uint64(40)).astype(np.int64) % groups, minlength=groups).astype(np.uint32)


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """Parities by group of the set's shingles: of their number, and of one bit of their hashes in each further plane."""
    blurred = mixed(own)
    group = (blurred >> np.uint64(64 - SKETCH_POWER)).astype(np.int64)
    planes = [np.bincount(group, minlength=1 << SKETCH_POWER)]
    planes += [np.bincount(group[(blurred >> np.uint64(k)) & np.uint64(1) == 1], minlength=1 << SKETCH_POWER) for k in range(PLANES - 1)]
    return np.packbits((np.stack(planes) & 1).astype(np.uint8))


def least_apart(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many shingles the sets of the pairs (left[i], right[j]) of sketches differ at least.

    Shared shingles leave the parities alike. A group whose numbers differ in parity holds one differing shingle at least,
    a group that differs in another plane only holds two.
    """
    out, width = np.empty(len(i), np.int64), (1 << SKETCH_POWER) // 64
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        apart = (left[i[part]] ^ right[j[part]]).reshape(-1, PLANES, width)
        odd = apart[:, 0]
        even = np.bitwise_or.reduce(apart[:, 1:], axis=1) & ~odd
        out[part] = np.bitwise_count(odd).sum(axis=1, dtype=np.int64) + 2 * np.bitwise_count(even).sum(axis=1, dtype=np.int64)
    return out


def needed(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Least overlap with which sets of the sizes ``a`` and ``b`` link."""
    return -(-num * (a + b) // (num + den))


class CountTree:
    """R-tree over count vectors, bulk-loaded by halving at the median of the count that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> None:
        order, ranges, self.levels = np.arange(len(points)), [(0, len(points))], []
        while True:
            starts = np.array([a for a, _ in ranges])
            held = points[order]
            self.levels.append((starts, np.array([b for _, b in ranges]), np.maximum.reduceat(held, starts),
                                np.minimum.reduceat(sizes[order], starts), np.maximum.reduceat(sizes[order], starts)))
            if max(b - a for a, b in ranges) <= leaf:
                break
            halves = []
            for a, b in ranges:
                own = order[a:b]
                values = np.column_stack([points[own], sizes[own]])
                axis = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
                middle = (b - a) // 2
                order[a:b] = own[np.argsort(values[:, axis], kind="stable")]
                halves += [(a, a + middle), (a + middle, b)]
            ranges = halves
        self.order, self.points, self.sizes = order, points, sizes

    def search(self, queries: np.ndarray, sizes: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) places whose summed coordinate minima reach the overlap that a link needs."""
        asked, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        for depth, (starts, ends, high, least, most) in enumerate(self.levels):
            if depth:
                asked, node = np.repeat(asked, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            own = sizes[asked]
            fits = (least[node] * num <= own * den) & (own * num <= most[node] * den)
            asked, node = asked[fits], node[fits]
            smallest = np.maximum(least[node], -(-sizes[asked] * num // den))
            kept = overlap_bound(queries, high, asked, node) >= needed(sizes[asked], smallest, num, den)
            asked, node = asked[kept], node[kept]
        starts, ends = self.levels[-1][:2]
        length = ends[node] - starts[node]
        asked = np.repeat(asked, length)
        at = np.repeat(starts[node] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        found = self.order[at]
        kept = close_enough(queries, sizes, self.points, self.sizes, asked, found, num, den)
        return asked[kept], found[kept]


def overlap_bound(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of the pairs (left[i], right[j])."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.minimum(left[i[part]], right[j[part]]).sum(axis=1, dtype=np.int64)
    return out


def close_enough(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray, i: np.ndarray, j: np.ndarray,
                 num: int = NUM, den: int = DEN) -> np.ndarray:
    a, b = left_sizes[i], right_sizes[j]
    kept = np.minimum(a, b) * den >= np.maximum(a, b) * num
    kept[kept] = overlap_bound(left, right, i[kept], j[kept]) >= needed(a[kept], b[kept], num, den)
    return kept


def near_enough(one: dict, two: dict, i: np.ndarray, j: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Whether the pairs of members (one[i], two[j]) can differ in as few shingles as a link allows."""
    a, b = one["n"][i], two["n"][j]
    return least_apart(one["sketch"], two["sketch"], i, j) <= a + b - 2 * needed(a, b, num, den)


def vectors_of(held: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1)


def text_mark(text: str | None) -> int:
    """A signed hash of the text as it stands, quick to work out."""
    return int(np.uint64(xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))).view(np.int64))


def described(docs: DataFrame, text: str, key: str, words: int, num: int, den: int) -> DataFrame:
    """Key, set size, digest, hash of the text, band keys and number of those of the own class of each row, written once."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        sets = [shingle_set(t, words) for t in texts]
        marks = [digest(s) for s in sets]
        bands = [band_keys(s, num, den) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([
            part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
            pa.array([text_mark(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())),
            pa.array([own_bands(len(s), num, den) for s in sets], pa.int64())], ["key", "n", "d1", "d2", "mark", "bands", "own"])

    schema = T.StructType([rows.schema["key"], *T._parse_datatype_string("n long, d1 long, d2 long, mark long, bands array<long>, own long").fields])
    return freeze(map_texts(rows, "text", step, schema), "described")


def posting_lists(nodes: DataFrame) -> DataFrame:
    """(band, id, place, guest) of the lists with two nodes or more, one of them an owner.

    Owners come before guests; apart from that, places follow one order of nodes that is the same in all lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row so far, not yet handed on, and whether its list has an owner.
        band, ids, place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        guest, owned = np.zeros(0, bool), np.zeros(0, bool)

        def made(kept: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (band, ids, place, guest)], ["band", "id", "place", "guest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            band = np.concatenate([band, batch.column("band").to_numpy()])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            guest = np.concatenate([guest, batch.column("guest").to_numpy(zero_copy_only=False)])
            new = np.append(True, np.diff(band) != 0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))
            inside, held = np.arange(len(band)) - start, ~guest[start]
            if len(place):
                inside[start == 0] += place[0]
                held[start == 0] = owned[0]
            place, owned = inside, held
            beside = (place > 0) | np.append(np.diff(band) == 0, False)
            beside[-1] = False
            yield made(beside & owned)
            band, ids, place, guest, owned = band[-1:], ids[-1:], place[-1:], guest[-1:], owned[-1:]
        yield made((place > 0) & owned)

    posted = nodes.select("id", "own", F.posexplode("bands").alias("at", "band")).select("id", "band", (F.col("at") >= F.col("own")).alias("guest"))
    together = posted.repartition("band").sortWithinPartitions("band", "guest", F.xxhash64("id"), "id").select("band", "id", "guest")
    return freeze(together.mapInArrow(run, "band long, id long, place long, guest boolean"), "lists")


def member_sets(docs: DataFrame, text: str, members: DataFrame, words: int) -> DataFrame:
    """(id, n, shingles, point, sketch) of the nodes ``members`` (id, n, d1, d2, mark), worked out anew from the texts.

    ``mark`` is the hash of one of the texts that have the set. A filter of a fixed number of bits over the marks lets
    most other documents go inside their tasks before their shingles are made; what passes wrongly goes in the join.
    """
    at = F.col("mark").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = members.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bit"))
    words_set = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[words_set["word"].to_numpy(np.int64)] = words_set["bits"].to_numpy(np.int64)
    table = table.view(np.uint64)
    seen: set[int] = set()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for t in part.column("text").to_pylist():
            mark = text_mark(t)
            place = mark & (FILTER_BITS - 1)
            if int(table[place >> 6]) >> (place & 63) & 1 and mark not in seen:
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(mark)
                own = shingle_set(t, words)
                out.append((len(own), *digest(own), own.tobytes(), group_counts(own).tobytes(), parity_sketch(own).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["n", "d1", "d2", "shingles", "point", "sketch"])

    found = map_texts(docs.select(F.col(text).alias("text")), "text", step, "n long, d1 long, d2 long, shingles binary, point binary, sketch binary")
    joined = found.join(members.drop("mark"), ["n", "d1", "d2"]).select("id", "n", "shingles", "point", "sketch").dropDuplicates(["id"])
    return freeze(joined, "sets")


def window_pairs(rows: DataFrame, high: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components, one of them an owner at a place below ``high``, that tree and sketches leave over.

    ``rows`` (band, place, guest, id, n, label, point, sketch) hold whole lists from the window's first place on. A list's
    owners in the window are held, the others pass by.
    """

    def pairs(window: dict, more: dict, within: bool) -> np.ndarray:
        w, m = len(window["id"]), len(more["id"])
        if w * m <= 4096:
            i, j = np.divmod(np.arange(w * m), m) if m else (np.zeros(0, np.int64),) * 2
            kept = (j > i) if within else np.ones(len(i), bool)
            kept &= window["label"][i] != more["label"][j]
            i, j = i[kept], j[kept]
            kept = close_enough(window["point"], window["n"], more["point"], more["n"], i, j, num, den)
            return made(window, more, i[kept], j[kept])
        if (window["label"] == window["label"][0]).all():
            away = np.flatnonzero(more["label"] != window["label"][0])
            more = {k: more[k][away] for k in MEMBER}
        if "tree" not in window:
            window["tree"] = CountTree(window["point"], window["n"])
        asked, found = window["tree"].search(more["point"], more["n"], num, den)
        kept = window["label"][found] != more["label"][asked]
        return made(window, more, found[kept], asked[kept])

    def made(one: dict, two: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        kept = near_enough(one, two, i, j, num, den)
        i, j = i[kept], j[kept]
        return np.stack([one["id"][i], two["id"][j], one["label"][i], two["label"][j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, band = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy() for c in ("band", "place", "id", "n", "label")} | {"guest": batch.column("guest").to_numpy(zero_copy_only=False)}
            cols |= {c: vectors_of(batch.column(c).to_pylist(), kind) for c, kind in (("point", np.uint32), ("sketch", np.uint64))}
            starts = np.flatnonzero(np.append(True, np.diff(cols["band"]) != 0))
            out = [np.zeros((4, 0), np.int64)]
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                own = {k: v[a:b] for k, v in cols.items()}
                if own["band"][0] != band:
                    window, band = None, own["band"][0]
                inside = (own["place"] < high) & ~own["guest"]
                now = {k: own[k][inside] for k in MEMBER}
                rest = {k: own[k][~inside] for k in MEMBER}
                if len(now["id"]):
                    out.append(pairs(now, now, True))
                    if window is not None:  # the window's members came in several batches
                        out.append(pairs(window, now, False))
                        now = {k: np.concatenate([window[k], now[k]]) for k in MEMBER}
                    window = now
                if len(rest["id"]) and window is not None:
                    out.append(pairs(window, rest, False))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], PAIR)

    together = rows.select("band", "place", "guest", "id", "n", "label", "point", "sketch").repartition("band").sortWithinPartitions("band", "place")
    return together.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def block_pairs(rows: DataFrame, window: int, num: int, den: int) -> DataFrame:
    """Pairs of different components among the members of long lists beyond their window, block by block."""
    common = rows.groupBy("band", "label").count().groupBy("band").agg(F.max(F.struct("count", "label")).alias("m"))
    common = common.select("band", F.col("m.label").alias("common"))
    ends = rows.groupBy("band").agg(F.ceil((F.max("place") + 1) / window).cast("int").alias("blocks"))
    held = rows.withColumn("l", F.floor(F.col("place") / window).cast("int"))
    apart = held.join(common, "band").filter("label != common").drop("common")
    left = held.join(apart.select("band", F.col("l").alias("r")).distinct(), "band")
    right = apart.withColumnRenamed("l", "r").join(ends, "band").withColumn("l", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).drop("blocks")

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in PAIR})
        left, right = ({"n": x["n"].to_numpy(), "point": vectors_of(list(x["point"]), np.uint32), "sketch": vectors_of(list(x["sketch"]), np.uint64)} for x in (one, two))
        asked, found = CountTree(left["point"], left["n"]).search(right["point"], right["n"], num, den)
        kept = near_enough(left, right, found, asked, num, den) & ~(one["guest"].to_numpy()[found] & two["guest"].to_numpy()[asked])
        found, asked = one.iloc[found[kept]], two.iloc[asked[kept]]
        made = pd.DataFrame(dict(zip(PAIR, (x[c].to_numpy() for c in ("id", "label") for x in (found, asked)))))
        return made[made["from_a"] != made["from_b"]]

    keys = ["band", "l", "r"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from the same rows
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, ", ".join(f"{c} long" for c in PAIR))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets link, each once."""
    ordered = pairs.select(*(F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(PAIR, ("b", "a", "from_b", "from_a"))))
    one, two = (sets.select(F.col("id").alias(name), F.col("shingles").alias(f"set_{name}")) for name in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                kept.append(shared * den >= num * (len(p) + len(q) - shared))
            yield batch.select(PAIR).filter(pa.array(kept, pa.bool_()))

    joined = ordered.distinct().join(one, "a").join(two, "b").select(*PAIR, "set_a", "set_b")
    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def linked_nodes(docs: DataFrame, text: str, nodes: DataFrame, words: int, num: int, den: int, windows: tuple[int, ...]) -> DataFrame | None:
    """(node, root) of the nodes that link with others and are not the smallest of their component; None without links."""
    lists = posting_lists(nodes)
    sizes = lists.agg(F.max("place")).first()[0]
    if sizes is None:
        return None
    members = lists.select("id").distinct().join(nodes.select("id", "n", "d1", "d2", "mark"), "id")
    sets = member_sets(docs, text, members, words)
    lists = freeze(lists.join(sets.select("id", "n", "point", "sketch"), "id").select("band", "place", "guest", "id", "n", "point", "sketch"), "points")
    labels, low = None, 0
    for high in (*windows, None):
        if low > sizes:
            break
        rows = lists.filter(F.col("place") >= low)
        if labels is None:
            rows = rows.withColumn("label", F.col("id"))
        else:
            rows = rows.join(labels, rows.id == labels.node, "left").withColumn("label", F.coalesce("root", "id")).drop("node", "root")
        pairs = window_pairs(rows, high, num, den) if high else block_pairs(rows, low, num, den)
        found = freeze(verified(pairs, sets, num, den), "near")
        joined = components(found.select(F.col("from_a").alias("a"), F.col("from_b").alias("b")))
        if labels is None:
            labels = joined
        else:
            further = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = freeze(labels.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(joined), "labels")
        low = high
    return labels


def near_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, num: int = NUM, den: int = DEN,
              windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(key, n_shingles, component) of each row of ``docs``; the component is named by its smallest key."""
    rows = described(docs, text, key, words, num, den)
    known = rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("key").alias("least"), F.min("mark").alias("mark"), F.first("bands").alias("bands"), F.first("own").alias("own"))
    nodes = freeze(known.select(F.monotonically_increasing_id().alias("id"), "*"), "nodes")
    roots = linked_nodes(docs, text, nodes, words, num, den, windows)
    marked = nodes.select("id", "n", "d1", "d2", "least")
    if roots is None:
        rooted = marked.withColumn("root", F.col("id"))
    else:
        rooted = marked.join(roots, marked.id == roots.node, "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("n", "d1", "d2", "component")
    found = rows.select("key", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return found.select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
