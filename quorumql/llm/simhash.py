"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has 64 bits, eight bytes by position. Two fingerprints that differ in at most ``bits`` (2) bits share
their bytes at 8 - bits positions at least: that is the guaranteed minimum of matches. Lists of single positional bytes
would hold 1/256 of all fingerprints each, and tallying their pairs grows with the square of the corpus. The index
therefore posts each fingerprint under every choice of that many positions with the bytes there (28 choices of 6), so
that a list holds only fingerprints whose tally reaches the minimum, and no pair is ever counted that fails it. A list
fixes 48 of 64 bits, so it has 65,536 different fingerprints at most, whatever the corpus. Inside a list the pairs'
bytes are tallied and their bits compared; a list is reduced to links from each fingerprint to the smallest one it is
connected with there, so large groups of near copies make no more links than they have members and lose no connection.

Equal fingerprints are one node. Components of the links give the groups. A null or empty text has fingerprint zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.llm.common import add_columns, keep_rows, map_texts, tagged
from quorumql.llm.graph import components
from quorumql.session import freeze

WORDS, SEED, BITS, BYTES = 3, 42, 2, 8
#: Lists of up to this many fingerprints are compared in one table of pairs; larger ones by looking up neighbours.
TABLE = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included, as an unsigned number."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) > words else [b" ".join(found)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 8192):
        ones += np.unpackbits(hashed[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, row: str | None = None) -> DataFrame:
    """Row number, key and fingerprint (as a signed long) of each row of a stored table, written once.

    ``row`` names a column of numbers written before; without it rows are numbered here.
    """
    docs, row = (docs, row) if row else tagged(docs)
    numbered = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(row).alias("row"))

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([fingerprint(t, words) for t in rows.column("text").to_pylist()], dtype=np.uint64)
        return add_columns(rows.select(["key", "row"]), {"fp": pa.array(own.view(np.int64))})

    schema = T.StructType([numbered.schema["key"], T.StructField("row", T.LongType()), T.StructField("fp", T.LongType())])
    return freeze(map_texts(numbered, "text", step, schema), "fingerprints")


def postings(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(choice of positions, the bytes there, fingerprint) for each choice of the guaranteed number of positions."""
    lists = []
    for n, positions in enumerate(combinations(range(BYTES), BYTES - bits)):
        mask = sum(0xFF << (8 * p) for p in positions)
        signed = mask - (1 << 64) if mask >> 63 else mask
        lists.append(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("kept")))
    return prints.select("fp", F.explode(F.array(*lists)).alias("list")).select("list.choice", "list.kept", "fp")


def list_links(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For the different fingerprints of one list, the place of the smallest one each is connected with there."""
    n = len(values)
    label = np.arange(n)
    if n <= TABLE:
        apart = values[:, None] ^ values[None, :]
        tally = (apart[:, :, None].view(np.uint8).reshape(n, n, BYTES) == 0).sum(axis=2)
        near = (tally >= BYTES - bits) & (np.bitwise_count(apart) <= bits)
        while True:
            least = np.where(near, label[None, :], n).min(axis=1)
            least = np.minimum(least, least[least])
            if (least == label).all():
                return label
            label = least
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    places = [1 << k for k in range(64) if free >> k & 1]
    flips = [np.uint64(sum(c)) for size in range(1, bits + 1) for c in combinations(places, size)]
    order = np.argsort(values)
    ranked = values[order]
    while True:
        least = label.copy()
        for flip in flips:
            other = ranked ^ flip
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = ranked[at] == other
            least[hit] = np.minimum(least[hit], label[at[hit]])
        least = np.minimum(least, least[least])
        if (least == label).all():
            back = np.empty(n, np.int64)
            back[order] = order[label]
            return back
        label = least


def links(lists: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between fingerprints, from the posting lists; each partition holds whole lists in order."""

    def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rest = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            now = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            yield tuple(x[~same] for x in now)
            rest = [x[same] for x in now]
        yield tuple(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, kept, fp in whole_lists(batches):
            if not len(fp):
                continue
            starts = np.flatnonzero(np.append(True, (np.diff(choice) != 0) | (np.diff(kept) != 0)))
            size = np.diff(np.append(starts, len(fp)))
            two = starts[size == 2]
            near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= bits
            a, b = [fp[two][near]], [fp[two + 1][near]]
            for start, n in zip(starts[size > 2], size[size > 2]):
                own = fp[start : start + n]
                label = list_links(own.view(np.uint64), bits)
                linked = label != np.arange(n)
                a.append(own[linked])
                b.append(own[label[linked]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    together = lists.repartition("choice", "kept").sortWithinPartitions("choice", "kept", "fp")
    return together.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, bits: int = BITS, row: str | None = None) -> DataFrame:
    """Row number, key, fingerprint, and the component's smallest (key, row) of each row of a stored table."""
    found = fingerprints(docs, text, key, words, row)
    nodes = found.groupBy("fp").agg(F.min(F.struct("key", "row")).alias("first"), F.min("key").alias("least"))
    roots = components(links(postings(nodes.select("fp"), bits), bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.min("least").alias("component"))
    by_print = rooted.select("fp", "root").join(groups, "root").select("fp", "stays", "component")
    return found.join(by_print, "fp").select("row", "key", "fp", "component", (F.col("row") == F.col("stays.row")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of ``docs`` (that with the smallest key), with its own columns."""
    return keep_rows(docs, lambda own, row: near_groups(own, row=row).filter("kept").select("row"))
