"""Packing without crossing documents: each document is cut into pieces whose lengths are powers of two.

A document of n tokens becomes n // limit pieces of the full length and one piece for every binary digit of the rest,
longest first, so the pieces lie one behind the other and every token is in one of them. Pieces of equal length form a
bucket, and each piece is a sequence of its own: no sequence holds tokens of two documents and none needs padding,
since all lengths are powers of two. Sequences of one bucket have adjacent numbers, so a batch is a range of numbers.

Numbers are given without a sort of all pieces: pieces are written once to the shared folder with their task and place,
the counts by bucket and task are summed up, and each piece adds its place to its task's first number.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumql.llm.common import slices
from quorumql.llm.tokens import encoder
from quorumql.session import freeze

LIMIT, END = 4096, 2
#: Parts whose ids a process holds.
MOST_PARTS = 600_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; ``limit`` is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 2, -1, -1) if rest >> k & 1]


class PartIds(dict):
    """Little-endian ids by part of a text, worked out once."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.encoder = encoder(path)

    def __missing__(self, part: str) -> bytes:
        found = self[part] = self.encoder.packed(part)
        return found


@cache
def part_ids(path: str) -> PartIds:
    """One table for each process, so that it serves all tasks there."""
    return PartIds(path)


def cut_documents(docs: DataFrame, path: str, end: int = END, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece, with its task and its place among that task's pieces of the same length."""
    if limit & (limit - 1) or limit < 1:
        raise ValueError(f"the limit must be a power of two, not {limit}")
    closing = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        ids, parts = part_ids(path), encoder(path).parts
        task, places = TaskContext.get().partitionId(), {}
        for batch in batches:
            for rows in slices(batch, "text"):
                if len(ids) > MOST_PARTS:
                    ids.clear()
                out: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist()):
                    own = b"".join(map(ids.__getitem__, parts(text))) + closing if text else closing
                    tokens, start = len(own) // 4, 0
                    for length in binary_lengths(tokens, limit):
                        places[length] = place = places.get(length, -1) + 1
                        for values, value in zip(out, (doc, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), tokens, place)):
                            values.append(value)
                        start += length
                *head, place = (pa.array(x, pa.int64()) for x in out)
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.full(len(place), task, np.int32)), place],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, end: int = END, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of ``docs`` with their sequence (number, offset in it, and its length without padding)."""
    pieces = freeze(cut_documents(docs, path, end, limit, text, key), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # One row for each bucket and task, so the running sum is over a small table.
    order = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    return pieces.join(first, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_length"))
