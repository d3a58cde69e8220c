"""Sentence-piece encoding and decoding by suffix-array matching, without the library's encoder.

The distinct parts of a batch of texts (see ``tokens.piece_parts``) are put one behind the other, and their suffixes are
sorted by as many characters as the longest piece has. Every piece of the vocabulary is looked up by binary search; its
range in the suffix array is the list of its occurrences. Occurrences are edges from their first to their last
character, sorted by part and position.

The vocabulary is of the merging kind: not the path with the best sum of scores is asked for but the result of joining,
again and again, the two neighbouring symbols whose piece has the best score, the leftmost of equals. The edges are
therefore relaxed in rounds: an edge is open while exactly two symbols lie under it; in each round every part takes its
best open edge, until none is open. (A best path over the same edges gives other ids than the library.) Characters that
are no piece become the pieces of their bytes.

Decoding writes pieces and bytes in order and drops the space that encoding puts first. Null and empty texts have no
ids; no ids give the empty text.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quorumql.llm.common import Lexicon, add_columns, free_name, map_texts
from quorumql.llm.tokens import by_bytes, piece_parts

SPACE = "▁"
#: Characters of distinct parts that one suffix array covers.
BATCH = 1 << 20
#: Characters whose edges are relaxed together.
STRETCH = 1 << 15
#: Open edges for each part, from which more than the best one are looked for in a round.
MANY = 24


class PieceTable:
    """Pieces of a model file that stand for text, by characters; pieces of bytes; and the bytes of every id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        apart = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.single = {model.id_to_piece(i): i for i in ids if i not in apart and len(model.id_to_piece(i)) == 1}
        longer = [i for i in ids if i not in apart and len(model.id_to_piece(i)) > 1]
        self.ids = np.array(longer, dtype=np.int64)
        self.pieces = [model.id_to_piece(i) for i in longer]
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.longest = int(self.lengths.max(initial=1))
        # The best score first; equal scores keep the order of ids.
        self.rank = np.empty(len(longer), dtype=np.int64)
        self.rank[np.argsort([-model.get_score(i) for i in longer], kind="stable")] = np.arange(len(longer))
        self.bytes = [b"" if i in apart else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes((b,))

    def occurrences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of piece) of every occurrence of a longer piece in ``text``."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        alphabet, dense = np.unique(codes, return_inverse=True)
        # Two bytes for each character, neither of them zero, so that they compare like the characters and end like them.
        marks = np.stack([dense // 254 + 1, dense % 254 + 1], axis=1).astype(np.uint8)
        padded = np.concatenate([marks, np.zeros((self.longest, 2), np.uint8)]).reshape(-1)
        width = 2 * self.longest
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: 2 * len(codes) : 2]).view(f"S{width}").reshape(-1)
        order = np.argsort(suffixes)
        ranked = suffixes[order]
        place = {chr(c) if c < 0xD800 or c > 0xDFFF else "": bytes((i // 254 + 1, i % 254 + 1)) for i, c in enumerate(alphabet.tolist())}
        known = [i for i, piece in enumerate(self.pieces) if all(c in place for c in piece)]
        low = [b"".join(map(place.__getitem__, self.pieces[i])) for i in known]
        first = np.searchsorted(ranked, np.array(low, dtype=f"S{width}"), "left")
        last = np.searchsorted(ranked, np.array([x.ljust(width, b"\xff") for x in low], dtype=f"S{width}"), "right")
        count = last - first
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return order[at], np.repeat(np.array(known, dtype=np.int64), count)

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part, which a space precedes."""
        # Parts of like length lie together, so that the rounds over a stretch of them end together.
        by_length = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        marked = [SPACE + parts[i].replace(" ", SPACE) for i in by_length]
        text = "".join(marked)
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        owner = np.repeat(np.arange(len(marked)), lengths)
        start, piece = self.occurrences(text)
        end = start + self.lengths[piece]
        inside = owner[start] == owner[end - 1]
        start, end, piece = start[inside], end[inside], piece[inside]
        order = np.argsort(start, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        alphabet, dense = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
        symbol = np.array([self.single.get(chr(c), -1) for c in alphabet.tolist()], dtype=np.int64)[dense]
        begins = np.ones(len(text) + 1, np.int64)  # whether a symbol begins at a character
        first = np.cumsum(lengths) - lengths
        stretch = first[np.unique(np.searchsorted(first, np.arange(0, len(text), STRETCH), "right") - 1)].tolist() + [len(text)]
        for low, high in zip(stretch, stretch[1:]):
            a, b = np.searchsorted(start, (low, high))
            self.relax(owner[low:high], begins[low : high + 1], symbol[low:high], start[a:b] - low, end[a:b] - low, piece[a:b])
        at = np.flatnonzero(begins[:-1])
        found, count = symbol[at], np.bincount(owner[at], minlength=len(marked))
        cuts = np.cumsum(count) - count
        values, spelled = found.tolist(), np.add.reduceat(found < 0, cuts) > 0
        out: list[list[int]] = [[]] * len(parts)
        for k, (place, low, n) in enumerate(zip(by_length, cuts.tolist(), count.tolist())):
            own = values[low : low + n]
            if spelled[k]:
                own = [i for value, c in zip(own, at[low : low + n]) for i in ([value] if value >= 0 else self.byte_ids[list(text[c].encode("utf-8", "replace"))].tolist())]
            out[place] = own
        return out

    def relax(self, owner: np.ndarray, begins: np.ndarray, symbol: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> None:
        """Joins symbols of a stretch of whole parts in place; edges are sorted by position.

        Edges join in order of rank, then position. An open edge may join at once, whatever is open elsewhere, if no edge
        that comes before it and may still open lies over its characters: nothing can take its symbols from it. So many
        join in a round, and the best of each part always does, which makes the rounds few even in long parts.
        """
        before = np.zeros(len(begins) + 1, np.int64)
        size, never = len(begins), np.iinfo(np.int64).max
        while len(start):
            np.cumsum(begins, out=before[1:])
            under = before[end] - before[start]
            # An edge whose ends lie inside symbols never opens again.
            alive = (begins[start] == 1) & (begins[end] == 1) & (under > 1)
            start, end, piece, under = start[alive], end[alive], piece[alive], under[alive]
            open_ = np.flatnonzero(under == 2)
            if not len(open_):
                return
            part = owner[start[open_]]
            new = np.flatnonzero(np.diff(part, prepend=-1))
            # The best rank in each part and, among equals, the first position.
            own = self.rank[piece[open_]] * len(open_) + np.arange(len(open_))
            joins = open_[np.minimum.reduceat(own, new) % len(open_)]
            if len(open_) > MANY * len(new):  # else rounds are few anyway
                key = self.rank[piece] * size + start
                # An edge can open only if one inside it is open.
                opened = np.zeros(int(before[-1]) + 1, np.int64)
                opened[before[start[open_]] + 1] = 1
                opened = np.cumsum(opened)
                may = opened[before[start] + under - 1] > opened[before[start]]
                length = end[may] - start[may]
                covered = np.repeat(start[may] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
                least = np.full(size + 1, never)
                np.minimum.at(least, covered, np.repeat(key[may], length))
                bounds = np.stack([start[open_], end[open_]], axis=1).reshape(-1)
                free = open_[np.minimum.reduceat(least, bounds)[::2] == key[open_]]
                joins = np.union1d(joins, free)
            begins[np.searchsorted(before, before[start[joins]] + 2, "left") - 1] = 0
            symbol[start[joins]] = self.ids[piece[joins]]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


@cache
def part_ids(path: str) -> tuple[Lexicon, list[bytes]]:
    """Little-endian ids by part, kept beside the part's number; one table for each process."""
    own, ids = piece_table(path), []

    def make(parts: list[str]) -> np.ndarray:
        for batch in by_bytes(parts, BATCH):
            ids.extend(struct.pack(f"<{len(x)}I", *x) for x in own.encode(batch))
        return np.zeros(len(parts), np.int8)

    return Lexicon(make, 300_000), ids


def encoded(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    lexicon, ids = part_ids(path)
    if lexicon.full:
        lexicon.trim()
        ids.clear()
    found = [list(map(lexicon.__getitem__, piece_parts(text))) if text else [] for text in texts]
    lexicon.rows()
    return [b"".join(map(ids.__getitem__, numbers)) for numbers in found]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the ids of each whole text, and the name that column got."""
    name = free_name(docs, "ids")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        packed = encoded(rows.column(text).to_pylist(), path)
        values = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
        ends = np.cumsum([0] + [len(x) // 4 for x in packed]).astype(np.int32)
        return add_columns(rows, {name: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))})

    return map_texts(docs, text, step, schema), name


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> tuple[DataFrame, str]:
    """``rows`` with the text of each list of ids (null: empty), and the name that column got."""
    name = free_name(rows, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        table = piece_table(path)
        for batch in batches:
            yield add_columns(batch, {name: pa.array([table.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())})

    return rows.mapInArrow(run, schema), name


def encoding_report(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, number of ids, their checksum, and whether decoding them gives the text again."""

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        table, texts = piece_table(path), rows.column(text).to_pylist()
        packed = encoded(texts, path)
        same = [table.decode(np.frombuffer(x, dtype="<u4").tolist()) == (t or "") for x, t in zip(packed, texts)]
        return pa.RecordBatch.from_arrays([rows.column(key), pa.array([len(x) // 4 for x in packed], pa.int64()),
                                           pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(same, pa.bool_())],
                                          [key, "n_tokens", "ids_crc32", "round_trip"])

    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return map_texts(docs.select(key, text), text, step, schema)
