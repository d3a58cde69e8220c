"""Token counts of whole texts by a public tokenizer.

Texts are encoded in Arrow functions that return lengths only. A text is split at safe boundaries, places that no piece
of the vocabulary crosses, so the counts of its parts add up to the count of the whole:

* sentence-piece models: before a run of spaces (every piece with spaces starts with them, and the encoder's own
  leading space stands for the first space of a part);
* tokenizer files that drop white space: at spaces and line ends.

Parts that repeat are encoded once per task; what is new in a slice of texts goes to the encoder in batches of about
equal bytes, whatever the lengths of the parts. A null text is empty; an empty text has 0 tokens.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.llm.common import Lexicon, add_columns, free_name, map_texts

BATCH_BYTES = 1 << 20
SPACED = re.compile(r" +[^ ]*")


def by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``most`` characters, one text at least."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def piece_parts(text: str) -> list[str]:
    """Parts of a text for a sentence-piece encoder that puts a space before each of them."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [part[1:] for part in SPACED.findall(" " + text)]


def line_parts(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class PieceEncoder:
    """Ids by a sentence-piece model, without begin and end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.parts = piece_parts

    def ids(self, texts: list[str]) -> list[list[int]]:
        # A part of no characters stands for one space of its own, which the encoder leaves out of an empty text.
        found = self.model.encode(texts, num_threads=1)
        blank = [self.model.piece_to_id("\u2581")]
        return [ids if text else blank for text, ids in zip(texts, found)]


def byte_letters() -> dict[int, str]:
    """Letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class FileEncoder:
    """Ids by a tokenizer file whose pre-tokenizer drops white space, without special tokens added.

    Most parts are letters of Latin-1 followed by marks. For these the file's normaliser and pre-tokenizer do no more
    than lower the case and split letters from marks, so its model is asked directly, once for each run of letters or
    marks. If the file answers otherwise for any of the probes, every part goes the whole way.
    """

    SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,;:!?*#$%&()+=/-]*)")
    PROBES = ("Probe", "\u00c9t\u00e9", "stra\u00dfe.", "a", "***", "End.%%%", "\u00ff\u00f1\u00d6(", "tokenization", "I", "X:", "")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.tokenize = self.model.model.tokenize
        self.parts, self.letters, self.runs = line_parts, byte_letters(), {}
        self.simple = all(self.quick(x) == self.whole(x) for x in self.PROBES)

    def run(self, text: str) -> bytes:
        found = self.runs.get(text)
        if found is None:
            if len(self.runs) > 400_000:
                self.runs.clear()
            marked = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            ids = [token.id for token in self.tokenize(marked)] if text else ()
            found = self.runs[text] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def quick(self, part: str) -> bytes | None:
        match = self.SIMPLE.fullmatch(part)
        if match is None:
            return None
        letters, marks = match.groups()
        return self.run(letters.lower()) + self.run(marks) if marks else self.run(letters.lower())

    def whole(self, part: str) -> bytes:
        ids = self.model.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, part: str) -> bytes:
        """Ids of a part as little-endian unsigned 32-bit numbers."""
        found = self.quick(part) if self.simple else None
        return self.whole(part) if found is None else found

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in map(self.packed, texts)]


@cache
def encoder(path: str) -> PieceEncoder | FileEncoder:
    """One for each process, so that what it has read and seen serves all tasks there."""
    return PieceEncoder(path) if path.endswith(".model") else FileEncoder(path)


@cache
def length_lexicon(path: str) -> Lexicon:
    """Token counts by part, one table for each process."""
    own = encoder(path)

    def make(parts: list[str]) -> np.ndarray:
        return np.array([len(ids) for batch in by_bytes(parts) for ids in own.ids(batch)], dtype=np.int64)

    return Lexicon(make, 300_000)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the number of tokens of each text, and the name that column got."""
    name = free_name(docs, "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, parts = length_lexicon(path), encoder(path).parts
        lexicon.trim()
        found = [lexicon.numbers(parts(t)) if t else None for t in rows.column(text).to_pylist()]
        lengths = lexicon.rows()
        counts = [0 if numbers is None else int(lengths[numbers].sum()) for numbers in found]
        return add_columns(rows, {name: pa.array(counts, pa.int64())})

    return map_texts(docs, text, step, schema), name


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
