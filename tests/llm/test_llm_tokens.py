"""Counting, packing, encoding and decoding against the tokenizers' own libraries."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quorumql.llm.packing import binary_lengths, pack
from quorumql.llm.pieces import decode_ids, encode_texts, encoding_report, piece_table
from quorumql.llm.tokens import count_tokens
from quorumql.session import freeze

PIECES, FILE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello world.", "  leading and trailing  ", "two  spaces   three", "line\nend\r\n\ttab", "Émile's naïve café, ß!",
    "日本語のテキスト です", "emoji 🎉🎉 🏽", "123 4567 8.9e10", "it's they'll I'D", "<|endoftext|> inside<|startoftext|>", "</s><s><unk> <0x0A>", "á ëx ́y",
    "İstanbul ΣΑΣ ẞ", "\u0000nul ﻿​", "x" * 5000, "word " * 9000, "***.%%% ### a***", "DŽ ǅ ﬁ Ａｂ", "tab\x0bvt\x1cfs\x85nel\xa0nbsp",
]
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other", None) for i, t in enumerate(TEXTS)]
    return freeze(spark.createDataFrame([*rows, (None, "no key", None, None), (3, "  ", "again", None)], SCHEMA).repartition(3), "texts")


def test_counts_equal_the_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    done, name = count_tokens(docs, PIECES)
    assert name == "n_tokens_" and done.columns[:4] == docs.columns
    for row in done.collect():
        assert row[name] == len(model.encode(row.text or "", num_threads=1)), row.text


def test_counts_by_file_equal_the_library(docs):
    model = Tokenizer.from_file(FILE)
    done, name = count_tokens(docs, FILE)
    for row in done.collect():
        assert row[name] == len(model.encode(row.text or "", add_special_tokens=False).ids), row.text


def test_encoding_and_decoding_equal_the_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded, name = encode_texts(docs, PIECES)
    decoded, back = decode_ids(coded, PIECES, name)
    for row in decoded.collect():
        ids = model.encode(row.text or "", num_threads=1)
        assert row[name] == ids, row.text
        assert row[back] == (row.text or "") == model.decode(ids)


def test_long_parts_without_spaces_equal_the_library_in_linear_time():
    model, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_table(PIECES)
    rng = random.Random(5)
    odd = ["x" * 5000, "ab" * 3000, "aaaa" * 500 + "b", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 300, "the" * 2000 + "\u00e9" * 50,
           *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 900))) for letters in ("aeiouthrsn", "ab", "etaoin shr".replace(" ", ""), "\u3042\u3044\u3046abc1") for _ in range(25))]
    for text, ids in zip(odd, table.encode(odd)):
        assert ids == model.encode(text)
    big = "".join(rng.choice(("tion", "ing", "the", "er", "qu", "z", "on", "and", "ss")) for _ in range(400_000))[:1_000_000]
    started = time.perf_counter()
    ids = table.encode([big])[0]
    assert time.perf_counter() - started < 20
    assert ids == model.encode(big)


def test_encoding_report(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row in encoding_report(docs, PIECES).collect():
        if row.doc_id is not None:
            ids = model.encode(TEXTS[row.doc_id] or "", num_threads=1)
            assert (row.n_tokens, row.ids_crc32, row.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_binary_lengths():
    for n in [*range(70), 4095, 4096, 4097, 10_000]:
        found = binary_lengths(n)
        assert sum(found) == n and all(x & (x - 1) == 0 and x <= 4096 for x in found) and found == sorted(found, reverse=True)
        assert len(found) == n // 4096 + (n % 4096).bit_count()


def test_pieces_hold_every_token_once(docs):
    model = Tokenizer.from_file(FILE)
    pieces = [r for r in pack(docs, FILE).collect() if r.doc_id not in (None, 3)]
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        own, at = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) // 4 and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert 4 * at == len(ids)


def test_sequences_are_numbered_by_bucket(docs):
    pieces = pack(docs, FILE).collect()
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))
    by_number = [r.length for r in sorted(pieces, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True) and all(r.offset == 0 for r in pieces)


def test_empty_tables_and_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty, FILE).count() == count_tokens(empty, PIECES)[0].count() == encoding_report(empty, PIECES).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        pack(empty, FILE, limit=1000)
