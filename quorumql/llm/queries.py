"""Registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumql.llm.common import held_out, table
from quorumql.llm.exact import exact_groups
from quorumql.llm.extraction import extract_text, train_tree_model
from quorumql.llm.jaccard import near_sets
from quorumql.llm.language import predict_language, train_language_model
from quorumql.llm.licences import scan_documents, train_licence_model
from quorumql.llm.neighbours import nearest
from quorumql.llm.packing import pack
from quorumql.llm.pieces import encoding_report
from quorumql.llm.simhash import near_groups
from quorumql.llm.tokens import byte_length, count_tokens
from quorumql.llm.toxicity import score_toxicity, train_toxicity_model
from quorumql.llm.variants import spelling_variants
from quorumql.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKEN_LIMIT = 4096


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op1_exact_dedup", """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
         g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    done, names = extract_text(table(spark, folder, "pages"), train_tree_model())
    return done.select("page_id", "url", F.col(names["text"]).alias("text"), F.col(names["n_chars"]).alias("n_chars"))


@query("op3_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done, name = score_toxicity(docs, train_toxicity_model(docs, table(spark, folder, "labels")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"),
                       (F.col(name) >= 0.5).cast("int").alias("predicted"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    done, name = count_tokens(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", byte_length(F.col("text")).alias("n_bytes"), F.col(name).alias("n_tokens"),
                       (F.col(name) > TOKEN_LIMIT).alias("over_limit"))


@query("op5_binary_packing")
def binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_licence_scan")
def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    done = scan_documents(docs, train_licence_model(docs))
    return done.select(F.col("key").alias("doc_id"), "families", "n_paragraphs", "confidence")


@query("op7_neighbours")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op8_simhash")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query("op9_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_report(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    done, names = predict_language(docs.select("doc_id", "text"), train_language_model(docs))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(names["lang_pred"]).alias("lang_pred"),
                       F.col(names["lang_score"]).alias("score"), F.col(names["lang_rejected"]).alias("rejected"))


@query("op11_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    done = whiten(table(spark, folder, "embeddings"))
    return done.select(F.col("key").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
                       "whitened", "explained", "identity_error")


@query("op12_jaccard_join")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_sets(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op13_spelling_variants")
def variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
