"""The pipeline and the registered queries on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quorumql.llm.exact import exact_groups
from quorumql.llm.queries import ORACLES, QUERIES
from quorumql.llm.simhash import near_groups
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert [n for n in range(1, 14) if sum(name.startswith(f"op{n}_") for name in QUERIES) != 1] == []
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_exact_dedup_equals_its_sql(spark):
    connection = connect(FOLDER)
    assert isinstance(connection, duckdb.DuckDBPyConnection)
    assert compare(spark, connection, "op1_exact_dedup", FOLDER).startswith("ok")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, FOLDER)
        assert made.columns == columns, name
        made.write.parquet(path := f"{tmp_path}/{number}")
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert counts[1] >= 0.98 * counts[0]  # every document of the tables has a language
    assert exact_groups(docs).filter("NOT kept").count() == near_groups(docs).filter("NOT kept").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    by_doc = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(by_doc) == counts[-1] and all(r["sum(length)"] == r["max(doc_tokens)"] for r in by_doc)


def test_stages_on_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, FOLDER)
        made.write.parquet(path := f"{tmp_path}/{number}")
        docs = spark.read.parquet(path)
        assert docs.count() == 0


def test_stages_on_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = docs.filter("lang = 'en'").orderBy("n_chars").collect()[-1]
    odd = [(90_001, None), (90_002, ""), (90_003, "12 34 !?"), (90_004, (long.text + " ") * 60), (90_005, long.text.upper()), (90_006, long.text), (90_006, long.text), (None, long.text)]
    more = spark.createDataFrame([(k, t, None, "x", len(t or "")) for k, t in odd], docs.schema)
    # Extra columns carry the names that the stages use inside.
    docs = docs.unionByName(more).selectExpr("*", "doc_id AS row", "source AS key", "1 AS fp", "'y' AS lang_pred", "0.5D AS score")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, FOLDER)
        assert made.columns == columns, name
        made.write.parquet(path := f"{tmp_path}/{number}")
        docs = spark.read.parquet(path)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert not {90_001, 90_002, 90_003} & set(kept)
    assert sum(t.lower() == long.text.lower() for t in kept.values()) <= 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == len(kept)


@pytest.mark.parametrize("name, wanted", [
    ("op2_html_extraction", "page_id url text n_chars"), ("op4_token_counts", "doc_id n_bytes n_tokens over_limit"),
    ("op5_binary_packing", "doc_id start length ids_crc32 doc_tokens sequence_id offset"), ("op7_neighbours", "query_id rank vec_id score"),
    ("op8_simhash", "doc_id fingerprint component_id"), ("op10_language_id", "doc_id held_out lang_pred score"),
    ("op11_whitening", "vec_id component n deviation whitened explained identity_error"), ("op12_jaccard_join", "doc_id n_shingles component_id"),
    ("op13_spelling_variants", "word form root n n_near form_n")])
def test_queries_return_their_columns(spark, name, wanted):
    done = QUERIES[name](spark, FOLDER)
    assert done.columns[: len(wanted.split())] == wanted.split()
    rows = {"op2": 50, "op4": 200, "op7": 25 * 20, "op8": 200, "op10": 200, "op11": 500 * 32, "op12": 200}.get(name.split("_")[0])
    assert rows is None or done.count() == rows
