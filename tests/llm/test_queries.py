"""The registered queries and the pipeline over whole small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from merchlens.llm import mixing, queries
from tools import verify

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    ok, note = verify.compare(spark, verify.duck(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, note


def test_one_query_for_each_operator_and_the_pipeline():
    names = entry.queries()
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    asked = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    top = docs.agg(F.max("doc_id")).first()[0]
    first = docs.where("lang = 'en' AND n_chars > 1500").orderBy("doc_id").first()
    clean = " ".join(f"aclear{i} ofthe{i * 7 % 31} inge{i}" for i in range(80))
    words = clean.replace("a", "e").split()
    words[3] = "changed"
    extra = [
        (top + 1, None, "en", "s", 0), (top + 2, "", None, None, 0), (top + 3, "12 34 !", "en", "s", 7), (top + 4, first["text"], "en", None, 1),
        (top + 5, clean, "en", "s", 1), (top + 6, clean.replace("a", "e"), "en", "s", 1), (top + 7, " ".join(words), "en", "s", 1),
        (top + 8, f"some words here. {asked} and after it", "en", "s", 1), (None, "the only one with thousands ofthe nothing", None, None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        if name != "source_mix":
            assert docs.columns == corpus_pipeline.COLUMNS
    language, lines, near, leaks, mix = seen
    assert not {top + 1, top + 2, top + 3} & language and {top + 4, top + 5, None} <= language
    assert top + 4 not in lines and {top + 5, top + 6, top + 7} <= lines
    assert {top + 5, top + 6} <= near and top + 7 not in near
    assert top + 8 in near and top + 8 not in leaks and top + 5 in leaks
    assert mix <= leaks and docs.where("taken > 3 * size OR taken <= 0").count() == 0


def test_the_mix_takes_each_repeated_row_once(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, "d e", "en", "t", 3), (None, "f", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, FOLDER)
    want = mixing.mix_sources(corpus_pipeline.as_products(docs)).where("taken > 0")
    taken = sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in got.collect())
    assert taken == sorted((r.id is None, r.id or 0, r.taken) for r in want.collect()) and [t[1] for t in taken].count(1) == 2
    assert got.columns == [*corpus_pipeline.COLUMNS, "size", "target", "taken"]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0


def test_license_counts_match_sql(spark):
    got = sorted((r["doc_id"], r["n_words"]) for r in queries.op1(spark, FOLDER).collect())
    sql = f"""SELECT doc_id, len(regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM '{FOLDER}/documents.parquet' ORDER BY 1"""
    assert got == duckdb.sql(sql).fetchall()
