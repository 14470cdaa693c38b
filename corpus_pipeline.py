"""Corpus pipeline: from raw documents to a mix for training, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as
Parquet and reads again as the next stage's ``docs``. All but the last return the columns of
``documents``; ``n_chars`` follows the text.

NULLs: a document without text is rejected by the first stage; NULL in other columns stays as
it is (a NULL source is a source of its own, a NULL doc_id an id like any other). An empty
table passes through. Rows that repeat a document count as its copies: the near-duplicate
stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlens.llm import decontaminate, language, line_runs, minhash, mixing
from merchlens.llm.common import WORD, free_shuffles, stored, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_products(docs: DataFrame) -> DataFrame:
    """Documents as product records."""
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("lang").alias("language"), "source"
    )


def as_documents(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("doc_id"),
        F.col("description").alias("text"),
        F.col("language").alias("lang"),
        "source",
        F.length("description").cast("long").alias("n_chars"),
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in which no language has 0.4 of the words."""
    model = language.learn_languages(as_products(docs))
    return language.drop_unidentified(docs.select(*COLUMNS), model, id="doc_id", text="text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents left without a word go."""
    kept = line_runs.dedup_lines(as_products(docs), carry=("language", "source"))
    return as_documents(kept.where(F.regexp("description", F.lit(WORD))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates (five words, 0.8)."""
    found = minhash.near_duplicates(as_products(docs), width=5, percent=80)
    kept = found.where("kept").select(F.col("id").alias("_kept")).distinct()
    held = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return held.withColumn("_key", text_key(F.col("text"))).dropDuplicates(["doc_id", "_key"]).drop("_key")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark question, re-parameterised or not."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    questions = benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("description"))
    found = decontaminate.find_questions(as_products(docs), questions)
    leaks = stored(found.select(F.col("id").alias("_id"), "_key").distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key"))
    return docs.select(*COLUMNS).join(leaks, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with how many: target, size, taken.

    Rows that repeat id and text each take their own part of the mix.
    """
    mixed = mixing.mix_sources(as_products(docs)).select(
        F.col("id").alias("_id"), F.col("text_digest").alias("_digest"), "size", "target", "taken"
    )
    copy = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("taken", "target"))
    mixed = stored(mixed, "mix")
    repeated = mixed.groupBy("_id", "_digest").count().where("count > 1").select("_id", "_digest")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_digest"))
    rows = docs.select(*COLUMNS)
    if not repeated.head(1):
        return rows.join(mixed.where("taken > 0"), same).drop("_id", "_digest")
    mixed = mixed.withColumn("_copy", copy("_id", "_digest"))
    numbered = rows.withColumn("_key", text_key(F.col("text"))).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("source", "lang", "n_chars"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")) & (F.col("_nth") == F.col("_copy"))
    return numbered.join(mixed.where("taken > 0"), same).drop("_id", "_digest", "_key", "_nth", "_copy")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("source_mix", mix_sources),
]

#: No SQL expresses the language model, so the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        free_shuffles(spark)
    return docs
