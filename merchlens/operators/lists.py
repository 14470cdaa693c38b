"""Product lists: membership, counts, moves, lookups and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.operators.latest import latest_score



def products_in_list(products: DataFrame, list_items: DataFrame, list_id: int) -> DataFrame:
    """Products of one list, newest import first."""
    members = list_items.where(F.col("list_id") == list_id).select(F.col("product_id").alias("id"))
    return products.join(members, "id").orderBy(F.desc("import_date"), "id")


def list_counts(lists: DataFrame, list_items: DataFrame) -> DataFrame:
    """Every list with its number of members, zero included.

    Members are counted before the join, so a huge list travels as one row.
    """
    counts = list_items.groupBy("list_id").agg(F.count("product_id").alias("count"))
    return (
        lists.join(counts, lists["id"] == counts["list_id"], "left")
        .select("id", "name", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("name")
    )


def job_products(products: DataFrame, items: DataFrame, job_id: int) -> DataFrame:
    """Ids of products a job touched, by signature."""
    touched = items.where(F.col("job_id") == job_id).select("sig_hash")
    return products.join(touched, "sig_hash", "left_semi").select("id").distinct().orderBy("id")


def add_list_members(list_items: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent add of (list_id, product_id) pairs."""
    return list_items.unionByName(new).dropDuplicates(["list_id", "product_id"])


def remove_list_members(list_items: DataFrame, gone: DataFrame) -> DataFrame:
    return list_items.join(gone, ["list_id", "product_id"], "left_anti")


def move_list_members(
    lists: DataFrame, list_items: DataFrame, source: int, target: int | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drops a list; with ``target`` its members move there, those already in are kept once.

    Returns lists, members and a one-row count of moved (or detached) products. Protected
    names and unknown lists are refused.
    """
    rows = {r["id"]: r["name"] for r in lists.where(F.col("id").isin([i for i in (source, target) if i is not None])).collect()}
    if source not in rows:
        raise ValueError("list not found")
    if rows[source].lower() in vocab.PROTECTED_LISTS:
        raise ValueError("protected list")
    if target is not None and (target == source or target not in rows):
        raise ValueError("target list must be another existing list")
    leaving = list_items.where(F.col("list_id") == source)
    staying = list_items.where(F.col("list_id") != source)
    kept_lists = lists.where(F.col("id") != source)
    if target is None:
        return kept_lists, staying, leaving.agg(F.count(F.lit(1)).alias("count"))
    present = staying.where(F.col("list_id") == target).select("product_id")
    moved = leaving.select(F.lit(target).cast("long").alias("list_id"), "product_id").join(
        present, "product_id", "left_anti"
    )
    return (
        kept_lists,
        staying.select("list_id", "product_id").unionByName(moved),
        moved.agg(F.count(F.lit(1)).alias("count")),
    )


def find_by_name(products: DataFrame, names: DataFrame) -> DataFrame:
    """For every wanted name the first product that equals it, ignoring case."""
    wanted = names.select(F.lower("name").alias("wanted")).distinct()
    return (
        products.select(F.lower("name").alias("wanted"), "id")
        .join(wanted, "wanted", "left_semi")
        .groupBy("wanted")
        .agg(F.min("id").alias("id"))
    )


def compare_products(products: DataFrame, scores: DataFrame, ids: list[int]) -> DataFrame:
    """One row per score metric, one column per product (``p<id>``)."""
    chosen = list(dict.fromkeys(ids))
    metrics = ["total_score", *vocab.SUB_SCORES]
    wanted = products.where(F.col("id").isin(chosen)).select("id")
    newest = latest_score(scores.where(F.col("product_id").isin(chosen)))
    rows = wanted.join(newest.select(F.col("product_id").alias("id"), *metrics), "id", "left")
    long = rows.unpivot("id", metrics, "metric", "value")
    return (
        long.withColumn("id", F.concat(F.lit("p"), F.col("id")))
        .groupBy("metric")
        .pivot("id", [f"p{i}" for i in chosen])
        .agg(F.first("value"))
    )
