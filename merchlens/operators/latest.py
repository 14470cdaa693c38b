"""Newest row per key and its attachment to products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row with the largest ``order`` values of each key.

    An aggregation with map-side combine, so a hot key never lands whole in one task. Only the
    wanted ``columns`` (all if not given) are read and shuffled.
    """
    newest = F.max_by(F.struct(*(columns or df.columns)), F.struct(*order))
    return df.groupBy(F.col(key).alias("_key")).agg(newest.alias("_row")).select("_row.*")


def latest_score(scores: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return latest_per(scores, "product_id", ["created_at", "id"], columns)


def attach_latest_score(products: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Products with columns of their newest score; NULL where there is none."""
    newest = latest_score(scores, ["product_id", *columns]).select(F.col("product_id").alias("id"), *columns)
    kept = [c for c in products.columns if c not in columns]
    return products.select(*kept).join(newest, "id", "left")
