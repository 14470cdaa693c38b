"""Upserts: last row wins inside a load, then a keyed merge, or changes that are merged on reading."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.session import hadoop_path


def dedup_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` per key, combined map-side."""
    last = F.max_by(F.struct(*df.columns), F.col(sequence))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(last.alias("_row")).select("_row.*")


def merge_rows(
    existing: DataFrame, incoming: DataFrame, keys: list[str], keep_old_if_null: dict[str, object] | None = None,
    keep_always: list[str] | None = None,
) -> DataFrame:
    """Insert-or-replace by key (keys NULL-free and unique on both sides).

    Incoming values replace the old ones, NULLs included. Columns in ``keep_old_if_null``
    keep the old value where the new one is NULL, then take the given default.
    ``keep_always`` columns keep the old value of matched rows.
    """
    defaults = keep_old_if_null or {}
    fixed = set(keep_always or [])
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in incoming.columns], F.lit(True).alias("_new"))
    match = [existing[k] == new[f"_n_{k}"] for k in keys]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    joined = existing.withColumn("_old", F.lit(True)).join(new, condition, "full_outer")

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        fresh, old = F.col(f"_n_{c}"), F.col(c)
        if c in fixed:
            return F.when(F.col("_old").isNotNull(), old).otherwise(fresh).alias(c)
        if c in defaults:
            return F.coalesce(fresh, old, F.lit(defaults[c])).alias(c)
        return F.when(F.col("_new").isNotNull(), fresh).otherwise(old).alias(c)

    return joined.select(*[value(c) for c in existing.columns])


def upsert_products(existing: DataFrame, staged: DataFrame, sequence: str = "seq", key: str = "sig_hash") -> DataFrame:
    """Last staged row per signature, merged; a missing new score keeps the old one, else 0."""
    last = dedup_last(staged, [key], sequence).drop(sequence)
    return merge_rows(existing, last, [key], {"winner_score": 0}, ["id"] if "id" in last.columns else None)


def cache_upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Insert-or-replace of cache rows, newest ``sequence`` first."""
    return merge_rows(cache, dedup_last(fresh, keys, sequence), keys)


# --- stored changes ---------------------------------------------------------------------
#
# A table that grows by batches is a folder of plain Parquet files, one sub-folder a writer's run
# and batch. Nothing is ever rewritten but by the same batch running again, and which row of a
# key holds is decided on reading.


def append_changes(changes: DataFrame, root: str, run: str, batch: int = 0) -> None:
    """Adds changed rows (one per key) to the folder ``root``; the same run and batch replace themselves.

    ``run`` is unique to a writer, as a streaming query's id is. A batch is later than every one
    that was stored before it by the clock of whoever stores it.
    """
    stored_at = F.lit(datetime.now(timezone.utc))
    changes.withColumn("_stored_at", stored_at).write.mode("overwrite").parquet(f"{root}/run={run}/batch={batch}")


def read_merged(
    spark: SparkSession, root: str, key: str = "sig_hash", keep_old_if_null: dict[str, object] | None = None,
    keep_always: list[str] | None = None,
) -> DataFrame | None:
    """The last row per key of all stored changes: one aggregation; None before the first ones.

    Gives the rows that merging batch after batch would give, with the meaning of
    :func:`merge_rows`.
    """
    path, files = hadoop_path(spark, root)
    if not files.exists(path):
        return None
    rows = spark.read.option("mergeSchema", True).parquet(root)
    defaults, fixed = keep_old_if_null or {}, keep_always or []
    columns = [c for c in rows.columns if c not in ("_stored_at", "run", "batch")]
    version = F.struct("_stored_at", F.col("run").cast("string"), "batch")
    special = [F.max_by(c, F.when(F.col(c).isNotNull(), version)).alias(f"_k_{c}") for c in defaults]
    special += [F.min_by(c, version).alias(f"_k_{c}") for c in fixed]
    newest = F.max_by(F.struct(*[c for c in columns if c != key]), version).alias("_row")
    merged = rows.groupBy(key).agg(newest, *special)

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in defaults:
            return F.coalesce(F.col(f"_k_{c}"), F.lit(defaults[c])).alias(c)
        return (F.col(f"_k_{c}") if c in fixed else F.col(f"_row.{c}")).alias(c)

    return merged.select(*[value(c) for c in columns])
