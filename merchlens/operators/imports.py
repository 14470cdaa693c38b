"""The import as one stored step: read, map, type, number, merge into the stored products, score."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.operators.merge import append_changes, dedup_last, read_merged
from merchlens.operators.scoring import ScoreConfig, winner_score
from merchlens.session import cut_lineage
from merchlens.sources.catalog import SEQ_COLUMN, map_columns, read_catalog, read_catalog_dir
from merchlens.sources.normalise import assign_ids, normalise_products

KEPT = {"winner_score": 0}


def stored_products(spark: SparkSession, root: str) -> DataFrame | None:
    """The products of all imports into ``root``, or None before the first one."""
    return read_merged(spark, root, "sig_hash", KEPT, ["id"])


def import_catalog(
    spark: SparkSession,
    path: str | list[str],
    root: str,
    config: ScoreConfig,
    fmt: str | None = None,
    locale: str = "eu",
    source: str | None = None,
    import_date: Column | None = None,
    run: str | None = None,
) -> DataFrame:
    """Adds a catalogue's products to those stored in ``root``, and returns all of them with scores.

    ``path`` is a folder of CSV and JSON files, or with ``fmt`` what :func:`read_catalog` takes. Of
    rows with one signature the last holds. A product that is stored already keeps its id, and its
    score where the catalogue has none; new ones are numbered after the highest id, in the order of
    files and lines. Other columns take the catalogue's values, missing ones included.

    ``run`` names the import: one that runs again under its name replaces what it stored. Without
    rows that have a name nothing is stored; the first such import returns no rows.
    """
    raw = read_catalog_dir(spark, str(path)) if fmt is None else read_catalog(spark, path, fmt)
    staged = normalise_products(map_columns(raw), locale, source, import_date, numeric_input=fmt == "json")
    last = cut_lineage(dedup_last(staged, ["sig_hash"], SEQ_COLUMN))
    stored = stored_products(spark, root)
    if stored is None:
        changes = assign_ids(last)
    else:
        known = cut_lineage(stored.select("sig_hash", "id"))
        numbered = last.join(known, "sig_hash", "left")
        fresh = assign_ids(numbered.where(F.col("id").isNull()).drop("id"), known)
        changes = numbered.where(F.col("id").isNotNull()).unionByName(fresh)
    append_changes(changes.drop(SEQ_COLUMN).withColumn("id", F.col("id").cast("long")), root, run or uuid.uuid4().hex)
    return winner_score(stored_products(spark, root), config)
