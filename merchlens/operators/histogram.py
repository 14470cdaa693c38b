"""A histogram of numbers that adds up, and the exact values at sorted positions read from it.

Bins are fixed: every octave of a number's size is cut into :data:`PARTS` of them, so that
histograms of different partitions, days or tables are added bin by bin (:func:`merged`), and
their size depends on the numbers' magnitudes but not on how many there are. A bin knows its
rows, its smallest and its largest value. A sorted position is found by running sums over bins;
where a bin holds several values, it alone is cut into :data:`SPLIT` bins between its smallest and
largest value in one further pass, until the position's bin holds one value. Nothing but bins
is ever shuffled, and a value that a third of all rows share is one bin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.session import cut_lineage

PARTS = 256
SPLIT = 1 << 16
_LOWEST, _HIGHEST = 1075, 2101  # octaves of the smallest number above 0, and of infinity, counted from 1


def value_bin(value: Column) -> Column:
    """The number of a value's bin, which never falls as the value grows; not-a-number comes last."""
    number = value.cast("double")
    size = F.abs(number)
    octave = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), octave) - 1.0) * PARTS)
    place = (octave + _LOWEST) * PARTS + F.least(F.greatest(part, F.lit(0)), F.lit(PARTS - 1)) + 1
    place = F.when(size == 0, 0).when(size == float("inf"), _HIGHEST * PARTS).otherwise(place)
    return F.when(F.isnan(number), (_HIGHEST + 1) * PARTS).when(number < 0, -place).otherwise(place).cast("int")


def histogram(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """groups, ``bin``, ``cnt``, ``low``, ``high``: one row per bin that holds rows; NULLs have none."""
    rows = df.where(F.col(value).isNotNull()).select(*(groups or []), F.col(value).alias("_v"))
    return rows.groupBy(*(groups or []), value_bin(F.col("_v")).alias("bin")).agg(*_facts(F.col("_v")))


def _facts(value: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("cnt"), F.min(value).alias("low"), F.max(value).alias("high")]


def merged(parts: list[DataFrame], groups: list[str] | None = None) -> DataFrame:
    """The histogram of all rows that the given histograms were made of."""
    united = reduce(DataFrame.unionByName, parts)
    return united.groupBy(*(groups or []), "bin").agg(F.sum("cnt").alias("cnt"), F.min("low").alias("low"), F.max("high").alias("high"))


def values_at(
    df: DataFrame,
    value: str,
    positions: Callable[[Column], list[Column]],
    groups: list[str] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The distinct values at some sorted positions: groups, ``value``, ``cnt``, ``before`` and ``n``.

    ``positions`` gives the wanted 0-based positions from ``n``, the group's rows. ``cnt`` rows hold
    the value and ``before`` rows are below it. ``known`` is a stored histogram of the same rows,
    which saves the first of usually two passes.
    """
    groups, bins = groups or [], ["bin"]
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    running = Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = (histogram(df, value, groups) if known is None else known).select(
        *groups, "bin", "cnt", "low", "high",
        F.coalesce(F.sum("cnt").over(running), F.lit(0)).alias("before"),
        F.sum("cnt").over(Window.partitionBy(*groups)).alias("n"),
    )
    rows, settled = rows.withColumn("bin", value_bin(F.col("_v"))), []
    while True:
        found = cut_lineage(counted.where(_holds(positions)))
        several = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
        settled.append(found.where(~several).select(*groups, F.col("low").alias(value), "cnt", "before", "n"))
        mixed = found.where(several)
        if not mixed.head(1):
            return reduce(DataFrame.unionByName, settled)
        rows, counted = _split(rows, mixed, groups, bins)
        bins = [*bins, f"part{len(bins)}"]


def _holds(positions: Callable[[Column], list[Column]]) -> Column:
    end = F.col("before") + F.col("cnt")
    return reduce(or_, [(F.col("before") <= p) & (p < end) for p in positions(F.col("n"))])


def _split(rows: DataFrame, mixed: DataFrame, groups: list[str], bins: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the mixed bins with the part of their bin they fall into, and these parts counted."""
    part = f"part{len(bins)}"
    facts = mixed.select(
        *[F.col(c).alias(f"_{c}") for c in [*groups, *bins]], F.col("low").alias("_low"), F.col("high").alias("_high"),
        F.col("before").alias("_before"), F.col("n").alias("_n"),
    )
    if not groups:  # at most one bin a position: a scan can leave out rows of others
        limits = [(r["_low"], r["_high"]) for r in facts.select("_low", "_high").collect()]
        rows = rows.where(reduce(or_, [F.col("_v").between(F.lit(low), F.lit(high)) for low, high in limits]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups] + [F.col(c) == F.col(f"_{c}") for c in bins]
    inside = rows.join(facts, reduce(lambda a, b: a & b, same))
    share = (F.col("_v") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low")).cast("double")
    inside = inside.withColumn(part, F.least(F.floor(share * SPLIT), F.lit(SPLIT - 1)).cast("int"))
    slots = [*groups, *bins]
    parts = inside.groupBy(*slots, part, "_before", "_n").agg(*_facts(F.col("_v")))
    running = Window.partitionBy(*slots).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.select(
        *slots, part, "cnt", "low", "high", (F.col("_before") + F.coalesce(F.sum("cnt").over(running), F.lit(0))).alias("before"), F.col("_n").alias("n")
    )
    return inside.select(*slots, part, "_v"), counted
