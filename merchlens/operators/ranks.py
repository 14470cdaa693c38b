"""Exact ranks, quantiles and running totals without a single-task window.

Every rank here is built from a histogram of distinct values. Values are split into
ranges whose borders come from an approximate-quantile sketch, totals per range give each
range its offset, and the ordered running count is only taken inside a range. A value held
by a third of all rows is one histogram row; a group holding a third of all rows is spread
over its ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.functions.numbers import as_int, clamp
from merchlens.operators.histogram import values_at

MAX_RANGES = 4096
RANGES_PER_PARTITION = 3  # more ranges than tasks, so that hashing them spreads evenly


def range_borders(df: DataFrame, key: Column, ranges: int | None = None) -> list[float]:
    """At most ``ranges`` sorted borders that split ``key`` into similar row counts."""
    spark = df.sparkSession
    if ranges is None:
        ranges = RANGES_PER_PARTITION * int(
            spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
            or spark.conf.get("spark.sql.shuffle.partitions")
        )
    ranges = max(2, min(MAX_RANGES, ranges))
    probs = [i / ranges for i in range(1, ranges)]
    found = df.select(key.cast("double").alias("k")).approxQuantile("k", probs, 0.5 / ranges)
    return sorted(b for b in set(found) if math.isfinite(b))


def in_range(df: DataFrame, key: Column, borders: list[float], name: str = "_range") -> DataFrame:
    """Adds the number of the range that ``key`` falls into."""
    if not borders:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *borders, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_key", outputCol=name, handleInvalid="keep")
    return bucketizer.transform(df.withColumn("_key", key.cast("double"))).drop("_key")


def ranked_values(
    df: DataFrame,
    value: str,
    groups: list[str] | None = None,
    range_key: Column | None = None,
    ranges: int | None = None,
    borders: list[float] | None = None,
) -> DataFrame:
    """One row per distinct non-null ``value`` (per group) with exact rank facts.

    Columns: groups, ``value``, ``cnt`` (rows holding it), ``before`` (rows below it) and
    ``n`` (rows in the group). ``range_key`` is a number that never decreases as ``value``
    grows; it is needed only where ``value`` is not numeric.
    """
    groups = groups or []
    key = F.col(value) if range_key is None else range_key
    rows = df.where(F.col(value).isNotNull())
    if borders is None:
        borders = range_borders(rows, key, ranges)
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt"))
    counts = in_range(counts, key, borders)
    return _running(counts, groups, "_range", [value]).drop("_range")


def _running(counts: DataFrame, groups: list[str], part: str, order: list[str]) -> DataFrame:
    """Adds ``before`` and ``n`` to counted rows already split into ordered parts."""
    slots = [*groups, part]
    offsets = _offsets(counts.groupBy(*slots).agg(F.sum("cnt").alias("_rows")), groups, part)
    placed = _beside(counts, offsets.drop("_rows"), slots)
    return _before(placed, slots, order)


def _offsets(totals: DataFrame, groups: list[str], part: str) -> DataFrame:
    """Rows in earlier parts and in all parts; at most MAX_RANGES rows per group."""
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*groups)
    return totals.select(
        *groups,
        part,
        "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(everything).alias("n"),
    )


def _beside(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the other columns of ``facts``; NULL keys match each other."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    extra = [f"f.{c}" for c in facts.columns if c not in keys]
    return rows.alias("r").join(facts.alias("f"), reduce(and_, same)).select("r.*", *extra)


def _before(counts: DataFrame, slots: list[str], order: list[str]) -> DataFrame:
    inside = Window.partitionBy(*slots).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("cnt").over(inside), F.lit(0))
    return counts.withColumn("before", F.col("_offset") + earlier).drop("_offset")


def at_rank(position: Column) -> Column:
    """True on the histogram row that holds the 0-based sorted ``position``."""
    return (F.col("before") <= position) & (position < F.col("before") + F.col("cnt"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: list[str] | None = None,
    method: str = "linear",
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    ``linear`` interpolates between neighbours, ``floor`` takes the value at the floored
    position (no interpolation). ``known`` is a stored histogram of the rows.
    """
    groups = groups or []

    def positions(n: Column) -> list[Column]:
        places = [(n - 1) * F.lit(float(p)) for p in probs.values()]
        return [F.floor(p) for p in places] + ([] if method == "floor" else [F.ceil(p) for p in places])

    ranked = values_at(df, value, positions, groups, known)
    aggregates, results = [F.max("n").alias("n")], [F.col("n")]
    for name, p in probs.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        aggregates.append(F.max(F.when(at_rank(low), F.col(value))).alias(f"{name}_lo"))
        lower = F.col(f"{name}_lo")
        if method == "floor":
            results.append(lower.alias(name))
            continue
        aggregates.append(F.max(F.when(at_rank(high), F.col(value))).alias(f"{name}_hi"))
        step = F.col(f"{name}_hi") - lower
        results.append((lower + step * (position - F.floor(position))).alias(name))
    return ranked.groupBy(*groups).agg(*aggregates).select(*groups, *results)


def quantile_values(df: DataFrame, value: str, probs: dict[str, float], method: str = "linear") -> dict:
    """The quantiles of a whole column as plain numbers, and ``n`` (one small row)."""
    return exact_quantiles(df, value, probs, method=method).first().asDict()


def pct_rank(df: DataFrame, value: str, out: str, population: DataFrame | None = None) -> DataFrame:
    """Share of the population below the value: ``below / (n - 1)``.

    Without ``population`` the rows rank among themselves. Probes of another frame may land
    between or above the population's values, so they are merged into its histogram.
    """
    ranked = population is None and ranked_values(df, value)
    if population is None:
        share = F.col("before") / F.greatest(F.lit(1), F.col("n") - 1)
        lookup = ranked.select(F.col(value).alias("_v"), share.alias(out))
    else:
        merged = (
            population.select(F.col(value).alias("_v"), F.lit(1).alias("_own"))
            .unionAll(df.select(F.col(value).alias("_v"), F.lit(0).alias("_own")))
            .where(F.col("_v").isNotNull())
        )
        borders = range_borders(merged, F.col("_v"))
        counts = merged.groupBy("_v").agg(F.sum("_own").alias("cnt"))
        steps = _running(in_range(counts, F.col("_v"), borders), [], "_range", ["_v"])
        share = F.col("before") / F.greatest(F.lit(1), F.col("n") - 1)
        lookup = steps.select("_v", F.when(F.col("n") > 0, share).alias(out))
    return df.join(lookup, df[value] == lookup["_v"], "left").drop("_v")


def rank_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """Mean rank of ties over ``n - 1``; 1 for a lone value, 0.5 for a missing one."""
    middle = F.col("before") + (F.col("cnt") - 1) / 2
    share = F.when(F.col("n") == 1, 1.0).otherwise(clamp(middle / (F.col("n") - 1)))
    lookup = ranked_values(df, value).select(F.col(value).alias("_v"), share.alias(out))
    joined = df.join(lookup, df[value] == lookup["_v"], "left").drop("_v")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0.5)))


def fill_by_rank(df: DataFrame, target: str, units: str = "units_sold", rating: str = "rating") -> DataFrame:
    """Fills a missing magnitude with 100 x the mean of the units and rating percentiles."""
    ranked = rank_percentile(rank_percentile(df, units, "_u"), rating, "_r")
    guess = clamp(as_int((F.col("_u") + F.col("_r")) / 2 * 100), 0, 100)
    return ranked.withColumn(target, F.coalesce(as_int(F.col(target)), guess)).drop("_u", "_r")


def row_numbers(df: DataFrame, order: str, unique: str, out: str, descending: bool = False) -> DataFrame:
    """1-based global position by ``order`` then ``unique`` (a distinct number per row)."""
    work = df.withColumn("_o", -F.col(order) if descending else F.col(order))
    outer = ranked_values(work, "_o").select(F.col("_o").alias("_v"), F.col("before").alias("_below"))
    inner = ranked_values(work, unique, ["_o"]).select(
        F.col(unique).alias("_u"), F.col("_o").alias("_v2"), F.col("before").alias("_tied")
    )
    placed = inner.join(outer, F.col("_v2") == F.col("_v")).select(
        "_u", (F.col("_below") + F.col("_tied") + 1).alias(out)
    )
    return work.drop("_o").join(placed, F.col(unique) == F.col("_u")).drop("_u")


def number_by_unique(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based global position by a distinct numeric ``key``: one shuffle, no join back."""
    parts = in_range(df, F.col(key), range_borders(df, F.col(key)))
    earlier = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))  # at most MAX_RANGES rows
        .select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_range").orderBy(key)
    numbered = parts.join(offsets, "_range")
    return numbered.withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1).drop("_range", "_offset")


KEY_BYTES = 6
TEXT_BYTES = 3


def text_range_key(c: Column, done: int = 0) -> Column:
    """A number that never decreases as texts with equal first ``done`` bytes grow: the next six bytes."""
    digits = F.substring(F.hex(F.encode(c, "UTF-8")), 2 * done + 1, 2 * KEY_BYTES)
    return F.conv(F.rpad(digits, 2 * KEY_BYTES, "0"), 16, 10).cast("double")


def nth_text(df: DataFrame, item: str, k: int) -> str | None:
    """The ``k``-th smallest text (1-based, NULLs left out; the largest if there are fewer).

    Chosen three bytes at a time: a pass counts the rows by the next bytes (at most 2^24 of them),
    the next one goes on with those that share the chosen ones. So ids with a long common prefix
    cost passes, never one large task.
    """
    rows, done = df.select(item).where(F.col(item).isNotNull()), 0
    while True:
        part = F.substring(F.hex(F.encode(F.col(item), "UTF-8")), 2 * done + 1, 2 * TEXT_BYTES)
        counted = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("cnt"), F.min(item).alias("low"), F.max(item).alias("high"))
        upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = counted.withColumn("upto", F.sum("cnt").over(upto)).withColumn("n", F.sum("cnt").over(Window.partitionBy()))
        hit = counted.where(F.col("upto") >= F.least(F.lit(k), F.col("n"))).orderBy("_part").first()
        if hit is None or hit["low"] == hit["high"]:
            return hit and hit["low"]
        k = min(k, hit["n"]) - (hit["upto"] - hit["cnt"])
        rows, done = rows.where(part == hit["_part"]), done + TEXT_BYTES


@dataclass(frozen=True)
class Cutoff:
    """The last (distance, id) pair that belongs to the ``k`` smallest; None admits all ties."""

    distance: float
    item: str | None = None

    def admits(self, distance: Column, item: Column) -> Column:
        if self.item is None:
            return distance <= self.distance
        return (distance < self.distance) | ((distance == self.distance) & (item <= self.item))


def smallest(df: DataFrame, distance: str, item: str, k: int) -> Cutoff | None:
    """Cut-off of the ``k`` smallest rows by ``distance``, ties by ``item`` as text."""
    if k <= 0:
        return None

    def upto(count: int) -> Callable[[Column], list[Column]]:
        return lambda n: [F.least(F.lit(count), n) - 1]

    first = values_at(df, distance, upto(k)).where(at_rank(F.least(F.lit(k), F.col("n")) - 1))
    row = first.select(distance, "before", "cnt").first()
    if row is None:
        return None
    left = k - row["before"]
    if left >= row["cnt"]:
        return Cutoff(row[0])
    tied = df.where(F.col(distance) == row[0])
    return Cutoff(row[0], nth_text(tied, item, left))


MOST_BONUSES = 100


@dataclass(frozen=True)
class Apportion:
    """Column names of :func:`apportion`'s input."""

    key: str = "key"
    value: str = "value"


def _group_facts(rows: DataFrame, facts: DataFrame, groups: list[str] | None) -> DataFrame:
    """Each row with the facts of its group ``_g``; those of the only group by a scalar subquery."""
    if groups:
        return rows.join(facts, "_g")
    only = facts.select(F.struct(*[c for c in facts.columns if c != "_g"])).scalar()
    return rows.withColumn("_facts", only).select("*", "_facts.*").drop("_facts")


def apportion(
    df: DataFrame,
    groups: list[str] | None = None,
    names: Apportion = Apportion(),
    out: str = "share",
    previous: str | None = None,
) -> DataFrame:
    """Splits 100 over the rows of each group, or of the whole frame, by largest remainder.

    Keys are unique in their group; NULL counts as a key and as a group. Negative, missing and
    infinite values count as 0. Ties go to the larger key. A group whose values sum to zero is
    split evenly and its remainder goes to the smaller keys, unless ``previous`` names a column
    of earlier shares: such a group keeps the whole parts of those it has (0 where one is
    missing), and is split evenly only when it has none. At most 100 rows of a group can receive
    a remainder unit, so only the top 100 of each group are ranked.
    """
    group = F.struct(F.lit(0).alias("_all"), *(groups or []))  # structs match NULL with NULL
    value = F.col(names.value).cast("double")
    usable = (value > 0) & (value < float("inf"))
    rows = df.select("*", group.alias("_g"), F.when(usable, value).otherwise(0.0).alias("_v"))
    # a power of two near the largest value takes the scale out of a value without rounding it
    scales = rows.groupBy("_g").agg(F.max("_v").alias("_max")).select(
        "_g", F.when(F.col("_max") > 0, F.pow(F.lit(2.0), F.floor(F.log2("_max")))).otherwise(1.0).alias("_scale")
    )
    scaled = _group_facts(rows, scales, groups).withColumn("_v", F.col("_v") / F.col("_scale")).drop("_scale")
    before = F.col(previous).cast("long") if previous else F.lit(None).cast("long")
    totals = scaled.groupBy("_g").agg(
        F.sum(F.col("_v").cast("decimal(20,18)")).cast("double").alias("_total"),
        F.count(F.lit(1)).alias("_size"),
        F.count(before).alias("_known"),
    )
    even = F.col("_total") <= 0
    exact = F.when(even, F.floor(F.lit(100) / F.col("_size")).cast("double")).otherwise(
        F.col("_v") / F.col("_total") * 100
    )
    shares = _group_facts(scaled, totals, groups).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = shares.groupBy("_g").agg((F.lit(100) - F.sum("_floor")).alias("_left"))
    # a group is either even (keys ascending) or not (keys descending): one of the two is NULL
    place = Window.partitionBy("_g").orderBy(
        F.desc("_f"), F.asc(F.when(F.col("_even"), F.col("_k"))), F.desc(F.when(~F.col("_even"), F.col("_k")))
    )
    fraction = F.when(even, 0.0).otherwise(F.col("_exact") - F.col("_floor"))
    ranked = shares.select("_g", F.col(names.key).alias("_k"), fraction.alias("_f"), even.alias("_even"))
    top = ranked.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= MOST_BONUSES)
    bonus = (
        _group_facts(top, left, groups)
        .where(F.col("_rn") <= F.col("_left"))
        .select(F.struct("_g", "_k").alias("_row"), F.lit(1).alias("_bonus"))
    )
    keyed = shares.withColumn("_row", F.struct("_g", F.col(names.key).alias("_k")))
    split = (F.col("_floor") + F.coalesce(F.col("_bonus"), F.lit(0))).cast("long")
    kept = even & (F.col("_known") > 0)
    return (
        keyed.join(bonus, "_row", "left")
        .withColumn(out, F.when(kept, F.coalesce(before, F.lit(0))).otherwise(split))
        .drop("_g", "_v", "_total", "_size", "_known", "_exact", "_floor", "_row", "_bonus")
    )
