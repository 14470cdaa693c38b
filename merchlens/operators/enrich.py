"""Bookkeeping around enrichment: cache hits, variants, triage, batches, budget, results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from math import inf
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.functions import vocab
from merchlens.functions.dates import parse_date
from merchlens.functions.numbers import clamp, strict_double
from merchlens.functions.text import (
    bind, cleanse, low_quality_text, rstrip, strip, token_estimate, variant_key,
)
from merchlens.operators.filters import update_columns
from merchlens.operators.merge import cache_upsert
from merchlens.operators.ranks import in_range, number_by_unique, range_borders

CACHE_TTL_DAYS = 30
CONFIDENCE_FLOOR = 0.70
MIN_BATCH, MAX_BATCH, TARGET_TOKENS = 10, 30, 6000
REASON_LENGTH = 120


# --- cache ----------------------------------------------------------------------------


def cache_lookup(
    items: DataFrame,
    cache: DataFrame,
    as_of: datetime,
    ttl_days: int | None = CACHE_TTL_DAYS,
    keys: list[str] | None = None,
    min_text: Column | None = None,
    judged: list[str] | None = None,
) -> DataFrame:
    """Items with their cached values and a ``hit`` flag; expired entries do not count.

    ``keys`` may name more than the signature (model, version). ``min_text`` is a predicate
    over the joined row that a hit has to meet. Where ``judged`` names the columns of the items
    that it reads, each entry is judged once for items that agree in them, not once an item.
    The cache holds one row per key.
    """
    keys = keys or ["sig_hash"]
    fresh = cache
    if ttl_days is not None:
        fresh = fresh.where(F.col("updated_at") >= F.lit(as_of - timedelta(days=ttl_days)))
    met = F.lit(True) if min_text is None else F.coalesce(min_text, F.lit(False))
    if judged is None:
        joined = items.join(fresh.withColumn("_cached", F.lit(True)), keys, "left")
        return joined.withColumn("hit", F.col("_cached").isNotNull() & met).drop("_cached")
    by = list(dict.fromkeys([*keys, *judged]))
    values = [c for c in cache.columns if c not in keys]
    found = items.select(*by).distinct().join(fresh, keys).select(*[F.col(c).alias(f"_by_{c}") for c in by], *values, met.alias("_met"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    joined = items.join(found, same, "left")
    others = [c for c in items.columns if c not in keys]
    return joined.select(*keys, *others, *values, F.coalesce("_met", F.lit(False)).alias("hit"))


def good_cached_text(text: str, title: str) -> Column:
    """A cached text passes when it is long enough and no product description."""
    raw = strip(F.coalesce(F.col(text), F.lit("")))
    used = bind(raw, lambda t: bind(cleanse(t), lambda c: F.when(c != "", c).otherwise(t)))
    return ~low_quality_text(used, F.col(title))


def cache_misses(items: DataFrame, cache: DataFrame, as_of: datetime, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    fresh = cache.where(F.col("updated_at") >= F.lit(as_of - timedelta(days=ttl_days)))
    return items.join(fresh.select("sig_hash"), "sig_hash", "left_anti")


# --- variants -------------------------------------------------------------------------


def propagate_variants(df: DataFrame, fields: list[str] = vocab.MODEL_FIELDS, parent: str | None = None) -> DataFrame:
    """Copies the values of a variant group's first answered member to later ones without any.

    The representative is the smallest id of the answered members, else of all. Members that
    have a value of their own keep their row, as do those before the representative. Values ride
    along in one aggregation, so a group that holds a third of all rows is combined map-side
    and joined as a single row.
    """
    key = variant_key(F.col("title"), F.col(parent) if parent else None)
    rows = df.withColumn("group_key", key)
    scored = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
    first = F.min_by(F.struct("id", *fields), F.struct(~scored, F.col("id")))
    leaders = rows.groupBy("group_key").agg(first.alias("_lead"))
    kept = scored | (F.col("id") < F.col("_lead.id"))
    joined = rows.join(leaders, "group_key")
    return joined.select(
        "id",
        "group_key",
        F.col("_lead.id").alias("representative"),
        *[F.when(kept, F.col(f)).otherwise(F.col(f"_lead.{f}")).alias(f) for f in fields],
    )


# --- triage, batches and budget -------------------------------------------------------


@dataclass(frozen=True)
class TriageRules:
    rating_below: float = 3.0
    units_below: float = 50.0
    older_than_days: int = 540


def _first_number(*texts: Column) -> Column:
    """First readable number; a percent sign is dropped and a comma is a decimal mark."""

    def number(c: Column) -> Column:
        text = F.trim(c.cast("string"))
        plain = F.replace(F.replace(text, F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
        return F.coalesce(strict_double(text), strict_double(F.trim(plain)))

    return F.coalesce(*[number(t) for t in texts])


def triage(
    df: DataFrame,
    as_of: date,
    rating: list[str],
    units: list[str],
    dates: list[str],
    rules: TriageRules = TriageRules(),
) -> DataFrame:
    """Adds ``low_priority``: badly rated, hardly sold, or old.

    Each list names columns in order of preference; the first readable one decides.
    """
    score = _first_number(*[F.col(c) for c in rating])
    sold = _first_number(*[F.col(c) for c in units])
    age = F.datediff(F.lit(as_of), F.coalesce(*[parse_date(F.col(c).cast("string")) for c in dates]))
    low = (score < rules.rating_below) | (sold < rules.units_below) | (age > rules.older_than_days)
    return df.withColumn("low_priority", F.coalesce(low, F.lit(False)))


def skipped_by_triage(df: DataFrame, exhaustive: bool) -> DataFrame:
    """State and error of items after triage; nothing is skipped in exhaustive mode."""
    skipped = F.col("low_priority") & F.lit(not exhaustive)
    return df.withColumn("state", F.when(skipped, "failed").otherwise("pending_enrich")).withColumn(
        "error", F.when(skipped, "skipped_by_triage")
    )


def batch_size(tokens: float, items: int, default: int = MAX_BATCH, target: int = TARGET_TOKENS) -> int:
    """Items per request so that a request comes near the target size."""
    size = int(target / (tokens / items)) if items and tokens else default
    return max(MIN_BATCH, min(MAX_BATCH, size))


def plan_batches(df: DataFrame, size: int, chars: Column, order: str = "id") -> DataFrame:
    """Consecutive batches of ``size`` items in id order, with items and tokens per batch.

    Positions come from range offsets, never from a window over the whole table.
    """
    rows = df.select(F.col(order).alias("_id"), chars.cast("long").alias("_chars"))
    placed = number_by_unique(rows, "_id", "_place")
    batch = F.floor(F.col("_place") / size).cast("long")
    return placed.groupBy(batch.alias("batch_no")).agg(
        F.count(F.lit(1)).alias("items"),
        F.min("_id").alias("first_id"),
        F.max("_id").alias("last_id"),
        token_estimate(F.sum("_chars")).alias("est_tokens"),
    )


def budget_admission(
    batches: DataFrame,
    max_cost: float = 0.0,
    max_requests: int = 0,
    cost_per_1k: float = 15.0,
    exhaustive: bool = False,
) -> DataFrame:
    """Adds ``admitted`` and the running cost of a queue of batches.

    ``batches`` holds ``queue_no`` (unique, in order), ``low_priority`` and ``est_tokens``.
    High priority goes first, low priority only in exhaustive mode. The queue stops for
    good at the first batch whose cost would pass ``max_cost`` or that finds
    ``max_requests`` used up; 0 means no limit. Running sums are taken inside ranges of the
    queue and shifted by the totals of the earlier ranges.
    """
    rows = batches if exhaustive else batches.where(~F.col("low_priority"))
    cost = F.greatest(F.col("est_tokens"), F.lit(1)) / 1000.0 * cost_per_1k
    rows = rows.withColumn("_cost", cost.cast("decimal(28,12)")).withColumn(
        "_lane", F.col("low_priority").cast("int")
    )
    parts = in_range(rows, F.col("queue_no"), range_borders(rows, F.col("queue_no")))
    slot = ["_lane", "_range"]
    totals = parts.groupBy(*slot).agg(F.sum("_cost").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy().orderBy(*slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # bounded: two lanes times the number of ranges
        *slot,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_spent"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_sent"),
    )
    inside = Window.partitionBy(*slot).orderBy("queue_no").rowsBetween(Window.unboundedPreceding, 0)
    running = parts.join(offsets, slot).withColumn(
        "cumulative_cost", (F.col("_spent") + F.sum("_cost").over(inside)).cast("double")
    ).withColumn("request_no", F.col("_sent") + F.count(F.lit(1)).over(inside))
    # both running values only grow, so the first batch over a limit ends the queue
    fits = (F.col("cumulative_cost") <= (max_cost or inf)) & (F.col("request_no") <= (max_requests or inf))
    return running.withColumn("admitted", fits).drop("_cost", "_lane", "_range", "_spent", "_sent")


# --- results --------------------------------------------------------------------------


def shorten_reason(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    cut = F.concat(rstrip(F.substring(text, 1, REASON_LENGTH - 3)), F.lit("..."))
    return F.when(F.length(text) > REASON_LENGTH, cut).otherwise(text)


def clamp_score(c: Column) -> Column:
    return clamp(F.coalesce(F.trim(c.cast("string")).try_cast("double").cast("long"), F.lit(0)), 0, 100).cast("long")


def apply_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Item states after a run: matched ones enriched, the rest failed as missing."""
    cleaned = results.select(
        F.col("id").alias("item_id"),
        clamp_score(F.col("desire")).alias("desire"),
        clamp_score(F.col("awareness")).alias("awareness"),
        shorten_reason(F.col("reason")).alias("reason"),
        F.lit(True).alias("_got"),
    )
    got = F.col("_got").isNotNull()
    return (
        items.join(cleaned, "item_id", "left")
        .withColumn("state", F.when(got, "enriched").otherwise("failed"))
        .withColumn("error", F.when(~got, "missing_result"))
        .drop("_got")
    )


def store_results(
    products: DataFrame, cache: DataFrame, applied: DataFrame, stamp: Column
) -> tuple[DataFrame, DataFrame]:
    """Products and cache after :func:`apply_results`; matched rows only."""
    good = applied.where(F.col("state") == "enriched")
    per_sig = good.groupBy("sig_hash").agg(
        F.max_by(F.struct("desire", "awareness", "reason"), "item_id").alias("_r")
    ).select("sig_hash", "_r.*")
    ids = products.select("id", "sig_hash").join(per_sig, "sig_hash").drop("sig_hash")
    fresh = per_sig.withColumn("updated_at", stamp)
    return (
        update_columns(products, ids, "coalesce", stamp),
        cache_upsert(cache, fresh, ["sig_hash"], "updated_at"),
    )


def route_by_confidence(df: DataFrame, audit: Column, top: Column, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Adds ``confidence`` (audit value first) and ``accepted``."""
    confidence = F.coalesce(audit, top).cast("double")
    return df.withColumn("confidence", confidence).withColumn(
        "accepted", F.coalesce(confidence >= floor, F.lit(False))
    )


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count_if("accepted").alias("covered"), F.count_if(~F.col("accepted")).alias("fallback")
    )


def advance_state(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Moves items along raw → pending_enrich → enriched / failed; other moves are ignored."""
    new = changes.select("item_id", F.col("state").alias("_to"))
    old, to = F.col("state"), F.col("_to")
    allowed = ((old == "raw") & (to == "pending_enrich")) | (
        (old == "pending_enrich") & to.isin("enriched", "failed")
    )
    return (
        items.join(new, "item_id", "left")
        .withColumn("state", F.when(F.coalesce(allowed, F.lit(False)), to).otherwise(old))
        .drop("_to")
    )
