"""Weights from data: metric profiles, correlation, inverse means, samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.numbers import as_int, clamp, ratio, to_double
from merchlens.operators.histogram import value_bin
from merchlens.operators.latest import latest_per
from merchlens.operators.ranks import exact_quantiles
from merchlens.session import cut_lineage

LOW_COVERAGE, LOW_COVERAGE_CAP = 0.35, 15.0
COMPETITION_HIGH = 0.7
SAMPLE_LIMIT = 50
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def profile_metrics(df: DataFrame, metrics: list[str], segments: list[str] | None = None) -> DataFrame:
    """Per segment and metric: min, max, mean, std, quartiles, coverage.

    One pass counts every metric's values in a histogram whose bins also carry mean and squared
    deviations; all moments add up from these bins. A second pass settles the quartiles.
    """
    segments = segments or []
    numbers = df.select(*segments, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = numbers.unpivot(segments, metrics, "metric", "value")
    keys = [*segments, "metric"]
    bins = cut_lineage(
        long.groupBy(*keys, value_bin(F.col("value")).alias("bin")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.avg("value").alias("centre"), (F.var_pop("value") * F.count("value")).alias("spread"),
        )
    )
    known = bins.where(F.col("bin").isNotNull())
    weighed = F.sum(F.col("centre") * F.col("cnt")) / F.sum(F.when(F.col("bin").isNotNull(), F.col("cnt")))
    totals = bins.groupBy(*keys).agg(
        F.min("low").alias("min"), F.max("high").alias("max"), weighed.alias("mean"),
        F.sum("cnt").alias("_n"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("cnt"))), F.lit(0)).alias("_known"),
    )
    beside = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    off = known.alias("b").join(totals.alias("t"), reduce(and_, beside)).groupBy(*[F.col(f"t.{k}").alias(k) for k in keys]).agg(
        F.sum(F.col("b.spread") + F.col("b.cnt") * F.pow(F.col("b.centre") - F.col("t.mean"), 2)).alias("_off")
    )
    quartiles = exact_quantiles(long, "value", QUARTILES, keys, known=known.select(*keys, "bin", "cnt", "low", "high")).drop("n")
    moments = totals
    for facts in (off, quartiles):
        other = facts.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        moments = moments.join(other, reduce(and_, same), "left").drop(*[f"_{k}" for k in keys])
    deviation = F.when(F.col("_known") > 1, F.sqrt(F.col("_off") / (F.col("_known") - 1)))
    return moments.select(
        *keys, "min", "max", "mean", deviation.alias("std"), *QUARTILES, (F.col("_known") / F.col("_n")).alias("coverage")
    )


def _position() -> Column:
    """Where the middle of the distribution lies between minimum and maximum."""
    low, high = F.col("min"), F.col("max")
    centre = F.coalesce("p50", "mean", low + (high - low) / 2)
    return F.when(high > low, clamp((centre - low) / (high - low)))


def _spread() -> Column:
    width = F.col("max") - F.col("min")
    wide = width > 0
    between = F.when(wide & (F.col("p75") >= F.col("p25")), clamp((F.col("p75") - F.col("p25")) / (width + 1e-9)))
    deviation = F.when(wide, clamp(F.abs("std") / (width + 1e-9)))
    return F.coalesce(between, deviation, F.lit(0.5))


def weights_from_profile(profile: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """An integer weight 0–100 and notes for all eight metrics (of every segment).

    Strength rises with a distribution that leans the preferred way and is spread out; low
    coverage shrinks and finally caps the weight. A metric without a row weighs nothing.
    """
    segments = segments or []
    metric, pos = F.col("metric"), F.col("_pos")
    base = _choose(metric, vocab.PROFILE_BASE_WEIGHTS)
    preference = _choose(metric, vocab.PROFILE_PREFERENCE)
    lean = (
        F.when(pos.isNull(), 0.5)
        .when(preference == "high", pos)
        .when(preference == "low", 1.0 - pos)
        .otherwise(1.0 - F.abs(pos - 0.5) * 2.0)
    )
    strength = clamp(0.65 * clamp(lean) + 0.35 * (0.3 + 0.7 * F.col("_spread")))
    coverage = clamp(F.coalesce("coverage", F.lit(0.0)))
    shape = (
        F.when(pos.isNull(), 1.0)
        .when(metric == "competition", 0.5 + 0.5 * (1.0 - pos))
        .when(metric == "oldness", 0.8 + 0.4 * (1.0 - pos))
        .when(metric == "price", clamp(1.0 - F.abs(pos - 0.4) * 1.6, 0.3, 1.15))
        .when(metric == "awareness", clamp(1.0 - F.abs(pos - 0.55) * 1.2, 0.35, 1.1))
        .otherwise(1.0)
    )
    weight = base * (0.6 + 0.8 * strength) * (0.1 + 0.9 * coverage) * shape
    scarce = coverage < LOW_COVERAGE
    capped = clamp(F.when(scarce, F.least(weight, F.lit(LOW_COVERAGE_CAP))).otherwise(weight), 0.0, 100.0)
    crowded = F.when((metric == "competition") & (pos >= COMPETITION_HIGH), F.lit(vocab.NOTE_CROWDED))
    thin = F.when(scarce, F.format_string(vocab.NOTE_LOW_COVERAGE, metric, coverage))
    known = F.col("_known").isNotNull()
    absent = F.array(F.format_string(vocab.NOTE_NO_DATA, metric))
    if not segments:
        nothing = profile.where(metric.isin(vocab.SCORE_FIELDS)).agg(F.count(F.lit(1)) == 0).scalar()
        absent = F.when(nothing, F.array(F.lit(vocab.NOTE_NO_PROFILE))).otherwise(absent)
    return (
        _all_metrics(profile, segments)
        .withColumn("_pos", _position())
        .withColumn("_spread", _spread())
        .select(
            *segments,
            "metric",
            F.when(known, as_int(capped)).otherwise(0).cast("long").alias("weight"),
            F.when(known, F.array_compact(F.array(crowded, thin))).otherwise(absent).alias("notes"),
        )
    )


def _all_metrics(profile: DataFrame, segments: list[str]) -> DataFrame:
    """Eight rows per segment, with the profile's figures where it has them."""
    every = F.explode(F.split(F.lit(",".join(vocab.SCORE_FIELDS)), ",")).alias("metric")
    frame = profile.select(*segments).distinct() if segments else profile.sparkSession.range(1)
    return frame.select(*segments, every).join(
        profile.withColumn("_known", F.lit(True)), [*segments, "metric"], "left"
    )


def _choose(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def weight_order(weights: DataFrame) -> DataFrame:
    """Positive weights, largest first, ties in field order."""
    place = F.array_position(F.array(*[F.lit(f) for f in vocab.SCORE_FIELDS]), F.col("metric"))
    return weights.where(F.col("weight") > 0).orderBy(F.desc("weight"), place)


def weights_by_correlation(
    df: DataFrame, features: list[str], target: str, no_signal: str = "flat"
) -> DataFrame:
    """|Pearson correlation| with the target, rescaled so that the largest is 100.

    A constant feature has no correlation. Without any signal the result is 50 everywhere
    (``flat``) or a fixed profile (``profile``). All correlations come from one aggregation.
    """

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    goal = number(target)
    found = df.agg(
        *[
            ratio(F.abs(F.covar_pop(number(f), goal)), F.stddev_pop(number(f)) * F.stddev_pop(goal)).alias(f)
            for f in features
        ]
    )
    best = F.array_max(F.array(*features))
    rows = found.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation"), best.alias("best"))
                    for f in features
                ]
            )
        )
    )
    silent = F.lit(50) if no_signal == "flat" else F.coalesce(_choose(F.col("feature"), vocab.CORRELATION_FALLBACK_PROFILE), F.lit(50))
    scaled = F.when(F.col("best") > 0, F.col("correlation") / F.col("best") * 100).otherwise(silent)
    return rows.select("feature", "correlation", as_int(scaled).alias("weight"))


def weights_inverse_mean(scores: DataFrame) -> DataFrame:
    """Sub-scores that are low on average get more weight; the six weights sum to six.

    ``scores`` are score rows; only the newest of each product counts.
    """
    latest = latest_per(scores, "product_id", ["created_at", "id"])
    means = latest.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.coalesce(to_double(F.col(m)), F.lit(0.0))).alias(m) for m in vocab.SUB_SCORES],
    )
    inverse = [(1.0 / (F.col(m) + 1e-6)).alias(m) for m in vocab.SUB_SCORES]
    total = sum((F.col(m) for m in vocab.SUB_SCORES), F.lit(0.0))
    weights = means.select("n", *inverse).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.when(F.col("n") == 0, 1.0)
                        .otherwise(F.col(m) * float(len(vocab.SUB_SCORES)) / total)
                        .alias("weight"),
                    )
                    for m in vocab.SUB_SCORES
                ]
            )
        )
    )
    return weights


def success_metric(products: DataFrame) -> str | None:
    """The first success metric that the first product with any readable one carries."""
    readable = [
        F.when(to_double(F.try_element_at("extra", F.lit(k))).isNotNull(), F.lit(k))
        for k in vocab.SUCCESS_METRICS
    ]
    row = (
        products.select("id", F.coalesce(*readable).alias("key"))
        .where(F.col("key").isNotNull())
        .agg(F.min_by("key", "id").alias("key"))
        .first()
    )
    return row["key"]


def weight_samples(products: DataFrame, scores: DataFrame, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Products with a success value and a complete rubric breakdown, first ``limit`` by id.

    The success key of the first product sticks; a product without it falls back to the
    first readable success key. ``scores.breakdown`` is a map of rubric marks.
    """
    sticky = success_metric(products)
    keys = [k for k in [sticky, *vocab.SUCCESS_METRICS] if k]
    value = F.coalesce(*[to_double(F.try_element_at("extra", F.lit(k))) for k in dict.fromkeys(keys)]) if keys else F.lit(None).cast("double")
    latest = latest_per(scores, "product_id", ["created_at", "id"])
    marks = [F.try_element_at("breakdown", F.lit(f)).cast("double").alias(f) for f in vocab.RUBRIC_FIELDS]
    rows = products.select("id", value.alias("success")).join(
        latest.select(F.col("product_id").alias("id"), *marks), "id"
    )
    complete = rows.where(F.col("success").isNotNull())
    for f in vocab.RUBRIC_FIELDS:
        complete = complete.where(F.col(f).isNotNull())
    return complete.orderBy("id").limit(limit)
