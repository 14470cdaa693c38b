"""Checks and normalisation of model responses, as Spark jobs over a table of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.numbers import strict_double
from merchlens.functions.text import awareness_label, bind, cleanse, strip, title_case


def parse_lines(responses: DataFrame, line: str = "line") -> DataFrame:
    """Non-blank lines with ``ok`` (a JSON object) and its fields as a string map."""
    text = strip(F.col(line))
    rows = responses.where(text != "")
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    # an unreadable line gives NULL or an empty map; only "{}" is a readable empty object
    readable = text.startswith("{") & F.try_parse_json(text).isNotNull()
    return rows.withColumn("fields", F.when(readable, parsed)).withColumn("ok", readable)


def _has(key: str) -> Column:
    return F.coalesce(F.map_contains_key("fields", key), F.lit(False))


def _product_id() -> Column:
    """``product_id`` as an integer, however it is written."""
    return F.try_element_at("fields", F.lit("product_id")).try_cast("long")


def validate_responses(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """One verdict per batch: valid, or the first rule it breaks.

    Rules in order: number of lines, readable JSON, product_id present, no duplicates, the
    required fields, the same set of ids; a quoted or fractional id is none of them. ``responses`` holds ``batch_id, line``;
    ``expected`` holds ``batch_id, product_id``. Duplicates and set differences come from
    one row per (batch, id), so a large batch is never gathered in one place.
    """
    given = F.try_variant_get(F.try_parse_json(F.trim("line")), "$.product_id", "variant")
    lines = parse_lines(responses).withColumn("product_id", F.when(F.schema_of_variant(given) == "BIGINT", _product_id()))
    complete = reduce(lambda a, b: a & b, [_has(f) for f in vocab.MODEL_FIELDS])
    per_batch = lines.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.col("ok")).alias("bad_json"),
        F.count_if(F.col("ok") & ~_has("product_id")).alias("no_id"),
        F.count_if(F.col("ok") & ~complete).alias("incomplete"),
    )
    got = lines.where(F.col("product_id").isNotNull()).groupBy("batch_id", "product_id").agg(
        F.count(F.lit(1)).alias("times")
    )
    wanted = expected.select("batch_id", "product_id", F.lit(1).alias("want"))
    sides = wanted.join(got, ["batch_id", "product_id"], "full_outer")
    sets = sides.groupBy("batch_id").agg(
        F.count("want").alias("expected"),
        F.count_if(F.col("times") > 1).alias("duplicated"),
        F.count_if(F.col("times").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("extra"),
    )
    rows = sets.join(per_batch, "batch_id", "full_outer").na.fill(0)
    reason = (
        F.when(F.col("lines") != F.col("expected"), "length")
        .when(F.col("bad_json") > 0, "invalid_json")
        .when(F.col("no_id") > 0, "missing_product_id")
        .when(F.col("duplicated") > 0, "duplicate_product_id")
        .when(F.col("incomplete") > 0, "missing_field")
        .when((F.col("missing") > 0) | (F.col("extra") > 0), "id_set")
    )
    return rows.select(
        "batch_id", "expected", "lines", "missing", "extra", reason.isNull().alias("valid"), reason.alias("reason")
    )


def readable_responses(responses: DataFrame, sequence: str) -> DataFrame:
    """Lenient mode: unreadable lines are skipped, the last line of an id wins."""
    lines = parse_lines(responses).where("ok").withColumn("product_id", _product_id())
    known = lines.where(F.col("product_id").isNotNull())
    last = F.max_by("fields", sequence).alias("fields")
    return known.groupBy("batch_id", "product_id").agg(last)


def missing_responses(responses: DataFrame, expected: DataFrame, sequence: str) -> DataFrame:
    """Expected ids without a readable line."""
    return expected.join(readable_responses(responses, sequence), ["batch_id", "product_id"], "left_anti")


def level_from_percent(c: Column) -> Column:
    return F.when(c <= 33, "Low").when(c >= 67, "High").when(c.isNotNull(), "Medium")


def awareness_from_bucket(bucket: Column, percent: Column) -> Column:
    """Awareness label of a coarse level, refined by its percentage at the ends."""
    return (
        F.when(bucket == "Low", F.when(percent <= 10, "Unaware").otherwise("Problem-Aware"))
        .when(bucket == "Medium", "Solution-Aware")
        .when(bucket == "High", F.when(percent >= 90, "Most Aware").otherwise("Product-Aware"))
        .otherwise(awareness_label(bucket))
    )


def normalise_responses(df: DataFrame, require_confidence: bool = False) -> DataFrame:
    """Labels from raw answers ``aw, aw_m, d, d_m, c, c_m, confidence`` (all text).

    ``error`` names the first rule a row breaks; its labels are then NULL.
    """

    def percent(name: str) -> Column:
        return strict_double(F.trim(F.col(name)))

    def outside(c: Column, high: float) -> Column:
        return c.isNull() | ~c.between(0, high)

    aw_label, c_label = title_case(F.trim(F.col("aw"))), title_case(F.trim(F.col("c")))
    confidence = strict_double(F.trim(F.col("confidence")))
    bad_confidence = F.col("confidence").isNotNull() & outside(confidence, 1)
    if require_confidence:
        bad_confidence = bad_confidence | F.col("confidence").isNull()
    error = F.coalesce(
        *[F.when(outside(percent(m), 100), m) for m in ("aw_m", "d_m", "c_m")],
        F.when(bad_confidence, "confidence"),
        F.when(F.col("aw").isNull() | ~aw_label.isin(vocab.TRI_LEVELS), "aw"),
        F.when(F.col("c").isNull() | ~c_label.isin(vocab.TRI_LEVELS), "c"),
    )
    text = bind(
        F.coalesce(F.col("d"), F.lit("")),
        lambda d: bind(cleanse(d), lambda c: F.when(c != "", c).otherwise(strip(d))),
    )
    fine = F.col("error").isNull()
    return df.withColumn("error", error).select(
        *df.columns,
        "error",
        F.when(fine, text).alias("desire"),
        F.when(fine, level_from_percent(percent("d_m"))).alias("desire_magnitude"),
        F.when(fine, awareness_from_bucket(aw_label, percent("aw_m"))).alias("awareness_level"),
        F.when(fine, level_from_percent(percent("c_m"))).alias("competition_level"),
    )
