"""Row selection, partial updates and the canonical product row."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.numbers import half_even, to_double
from merchlens.functions.text import clean_name, none_if_blank

INLINE_IDS = 1000


def select_ids(
    df: DataFrame, ids: list[int] | DataFrame | None, empty_means_all: bool = True, key: str = "id"
) -> DataFrame:
    """Rows whose id is listed; short lists become a pushed filter, long ones and frames a
    semi join. An empty frame selects nothing."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    wanted = sorted(set(ids or []))
    if not wanted:
        return df if empty_means_all else df.where(F.lit(False))
    if len(wanted) <= INLINE_IDS:
        return df.where(F.col(key).isin(wanted))
    listed = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{key} long")
    return df.join(listed, key, "left_semi")


def parse_id_query(text: str | None) -> list[tuple[int, int]]:
    """``"3-5, 9"`` to inclusive ranges; reversed ranges are turned, other text is ignored."""
    ranges = []
    for token in (text or "").split(","):
        found = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", token.strip())
        if found:
            low, high = int(found[1]), int(found[2] or found[1])
            ranges.append((min(low, high), max(low, high)))
    return ranges


Range = tuple[float | None, float | None]
ANY: Range = (None, None)


@dataclass(frozen=True)
class ProductFilter:
    """Criteria that all have to hold; an unset one lets every row pass."""

    ids: list[tuple[int, int]] = field(default_factory=list)
    category: str | None = None
    price: Range = ANY
    rating: Range = ANY
    units_sold: Range = ANY
    revenue: Range = ANY
    conversion_rate: Range = ANY
    winner_score: Range = ANY
    launched: tuple[str | None, str | None] = (None, None)
    range_text: str | None = None
    desire_magnitude: str | None = None
    awareness_level: str | None = None
    competition_level: str | None = None


def _plain_level(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\-]", "")


def filter_products(df: DataFrame, want: ProductFilter, lenient_dates: bool = False) -> DataFrame:
    """Products that meet every criterion.

    Rows without a number fail a range that has a bound. Rows without a launch date fail a
    date bound, unless ``lenient_dates``. Ranges are inclusive.
    """
    tests: list[Column] = []
    if want.ids:
        spans = [F.col("id").between(lo, hi) for lo, hi in want.ids]
        tests.append(reduce(lambda a, b: a | b, spans))
    if want.category:
        tests.append(F.lower("category").contains(want.category.lower()))
    for name in ("price", "rating", "units_sold", "revenue", "conversion_rate", "winner_score"):
        low, high = getattr(want, name)
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
    for bound, fits in zip(want.launched, (Column.__ge__, Column.__le__)):
        if bound:
            inside = fits(F.col("launch_date"), F.lit(bound).cast("date"))
            tests.append(F.col("launch_date").isNull() | inside if lenient_dates else inside)
    if want.range_text:
        tests.append(F.lower("date_range").contains(want.range_text.lower()))
    if want.desire_magnitude:
        tests.append(F.trim("desire_magnitude") == want.desire_magnitude)
    if want.awareness_level:
        level = re.sub(r"[\s-]", "", want.awareness_level.lower())
        tests.append(_plain_level(F.col("awareness_level")) == level)
    if want.competition_level:
        tests.append(F.trim("competition_level") == want.competition_level)
    return reduce(DataFrame.where, tests, df)


def missing_enrichment(df: DataFrame, mode: str = "any", limit: int | None = None) -> DataFrame:
    """Products still to be enriched.

    ``any``: a label is NULL or the desire text empty. ``incomplete``: no completion time,
    newest ids first. ``candidate``: named, and not both completed and fully labelled.
    """
    if mode == "any":
        gaps = [F.col(c).isNull() for c in vocab.MODEL_FIELDS] + [F.col("desire") == ""]
        rows = df.where(reduce(lambda a, b: a | b, gaps))
        return rows.orderBy("id").limit(limit) if limit else rows
    done = F.col("completed_at").isNotNull()
    if mode == "incomplete":
        rows = df.where(~done)
        return rows.orderBy(F.desc("id")).limit(max(1, limit)) if limit is not None else rows
    filled = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in vocab.MODEL_FIELDS])
    named = F.coalesce(F.col("name") != "", F.lit(False))
    return df.where(named & ~(done & filled)).dropDuplicates(["id"])


def list_products(df: DataFrame, by: str = "import_date") -> DataFrame:
    """All rows, newest import first, or by id."""
    return df.orderBy("id") if by == "id" else df.orderBy(F.desc("import_date"), "id")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "amber").otherwise("red")


def update_columns(
    products: DataFrame,
    updates: DataFrame,
    mode: str = "replace",
    stamp: Column | None = None,
    stamp_column: str = "completed_at",
) -> DataFrame:
    """Partial update by id; columns the products lack are ignored.

    Labels outside their domain become NULL. ``replace`` writes what the update row says,
    ``coalesce`` keeps the old value where the new one is NULL. With ``stamp`` matched rows
    also get a completion time.
    """
    domains = {
        "desire_magnitude": vocab.TRI_LEVELS,
        "competition_level": vocab.TRI_LEVELS,
        "awareness_level": vocab.AWARENESS_LABELS,
    }
    changed = [c for c in updates.columns if c != "id" and c in products.columns]
    cleaned = [
        (F.when(F.col(c).isin(domains[c]), F.col(c)) if c in domains else F.col(c)).alias(f"_new_{c}")
        for c in changed
    ]
    new = updates.select("id", F.lit(True).alias("_hit"), *cleaned)
    joined = products.join(new, "id", "left")
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if c == stamp_column and stamp is not None:
            return F.when(hit, stamp).otherwise(F.col(c)).alias(c)
        if c not in changed:
            return F.col(c)
        fresh = F.col(f"_new_{c}")
        if mode == "coalesce":
            return F.coalesce(fresh, F.col(c)).alias(c)
        return F.when(hit, fresh).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in products.columns])


def delete_products(
    doomed: DataFrame, products: DataFrame, scores: DataFrame, list_items: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the ``doomed`` ids."""
    gone = doomed.select("id").distinct()
    as_product = gone.withColumnRenamed("id", "product_id")
    return (
        products.join(gone, "id", "left_anti"),
        scores.join(as_product, "product_id", "left_anti"),
        list_items.join(as_product, "product_id", "left_anti"),
    )


# --- canonical output row -------------------------------------------------------------


def with_display_extras(extra: Column) -> Column:
    """Extras plus the display spelling of every recognised key that lacks one."""
    spelled = F.map_concat(
        *[
            F.when(
                F.map_contains_key(extra, k) & ~F.map_contains_key(extra, display),
                F.create_map(F.lit(display), F.try_element_at(extra, F.lit(k))),
            ).otherwise(F.create_map().cast("map<string,string>"))
            for k, display in vocab.EXTRA_DISPLAY_KEYS.items()
        ]
    )
    return F.map_concat(extra, spelled)


def from_row_or_extra(df: DataFrame, extra: Column, keys: list[str]) -> Column:
    """First non-empty value by key order: column, exact extra key, extra key by any case."""

    def by_any_case(key: str) -> Column:
        same = F.filter(
            F.map_entries(extra), lambda e: (F.lower(e["key"]) == key.lower()) & (e["value"] != "")
        )
        return F.get(same, 0)["value"]

    found = []
    for key in keys:
        if key in df.columns:
            found.append(none_if_blank(F.col(key).cast("string")))
        found.append(none_if_blank(F.try_element_at(extra, F.lit(key))))
        found.append(by_any_case(key))
    return F.coalesce(*found)


def serve_products(df: DataFrame) -> DataFrame:
    """One display row per product: fall-back chains over columns, extras and synonyms."""
    extra = with_display_extras(F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>")))
    rows = df.withColumn("_extra", extra)
    extra = F.col("_extra")
    first = from_row_or_extra(rows, extra, vocab.FIRST_SEEN_KEYS)
    last = from_row_or_extra(rows, extra, vocab.LAST_SEEN_KEYS)
    given = from_row_or_extra(rows, extra, vocab.DATE_RANGE_KEYS)
    spanned = F.nullif(F.concat_ws("—", F.substring(first, 1, 10), F.substring(last, 1, 10)), F.lit(""))

    def label(*names: str) -> Column:
        return F.coalesce(*[none_if_blank(F.col(n)) for n in names if n in rows.columns])

    return rows.select(
        "id",
        clean_name(F.col("name")).alias("name"),
        "category",
        "price",
        half_even(to_double(F.col("price")), 2).alias("price_display"),
        none_if_blank(F.col("desire")).alias("desire"),
        "desire_magnitude",
        label("awareness_level", "ai_awareness_level", "awareness").alias("awareness_level"),
        label("competition_level", "ai_competition_level", "competition").alias("competition_level"),
        F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("winner_score", "ai_winner_score", "score") if c in rows.columns]).alias("winner_score"),
        *[F.try_element_at(extra, F.lit(k)).alias(k) for k in vocab.EXTRA_DISPLAY_KEYS],
        first.alias("first_seen"),
        last.alias("last_seen"),
        F.coalesce(given, spanned).alias("date_range"),
        extra.alias("extras"),
    )
