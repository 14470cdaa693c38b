"""Category and period summaries with a comparison to the preceding period.

Input rows carry ``id, category, price, units, revenue, rating, import_date``; ``revenue``
may be NULL and is then price x units.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions.numbers import (
    exact_sum, money_sum, outlier_sum, ratio, to_double, with_outliers,
)

PERCENT = 100.0


def filter_period(
    df: DataFrame,
    start: datetime,
    end: datetime,
    category_prefix: str | None = None,
    date_col: str = "import_date",
) -> DataFrame:
    """Rows with ``start <= date < end``, optionally of categories like ``prefix%``."""
    rows = df.where((F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end)))
    if category_prefix:
        rows = rows.where(F.col("category").ilike(category_prefix + "%"))
    return rows


def trend_rows(products: DataFrame) -> DataFrame:
    """Products with a JSON-like ``extra`` map as trend rows; unreadable units count as 0."""
    extra = F.col("extra")
    units = to_double(F.try_element_at(extra, F.lit("units_sold")))
    return products.select(
        "id",
        "category",
        F.col("price").cast("double").alias("price"),
        F.coalesce(units, F.lit(0.0)).alias("units"),
        to_double(F.try_element_at(extra, F.lit("revenue"))).alias("revenue"),
        to_double(F.try_element_at(extra, F.lit("rating"))).alias("rating"),
        F.col("import_date").cast("timestamp").alias("import_date"),
        (units.isNull() & F.try_element_at(extra, F.lit("units_sold")).isNotNull()).alias("bad_units"),
    )


def _measured(
    rows: DataFrame, start: datetime, end: datetime, prefix: str | None, compare_all: bool
) -> tuple[DataFrame, Column]:
    """Both periods in one scan, with the flag that marks the current one."""
    previous = start - (end - start)
    current = F.col("import_date") >= F.lit(start)
    if compare_all and prefix:
        both = filter_period(rows, previous, end)
        both = both.where(~current | F.col("category").ilike(prefix + "%"))
    else:
        both = filter_period(rows, previous, end, prefix)
    money = F.coalesce(F.col("revenue"), F.col("price") * F.col("units"), F.lit(0.0))
    both = both.withColumn("category", F.coalesce(F.col("category"), F.lit("")))
    return both.withColumn("_units", F.coalesce(F.col("units"), F.lit(0.0))).withColumn("_money", money), current


def _measures(current: Column) -> list[Column]:
    def now(c: Column) -> Column:
        return F.when(current, c)

    def before(c: Column) -> Column:
        return F.when(~current, c)

    sums = {
        "revenue": now(F.col("_money")),
        "prev_revenue": before(F.col("_money")),
        "price_sum": now(F.col("price")),
        "rating_sum": now(F.col("rating")),
    }
    return [
        F.countDistinct(now(F.col("id"))).alias("unique_products"),
        F.sum(now(F.col("_units"))).alias("units"),
        F.coalesce(F.sum(before(F.col("_units"))), F.lit(0.0)).alias("prev_units"),
        F.count(now(F.col("price"))).alias("price_count"),
        F.count(now(F.col("rating"))).alias("rating_count"),
        F.count_if(current).alias("rows"),
        *[exact_sum(c).alias(n) for n, c in sums.items()],
        *[outlier_sum(c).alias(f"{n}_outliers") for n, c in sums.items()],
    ]


EXACT = ["revenue", "prev_revenue", "price_sum", "rating_sum"]
OUTLIERS = [f"{c}_outliers" for c in EXACT]


def _as_doubles(df: DataFrame) -> DataFrame:
    """Both parts of the exact sums as one double, absent ones as 0."""
    joined = {c: with_outliers(F.col(c), F.col(o)) for c, o in zip(EXACT, OUTLIERS)}
    return df.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in joined.items()})


def _change(now: str, before: str) -> Column:
    return ratio((F.col(now) - F.col(before)) * PERCENT, F.col(before))


def _averages() -> list[Column]:
    return [
        ratio(F.col("price_sum"), F.col("price_count")).alias("avg_price"),
        ratio(F.col("rating_sum"), F.col("rating_count")).alias("avg_rating"),
        ratio(F.col("revenue"), F.col("units")).alias("rev_per_unit"),
        _change("revenue", "prev_revenue").alias("delta_revenue_pct"),
    ]


def trends_by_category(
    rows: DataFrame,
    start: datetime,
    end: datetime,
    category_prefix: str | None = None,
    compat_prev_unfiltered: bool = False,
) -> DataFrame:
    """Per category of the period: products, units, revenue, averages, change in revenue.

    ``compat_prev_unfiltered`` leaves the category filter off the preceding period.
    """
    both, current = _measured(rows, start, end, category_prefix, compat_prev_unfiltered)
    grouped = both.groupBy("category").agg(*_measures(current)).where(F.col("rows") > 0)
    return (
        _as_doubles(grouped)
        .select("category", "unique_products", "units", "revenue", *_averages())
        .orderBy(F.desc("revenue"), "category")
    )


def trends_totals(
    rows: DataFrame,
    start: datetime,
    end: datetime,
    category_prefix: str | None = None,
    compat_prev_unfiltered: bool = False,
) -> DataFrame:
    """The same measures over all categories; a product counts once per category."""
    both, current = _measured(rows, start, end, category_prefix, compat_prev_unfiltered)
    counted = ["unique_products", "units", "prev_units", "price_count", "rating_count"]
    totals = (
        both.groupBy("category")
        .agg(*_measures(current))
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted],
            *[F.sum(c).alias(c) for c in EXACT + OUTLIERS],
        )
    )
    return _as_doubles(totals).select(
        "unique_products", "units", "revenue", *_averages(),
        _change("units", "prev_units").alias("delta_units_pct"),
    )


def trends_overview(
    rows: DataFrame,
    start: datetime,
    end: datetime,
    category_prefix: str | None = None,
    compat_prev_unfiltered: bool = False,
) -> DataFrame:
    """Categories and totals of a period from one scan: ``is_total`` marks the row over all categories.

    The rows are those of :func:`trends_by_category` and :func:`trends_totals`, both with the
    change in units. Sums per category are what the total's grouping set adds up. Periods without rows
    have no total either.
    """
    both, current = _measured(rows, start, end, category_prefix, compat_prev_unfiltered)
    counted = ["unique_products", "units", "prev_units", "price_count", "rating_count", "rows"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted] + [F.sum(c).alias(c) for c in EXACT + OUTLIERS]
    per_category = both.groupBy("category").agg(*_measures(current))
    levels = per_category.groupingSets([[F.col("category")], []], F.col("category")).agg((F.grouping("category") == 1).alias("is_total"), *sums)
    return _as_doubles(levels.where("is_total OR rows > 0")).select(
        "is_total", "category", "unique_products", "units", "revenue", *_averages(),
        _change("units", "prev_units").alias("delta_units_pct"),
    )


def granularity(start: datetime, end: datetime) -> str:
    return "day" if end - start <= timedelta(days=31) else "week"


def trends_timeseries(
    rows: DataFrame, start: datetime, end: datetime, category_prefix: str | None = None
) -> DataFrame:
    """Units and revenue per day, or per Monday-based week for periods above 31 days."""
    period = filter_period(rows, start, end, category_prefix)
    bucket = F.date_trunc(granularity(start, end), "import_date").cast("date")
    money = F.coalesce(F.col("revenue"), F.col("price") * F.col("units"), F.lit(0.0))
    return (
        period.groupBy(bucket.alias("date"))
        .agg(
            F.sum(F.coalesce(F.col("units"), F.lit(0.0))).alias("units"),
            money_sum(money).alias("revenue"),
        )
        .orderBy("date")
    )
