"""Catalogue analytics: summaries, keywords, brands, scatter points, Pareto, insights.

Input products carry ``id, name, category, price, units_sold, revenue, rating``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.functions import vocab
from merchlens.functions.numbers import money_sum, parse_amount, ratio, to_double
from merchlens.functions.text import clean_name, title_case
from merchlens.operators.ranks import exact_quantiles

TOP = 10
PARETO_TOP = 15
INSIGHT_TOP = 3
RATING_FLOOR = 4.6
SLOTS = 1 << 16  # counts that stand for all values that are not counted by themselves
GUESS_ROWS = 256  # rows whose most frequent values are counted by themselves; results do not depend on them
GUESSES = 20  # such values for each wanted one


def _category() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("category"), F.lit(""))))


def launched_between(df: DataFrame, start: str | None, end: str | None, launch: Column) -> DataFrame:
    """Optional launch window, inclusive; rows without a launch date fail a set bound."""
    if start:
        df = df.where(launch >= F.lit(start).cast("date"))
    if end:
        df = df.where(launch <= F.lit(end).cast("date"))
    return df


def category_summary(df: DataFrame) -> DataFrame:
    """Per lower-cased category: count, totals and averages (totals over all its products)."""
    named = df.withColumn("category", _category()).where(F.col("category") != "")
    sums = named.groupBy("category").agg(
        F.count(F.lit(1)).alias("products"),
        F.coalesce(money_sum(F.col("revenue")), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("units_sold"), F.lit(0.0)).alias("total_units"),
        money_sum(F.col("price")).alias("price_sum"),
        F.count("price").alias("price_count"),
        money_sum(F.col("rating")).alias("rating_sum"),
        F.count("rating").alias("rating_count"),
    )
    return sums.select(
        title_case(F.col("category")).alias("category"),
        "products",
        "total_revenue",
        "total_units",
        (F.col("total_revenue") / F.col("products")).alias("avg_revenue"),
        (F.col("total_units") / F.col("products")).alias("avg_units"),
        ratio(F.col("price_sum"), F.col("price_count")).alias("avg_price"),
        ratio(F.col("rating_sum"), F.col("rating_count")).alias("avg_rating"),
    )


def _first_growth(*words: list[str]) -> Column:
    """First readable number under a key that holds one of each word group."""

    def wanted(key: Column) -> Column:
        low = F.lower(key)
        hits = [reduce(lambda a, b: a | b, [low.contains(w) for w in group]) for group in words]
        return reduce(lambda a, b: a & b, hits)

    hits = F.filter(F.map_entries("extra"), lambda e: wanted(e["key"]))
    numbers = F.filter(F.transform(hits, lambda e: parse_amount(e["value"])), lambda n: n.isNotNull())
    return F.get(numbers, 0)


def growth_by_category(df: DataFrame, measure: str = "revenue", top: int = TOP) -> DataFrame:
    """Sum of the growth column found by name in ``extra`` (``revenue`` or ``units``)."""
    words = {"revenue": [["revenue"], ["growth"]], "units": [["item", "unit"], ["growth"]]}[measure]
    return (
        df.select(_category().alias("category"), _first_growth(*words).alias("growth"))
        .where((F.col("category") != "") & F.col("growth").isNotNull())
        .groupBy("category")
        .agg(money_sum(F.col("growth")).alias("growth"))
        .orderBy(F.desc("growth"), "category")
        .limit(top)
    )


def revenue_per_unit(df: DataFrame, top: int = TOP) -> DataFrame:
    return (
        df.where(F.col("revenue").isNotNull() | F.col("units_sold").isNotNull())
        .groupBy(_category().alias("category"))
        .agg(money_sum(F.col("revenue")).alias("revenue"), F.sum("units_sold").alias("units"))
        .where((F.col("category") != "") & (F.col("units") != 0) & F.col("revenue").isNotNull())
        .select("category", (F.col("revenue") / F.col("units")).alias("rev_per_unit"))
        .orderBy(F.desc("rev_per_unit"), "category")
        .limit(top)
    )


def _kept_words(df: DataFrame, word: Column, name: str) -> DataFrame:
    """One row per word of three letters or more that is no stop word."""
    return df.select(word.alias(name)).where((F.length(name) >= 3) & ~F.col(name).isin(*vocab.KEYWORD_STOP_WORDS))


def _keywords(df: DataFrame, text: str) -> DataFrame:
    """Flame marks at a name's end are no letters and need no cleaning."""
    return _kept_words(df, F.explode(F.split(F.lower(F.col(text)), f"[^{vocab.KEYWORD_LETTERS}]+")), "keyword")


def keyword_counts(df: DataFrame, text: str = "name") -> DataFrame:
    """Words of three letters or more that are no stop words, with their counts."""
    return _keywords(df, text).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))


def most_frequent(df: DataFrame, values: Callable[[DataFrame], DataFrame], top: int, slots: int = SLOTS, guess_rows: int = GUESS_ROWS) -> DataFrame:
    """The ``top`` most frequent of the ``values`` of ``df``, with their exact ``count``; ties go by value.

    ``values`` gives a table of one column; NULL is left out. One scan counts the most frequent values
    of the first ``guess_rows`` rows one by one, and all others by the slot that they hash to, so that
    a task sends at most ``slots`` rows and these few. A slot counts at least as often as any value in
    it: if none reaches the last of the answer it stands, whatever the guess was. Otherwise a second
    scan counts the values of the slots that do.
    """
    found = values(df)
    name = found.columns[0]
    found = found.where(F.col(name).isNotNull())
    order = [F.desc("count"), name]
    one_by_one = lambda rows: rows.groupBy(name).agg(F.count(F.lit(1)).alias("count"))
    first = one_by_one(values(df.limit(guess_rows)).where(F.col(name).isNotNull()))
    likely = [r[name] for r in first.orderBy(*order).limit(GUESSES * top).collect()]
    listed, slot = F.col(name).isin(likely), F.pmod(F.xxhash64(name), F.lit(slots))
    keys = [F.when(listed, F.col(name)).alias(name), F.when(~listed, slot).alias("_slot")]
    counted = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).collect()  # len(likely) + slots at most
    known = [(r[name], r["count"]) for r in counted if r["_slot"] is None]
    schema = first.schema
    spark = df.sparkSession
    last = sorted((n for _, n in known), reverse=True)[top - 1] if 0 < top <= len(known) else 0
    full = [(r["_slot"],) for r in counted if r["_slot"] is not None and r["count"] >= last]
    answer = spark.createDataFrame(known, schema)
    if full and top:
        inside = found.where(~listed).withColumn("_slot", slot).join(F.broadcast(spark.createDataFrame(full, "_slot long")), "_slot", "left_semi")
        answer = answer.unionByName(one_by_one(inside))
    return answer.orderBy(*order).limit(top)


def top_keywords(df: DataFrame, text: str = "name", top: int = TOP) -> DataFrame:
    return most_frequent(df, lambda rows: _keywords(rows, text), top)


def top_brands(df: DataFrame, top: int = TOP) -> DataFrame:
    """First word of the name as brand, counted, in title case."""
    first = F.lower(F.get(F.split(clean_name(F.col("name")), "[^A-Za-z0-9]+"), 0))
    return most_frequent(df, lambda rows: _kept_words(rows, first, "brand"), top).select(F.initcap("brand").alias("brand"), "count")


def kpis(df: DataFrame) -> DataFrame:
    """One row: totals, average price, best category and best product by revenue."""
    best = F.struct(F.col("revenue"), -F.col("id"))
    per_category = df.groupBy(_category().alias("category")).agg(
        money_sum(F.col("revenue")).alias("revenue"),
        F.sum("units_sold").alias("units"),
        money_sum(F.col("price")).alias("price_sum"),
        F.count("price").alias("price_count"),
        F.max(F.when(F.col("revenue") > 0, best)).alias("best"),
        F.max_by("name", F.when(F.col("revenue") > 0, best)).alias("best_name"),
    )
    named = F.when((F.col("category") != "") & F.col("revenue").isNotNull(), F.col("revenue"))
    return per_category.agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("total_units"),
        ratio(F.sum("price_sum"), F.sum("price_count")).alias("avg_price"),
        title_case(F.max_by("category", named)).alias("top_category"),
        clean_name(F.max_by("best_name", F.col("best"))).alias("top_product"),
    )


def scatter_points(df: DataFrame, kind: str = "rating") -> DataFrame:
    """Points of complete rows: (rating, revenue, units) or (price, revenue)."""
    needed = ["rating", "revenue", "units_sold"] if kind == "rating" else ["price", "revenue"]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    radius = [F.col("units_sold").alias("r")] if kind == "rating" else []
    return df.where(complete).select(
        "id", clean_name(F.col("name")).alias("label"), F.col(needed[0]).alias("x"),
        F.col("revenue").alias("y"), *radius,
    )


def category_rollup_view(df: DataFrame) -> DataFrame:
    """Category averages over all products: a missing price or rating counts as 0."""

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    return (
        df.groupBy(F.coalesce(F.col("category"), F.lit("Sin categoría")).alias("path"))
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.sum(zero("units_sold")).alias("units"),
            money_sum(zero("revenue")).alias("revenue"),
            money_sum(zero("price")).alias("_price"),
            money_sum(zero("rating")).alias("_rating"),
        )
        .select(
            "path", "products", "units", "revenue",
            (F.col("_price") / F.col("products")).alias("price"),
            (F.col("_rating") / F.col("products")).alias("rating"),
        )
    )


def top_categories(rollup: DataFrame, top: int = TOP, path: str = "path") -> DataFrame:
    return rollup.where(F.col("revenue") > 0).orderBy(F.desc("revenue"), path).limit(top)


def pareto(rollup: DataFrame, top: int = PARETO_TOP, path: str = "path") -> DataFrame:
    """The ``top`` rows by revenue with their running share of those rows' total."""
    best = top_categories(rollup, top, path).select(path, "revenue")
    # the window only ever sees ``top`` rows
    running = Window.orderBy(F.desc("revenue"), F.asc(path)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    money = F.col("revenue").cast("decimal(28,12)")
    share = F.sum(money).over(running).cast("double") / F.sum(money).over(whole).cast("double")
    return best.withColumn("cumulative_pct", share * 100)


def top_products(df: DataFrame, score: str = "winner_score", top: int = TOP) -> DataFrame:
    return (
        df.where(F.col(score).isNotNull())
        .orderBy(F.desc(score), "id")
        .limit(top)
        .select("id", clean_name(F.col("name")).alias("name"), score)
    )


def local_insights(df: DataFrame) -> DataFrame:
    """Five short lists: leading categories and products, pricey sellers, fan favourites.

    The thresholds are exact quantiles over non-zero values, read once as plain numbers so
    that the filters reach the scan.
    """

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    measures = ["price", "units_sold", "rating"]
    nonzero = df.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "metric", "value")
    cuts = exact_quantiles(nonzero.where(F.col("value") != 0), "value", {"p75": 0.75, "p85": 0.85}, ["metric"])
    found = {r["metric"]: r for r in cuts.collect()}  # three rows

    def cut(metric: str, name: str) -> float:
        return found[metric][name] if metric in found else 0.0

    price_cut, units_cut, rating_cut = cut("price", "p75"), cut("units_sold", "p75"), cut("rating", "p85")

    def block(name: str, rows: DataFrame, value: Column, order: list[Column]) -> DataFrame:
        first = rows.orderBy(*order).limit(INSIGHT_TOP)
        place = F.row_number().over(Window.orderBy(*order))  # at most three rows
        return first.select(
            F.lit(name).alias("block"), place.cast("long").alias("place"), F.col("name"), value.alias("value")
        )

    categories = df.groupBy(F.col("category").alias("name")).agg(money_sum(zero("revenue")).alias("revenue"))
    whole = categories.agg(F.sum("revenue")).scalar()
    shares = categories.withColumn("share", ratio(F.col("revenue") * 100, whole))
    sellers = zero("units_sold") >= units_cut
    pricey = df.where((zero("price") >= price_cut) & sellers)
    loved = df.where((zero("rating") >= max(RATING_FLOOR, rating_cut)) & sellers)
    by_id = [F.asc("id")]
    blocks = [
        block("top_categories", shares, F.col("share"), [F.desc("revenue"), F.asc("name")]),
        block("top_revenue", df.where(zero("revenue") > 0), F.col("revenue"), [F.desc("revenue"), *by_id]),
        block("top_units", df.where(zero("units_sold") > 0), F.col("units_sold"), [F.desc("units_sold"), *by_id]),
        block("pricey_sellers", pricey, zero("revenue"), by_id),
        block("fan_favourites", loved, zero("rating"), by_id),
    ]
    return reduce(DataFrame.unionAll, blocks)


TEXT_ORDER = "es_CI_AI"  # the reports' language, blind to case and accents


def text_order(text: Column) -> Column:
    """What texts are sorted by: letters as in a dictionary, runs of digits by their value.

    A run of digits is preceded by its length, leading zeros left out, so that 9 comes before 10.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def valued(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(F.regexp(run, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, valued), ""), TEXT_ORDER)


def sort_products(df: DataFrame, column: str, descending: bool = False, numeric: bool = True) -> DataFrame:
    """Sorted rows; unreadable numbers and NaN come last in both directions, texts by :func:`text_order`."""
    if numeric:
        number = to_double(F.col(column))
        key = F.when(~F.isnan(number), number)
    else:
        key = text_order(F.col(column))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id")
