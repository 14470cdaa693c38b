"""Period and catalogue analytics over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.dates import period_bounds
from merchlens.operators import analytics, trends
from merchlens.plans import frames as fr
from merchlens.plans.registry import query

YEAR = (datetime(1998, 1, 1), datetime(1999, 1, 1))
MONTH = (datetime(1998, 3, 1), datetime(1998, 4, 1))


def rounded(df, digits: int = 4):
    """Doubles rounded for comparison, other columns as they are."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


_MEASURES = """
  COUNT(DISTINCT id) FILTER (cur) AS unique_products, SUM(units) FILTER (cur) AS units,
  CAST(SUM(revenue) FILTER (cur) AS DOUBLE) AS revenue,
  AVG(CAST(price AS DECIMAL(18,4))) FILTER (cur) AS avg_price,
  COALESCE(AVG(CAST(rating AS DECIMAL(18,4))) FILTER (cur), 0) AS avg_rating,
  COALESCE(CAST(SUM(revenue) FILTER (NOT cur) AS DOUBLE), 0) AS prev,
  COALESCE(SUM(units) FILTER (NOT cur), 0) AS prev_units"""


def _period_sql(start: str, end: str, previous: str, where: str = "") -> str:
    return fr.with_views(
        fr.TREND_ROWS,
        f"""x AS (SELECT *, import_date >= TIMESTAMP '{start}' AS cur FROM trend_rows
  WHERE import_date >= TIMESTAMP '{previous}' AND import_date < TIMESTAMP '{end}' {where})""",
    )


_CATEGORY_SQL = """SELECT category, unique_products, units, ROUND(revenue, 4) AS revenue,
  ROUND(avg_price, 4) AS avg_price, ROUND(avg_rating, 4) AS avg_rating,
  ROUND(revenue / units, 4) AS rev_per_unit,
  ROUND(CASE WHEN prev <> 0 THEN (revenue - prev) * 100 / prev ELSE 0 END, 4) AS delta_revenue_pct
FROM (SELECT category,""" + _MEASURES + """ FROM x GROUP BY category HAVING COUNT(*) FILTER (cur) > 0)"""


@query("trends_by_category", _period_sql("1998-01-01", "1999-01-01", "1997-01-01") + _CATEGORY_SQL)
def trends_by_category(spark, folder):
    return rounded(trends.trends_by_category(fr.trend_rows(spark, folder), *YEAR))


@query(
    "trends_by_category_filtered",
    _period_sql("1998-01-01", "1999-01-01", "1997-01-01", "AND category ILIKE 's%'") + _CATEGORY_SQL,
)
def trends_by_category_filtered(spark, folder):
    return rounded(trends.trends_by_category(fr.trend_rows(spark, folder), *YEAR, category_prefix="s"))


_TOTALS = """, g AS (SELECT category,""" + _MEASURES + """,
    SUM(CAST(price AS DECIMAL(18,4))) FILTER (cur) AS ps, COUNT(price) FILTER (cur) AS pc,
    SUM(CAST(rating AS DECIMAL(18,4))) FILTER (cur) AS rs, COUNT(rating) FILTER (cur) AS rc
  FROM x GROUP BY category),
t AS (SELECT CAST(SUM(unique_products) AS BIGINT) AS unique_products, SUM(units) AS units,
    (SELECT CAST(SUM(revenue) FILTER (cur) AS DOUBLE) FROM x) AS revenue, CAST(SUM(ps) AS DOUBLE) / SUM(pc) AS avg_price, CAST(SUM(rs) AS DOUBLE) / SUM(rc) AS avg_rating,
    (SELECT CAST(SUM(revenue) FILTER (NOT cur) AS DOUBLE) FROM x) AS prev, SUM(prev_units) AS prev_units FROM g)
SELECT unique_products, units, ROUND(revenue, 4) AS revenue, ROUND(avg_price, 4) AS avg_price,
  ROUND(avg_rating, 4) AS avg_rating, ROUND(revenue / units, 4) AS rev_per_unit,
  ROUND((revenue - prev) * 100 / prev, 4) AS delta_revenue_pct,
  ROUND((units - prev_units) * 100 / prev_units, 4) AS delta_units_pct FROM t"""


@query(
    "trends_totals",
    _period_sql("1998-01-01", "1999-01-01", "1997-01-01").rstrip() + _TOTALS,
)
def trends_totals(spark, folder):
    return rounded(trends.trends_totals(fr.trend_rows(spark, folder), *YEAR))


_CHANGE_IN_UNITS = "ROUND(CASE WHEN prev_units <> 0 THEN (units - prev_units) * 100 / prev_units ELSE 0 END, 4) AS delta_units_pct"


@query(
    "trends_overview",
    _period_sql("1998-01-01", "1999-01-01", "1997-01-01").rstrip()
    + _TOTALS.replace("SELECT unique_products, units, ROUND(revenue", ", whole AS (SELECT true AS is_total, NULL AS category, unique_products, units, ROUND(revenue")
    + "), per_category AS ("
    + _CATEGORY_SQL.replace("SELECT category, unique_products", "SELECT false AS is_total, category, unique_products", 1).replace(
        "AS delta_revenue_pct\nFROM", "AS delta_revenue_pct, " + _CHANGE_IN_UNITS + "\nFROM"
    )
    + ") SELECT * FROM whole UNION ALL BY NAME SELECT * FROM per_category",
)
def trends_overview(spark, folder):
    return rounded(trends.trends_overview(fr.trend_rows(spark, folder), *YEAR))


def _series_sql(start: str, end: str, unit: str) -> str:
    return (
        fr.with_views(fr.TREND_ROWS)
        + f"""SELECT CAST(CAST(date_trunc('{unit}', import_date) AS DATE) AS VARCHAR) AS date,
  SUM(units) AS units, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM trend_rows
WHERE import_date >= TIMESTAMP '{start}' AND import_date < TIMESTAMP '{end}' GROUP BY 1"""
    )


@query("trends_timeseries_weekly", _series_sql("1998-01-01", "1999-01-01", "week"))
def trends_timeseries_weekly(spark, folder):
    series = trends.trends_timeseries(fr.trend_rows(spark, folder), *YEAR)
    return series.withColumn("date", F.col("date").cast("string"))


@query("trends_timeseries_daily", _series_sql("1998-03-01", "1998-04-01", "day"))
def trends_timeseries_daily(spark, folder):
    series = trends.trends_timeseries(fr.trend_rows(spark, folder), *MONTH)
    return series.withColumn("date", F.col("date").cast("string"))


@query(
    "filter_period",
    fr.with_views(fr.TREND_ROWS)
    + """SELECT category, COUNT(*) AS rows, SUM(units) AS units FROM trend_rows
WHERE import_date >= TIMESTAMP '1998-06-02' AND import_date < TIMESTAMP '1998-07-02' AND category ILIKE '_r%'
GROUP BY category""",
)
def filter_period(spark, folder):
    start, end = period_bounds(None, datetime(1998, 7, 1).date())
    rows = trends.filter_period(fr.trend_rows(spark, folder), start, end, "_r")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units"))


# --- catalogue analytics ----------------------------------------------------------------

P = fr.with_views(fr.PRODUCTS)


@query(
    "category_summary",
    P + """SELECT upper(category[1]) || lower(category[2:]) AS category, COUNT(*) AS products,
  ROUND(COALESCE(SUM(revenue), 0), 2) AS total_revenue, COALESCE(SUM(units_sold), 0) AS total_units,
  ROUND(COALESCE(SUM(revenue), 0) / COUNT(*), 3) AS avg_revenue,
  ROUND(COALESCE(SUM(units_sold), 0) / COUNT(*), 3) AS avg_units,
  ROUND(COALESCE(AVG(price), 0), 3) AS avg_price, ROUND(COALESCE(AVG(rating), 0), 3) AS avg_rating
FROM products GROUP BY category""",
)
def category_summary(spark, folder):
    out = analytics.category_summary(fr.products(spark, folder))
    return rounded(out.withColumn("total_revenue", F.round("total_revenue", 2)), 3)


@query(
    "growth_by_category",
    fr.with_views(fr.EVENTS)
    + """SELECT category, CAST(SUM(k) AS DOUBLE) AS growth FROM (SELECT event_type AS category, k FROM ev)
GROUP BY category ORDER BY growth DESC, category LIMIT 10""",
)
def growth_by_category(spark, folder):
    ev = fr.events(spark, folder)
    extra = F.create_map(
        F.lit("Item Sold"), F.lit("7"),
        F.lit("Revenue Growth Rate"), F.concat(F.col("k").cast("string"), F.lit("%")),
    )
    return analytics.growth_by_category(ev.select(F.col("event_type").alias("category"), extra.alias("extra")))


@query(
    "revenue_per_unit",
    P + """SELECT lower(trim(category)) AS category, ROUND(SUM(revenue) / SUM(units_sold), 4) AS rev_per_unit
FROM products GROUP BY 1 ORDER BY rev_per_unit DESC, category LIMIT 10""",
)
def revenue_per_unit(spark, folder):
    return rounded(analytics.revenue_per_unit(fr.products(spark, folder)))


_STOPS = ", ".join(f"'{w}'" for w in vocab.KEYWORD_STOP_WORDS)


@query(
    "top_keywords",
    f"""SELECT keyword, COUNT(*) AS count FROM (
  SELECT unnest(regexp_split_to_array(lower(trim(regexp_replace(text, '{vocab.FLAME}+$', ''))), '[^{vocab.KEYWORD_LETTERS}]+')) AS keyword
  FROM documents)
WHERE length(keyword) >= 3 AND keyword NOT IN ({_STOPS})
GROUP BY keyword ORDER BY count DESC, keyword LIMIT 10""",
)
def top_keywords(spark, folder):
    return analytics.top_keywords(fr.table(spark, folder, "documents"), "text")


@query(
    "keyword_counts",
    f"""SELECT keyword, COUNT(*) AS count FROM (
  SELECT unnest(regexp_split_to_array(lower(p_name), '[^{vocab.KEYWORD_LETTERS}]+')) AS keyword FROM part)
WHERE length(keyword) >= 3 AND keyword NOT IN ({_STOPS}) GROUP BY keyword""",
)
def keyword_counts(spark, folder):
    return analytics.keyword_counts(fr.table(spark, folder, "part"), "p_name")


@query(
    "top_brands",
    f"""SELECT upper(brand[1]) || brand[2:] AS brand, count FROM (
  SELECT lower(regexp_split_to_array(trim(p_name), '[^A-Za-z0-9]+')[1]) AS brand, COUNT(*) AS count
  FROM part GROUP BY 1 HAVING length(brand) >= 3 AND brand NOT IN ({_STOPS})
  ORDER BY count DESC, brand LIMIT 10)""",
)
def top_brands(spark, folder):
    return analytics.top_brands(fr.table(spark, folder, "part").select(F.col("p_name").alias("name")))


@query(
    "kpis",
    P + """SELECT ROUND(SUM(revenue), 2) AS total_revenue, SUM(units_sold) AS total_units,
  ROUND(AVG(price), 4) AS avg_price,
  (SELECT upper(category[1]) || lower(category[2:]) FROM products GROUP BY category ORDER BY SUM(revenue) DESC LIMIT 1) AS top_category,
  (SELECT name FROM products WHERE revenue > 0 ORDER BY revenue DESC, id LIMIT 1) AS top_product
FROM products""",
)
def kpis(spark, folder):
    out = analytics.kpis(fr.products(spark, folder))
    return rounded(out.withColumn("total_revenue", F.round("total_revenue", 2)))


@query(
    "scatter_rating_revenue",
    P + """SELECT id, name AS label, rating AS x, ROUND(revenue, 4) AS y, units_sold AS r FROM products
WHERE rating IS NOT NULL AND revenue IS NOT NULL AND units_sold IS NOT NULL""",
)
def scatter_rating_revenue(spark, folder):
    return rounded(analytics.scatter_points(fr.products(spark, folder), "rating"))


@query(
    "scatter_price_revenue",
    P + """SELECT id, name AS label, price AS x, ROUND(revenue, 4) AS y FROM products
WHERE price IS NOT NULL AND revenue IS NOT NULL""",
)
def scatter_price_revenue(spark, folder):
    return rounded(analytics.scatter_points(fr.products(spark, folder), "price"))


_ROLLUP = """rollup_view AS (SELECT COALESCE(category, 'Sin categoría') AS path, COUNT(*) AS products,
  SUM(COALESCE(units_sold, 0)) AS units, SUM(COALESCE(CAST(revenue AS DECIMAL(18,4)), 0)) AS revenue,
  SUM(COALESCE(price, 0)) / COUNT(*) AS price, SUM(COALESCE(rating, 0)) / COUNT(*) AS rating
FROM products GROUP BY 1)"""
# finer groups for the rankings: category and brand
_FINE = """fine AS (SELECT category || ' ' || brand AS path,
  SUM(COALESCE(CAST(revenue AS DECIMAL(18,4)), 0)) AS revenue FROM products GROUP BY 1)"""


@query(
    "category_rollup_view",
    fr.with_views(fr.PRODUCTS, _ROLLUP)
    + """SELECT path, products, units, ROUND(CAST(revenue AS DOUBLE), 2) AS revenue, ROUND(price, 3) AS price,
  ROUND(rating, 3) AS rating FROM rollup_view""",
)
def category_rollup_view(spark, folder):
    out = analytics.category_rollup_view(fr.products(spark, folder))
    return rounded(out.withColumn("revenue", F.round("revenue", 2)), 3)


def _fine_rollup(spark, folder):
    products = fr.products(spark, folder)
    return analytics.category_rollup_view(
        products.withColumn("category", F.concat_ws(" ", "category", "brand"))
    )


@query(
    "top_categories",
    fr.with_views(fr.PRODUCTS, _FINE)
    + """SELECT path, ROUND(CAST(revenue AS DOUBLE), 3) AS revenue FROM fine WHERE revenue > 0
ORDER BY fine.revenue DESC, path LIMIT 10""",
)
def top_categories(spark, folder):
    return rounded(analytics.top_categories(_fine_rollup(spark, folder)).select("path", "revenue"), 3)


@query(
    "pareto",
    fr.with_views(fr.PRODUCTS, _FINE)
    + """, best AS (SELECT * FROM fine WHERE revenue > 0 ORDER BY revenue DESC, path LIMIT 15)
SELECT path, ROUND(CAST(revenue AS DOUBLE), 3) AS revenue,
  ROUND(CAST(SUM(revenue) OVER (ORDER BY revenue DESC, path ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / CAST(SUM(revenue) OVER () AS DOUBLE) * 100, 4) AS cumulative_pct FROM best""",
)
def pareto(spark, folder):
    return rounded(analytics.pareto(_fine_rollup(spark, folder)).withColumn("revenue", F.round("revenue", 3)))


@query(
    "top_products",
    fr.with_views(fr.SCORES)
    + """SELECT p_partkey AS id, p_name AS name, winner_score FROM part JOIN latest ON p_partkey = product_id
ORDER BY winner_score DESC, p_partkey LIMIT 10""",
)
def top_products(spark, folder):
    from merchlens.operators.latest import attach_latest_score

    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    scored = attach_latest_score(parts, fr.scores(spark, folder), ["winner_score"])
    return analytics.top_products(scored)


@query(
    "sort_products",
    P + """SELECT id, COALESCE(CAST(rating AS VARCHAR), 'n/a') AS shown, rating FROM products
ORDER BY rating DESC NULLS LAST, id""",
)
def sort_products(spark, folder):
    rows = fr.products(spark, folder).select(
        "id", F.coalesce(F.col("rating").cast("string"), F.lit("n/a")).alias("shown"), "rating"
    )
    return analytics.sort_products(rows, "shown", descending=True)


@query(
    "sort_products_text",
    """WITH named AS (SELECT p_partkey AS id, ['Árbol', 'árbol', 'zeta', 'Éter', 'eter'][1 + p_size % 5] || ' ' || (p_partkey % 300) || ['', ' Ü', ' u'][1 + p_size % 3] AS name,
  p_partkey % 300 AS number FROM part),
keyed AS (SELECT *, lower(strip_accents(split_part(name, ' ', 1))) AS head, lower(strip_accents(split_part(name, ' ', 3))) AS tail FROM named)
SELECT * FROM (SELECT 'first' AS page, id, name FROM keyed ORDER BY head, number, tail, id LIMIT 300)
UNION ALL SELECT * FROM (SELECT 'last' AS page, id, name FROM keyed ORDER BY head DESC, number DESC, tail DESC, id LIMIT 300)""",
)
def sort_products_text(spark, folder):
    """The first pages of a table sorted by names with accents, capitals and numbers, in both directions."""
    pick = lambda number, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (number + 1).cast("int"))
    number = F.concat(F.lit(" "), (F.col("p_partkey") % 300).cast("string"))
    name = F.concat(pick(F.col("p_size") % 5, "Árbol", "árbol", "zeta", "Éter", "eter"), number, pick(F.col("p_size") % 3, "", " Ü", " u"))
    rows = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    pages = [analytics.sort_products(rows, "name", down, numeric=False).limit(300).withColumn("page", F.lit(page)) for page, down in (("first", False), ("last", True))]
    return pages[0].unionByName(pages[1])


@query(
    "local_insights",
    P + """, cuts AS (SELECT
  (SELECT quantile_cont(price, 0.75) FROM products WHERE price <> 0) AS price_cut,
  (SELECT quantile_cont(units_sold, 0.75) FROM products WHERE units_sold <> 0) AS units_cut,
  (SELECT quantile_cont(rating, 0.85) FROM products WHERE rating <> 0) AS rating_cut),
cats AS (SELECT category AS name, SUM(CAST(COALESCE(revenue, 0) AS DECIMAL(18,4))) AS revenue FROM products GROUP BY 1),
blocks AS (
  SELECT 'top_categories' AS block, ROW_NUMBER() OVER (ORDER BY revenue DESC, name) AS place, name,
    CAST(revenue AS DOUBLE) * 100 / (SELECT CAST(SUM(revenue) AS DOUBLE) FROM cats) AS value FROM cats
  UNION ALL SELECT 'top_revenue', ROW_NUMBER() OVER (ORDER BY revenue DESC, id), name, revenue FROM products WHERE revenue > 0
  UNION ALL SELECT 'top_units', ROW_NUMBER() OVER (ORDER BY units_sold DESC, id), name, units_sold FROM products WHERE units_sold > 0
  UNION ALL SELECT 'pricey_sellers', ROW_NUMBER() OVER (ORDER BY id), name, COALESCE(revenue, 0) FROM products, cuts
    WHERE COALESCE(price, 0) >= price_cut AND COALESCE(units_sold, 0) >= units_cut
  UNION ALL SELECT 'fan_favourites', ROW_NUMBER() OVER (ORDER BY id), name, COALESCE(rating, 0) FROM products, cuts
    WHERE COALESCE(rating, 0) >= greatest(4.6, rating_cut) AND COALESCE(units_sold, 0) >= units_cut)
SELECT block, place, name, ROUND(value, 4) AS value FROM blocks WHERE place <= 3""",
)
def local_insights(spark, folder):
    from merchlens.session import cut_lineage

    products = fr.products(spark, folder).select(
        "id", "name", "category", "price", "units_sold", "revenue", "rating"
    )
    return rounded(analytics.local_insights(cut_lineage(products)))
