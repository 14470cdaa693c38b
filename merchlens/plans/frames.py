"""The product-research data model as views over the driver tables.

Every frame has a Spark form and the SQL text of the same view, so that a query and its
check read the same derived tables. All of them grow with the driver tables.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.functions import vocab

AS_OF = date(2002, 1, 1)
NOW = datetime(2002, 1, 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    """``values[index - 1]``; NULL for 0 and beyond."""
    chain = F.when(index == 1, values[0])
    for i, v in enumerate(values[1:], start=2):
        chain = chain.when(index == i, v)
    return chain


def _pick_sql(index: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values, start=1))
    return f"CASE {index} {cases} END"


def line_revenue() -> Column:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return price * (1 - F.col("l_discount").cast("decimal(4,2)"))


LINE_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"

# --- products -------------------------------------------------------------------------


def products(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part with sales from its line items; labels and gaps come from part columns."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum("l_quantity").alias("units_sold"),
            F.sum(line_revenue()).cast("double").alias("revenue"),
            (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("conversion_rate"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )
    size, brand_no = F.col("p_size"), F.substring("p_brand", 7, 10).cast("int")
    first, last = F.col("first_ship").cast("date"), F.col("last_ship").cast("date")
    joined = table(spark, folder, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        "units_sold",
        "revenue",
        F.when(size % 7 != 0, (10 + size % 41).cast("double") / 10).alias("rating"),
        "conversion_rate",
        F.col("first_ship").alias("import_date"),
        first.alias("first_seen"),
        last.alias("last_seen"),
        F.when(size % 2 == 0, F.concat_ws("~", first.cast("string"), last.cast("string"))).alias("date_range"),
        F.when(size % 5 != 0, first).alias("launch_date"),
        F.when(brand_no % 5 == 1, "").when(brand_no % 5 != 0, F.concat_ws(" ", "p_type", "p_name")).alias("desire"),
        _pick(brand_no % 4, vocab.TRI_LEVELS).alias("desire_magnitude"),
        _pick(size % 6, vocab.AWARENESS_LABELS).alias("awareness_level"),
        _pick(F.floor(size / 6) % 4, vocab.TRI_LEVELS).alias("competition_level"),
        (size * 2).alias("winner_score"),
        F.when(size % 3 != 0, F.col("first_ship")).alias("completed_at"),
        (F.floor(F.col("p_partkey") / 7)).alias("parent_id"),
        size.alias("size"),
    )


PRODUCTS = f"""
lines AS (
  SELECT l_partkey, SUM(l_quantity) AS units_sold, CAST(SUM({LINE_REVENUE}) AS DOUBLE) AS revenue,
    CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE) / COUNT(*) AS conversion_rate,
    MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
  FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS brand,
    p_retailprice AS price, units_sold, revenue,
    CASE WHEN p_size % 7 <> 0 THEN CAST(10 + p_size % 41 AS DOUBLE) / 10 END AS rating,
    conversion_rate, first_ship AS import_date, CAST(first_ship AS DATE) AS first_seen,
    CAST(last_ship AS DATE) AS last_seen,
    CASE WHEN p_size % 2 = 0 THEN concat_ws('~', CAST(CAST(first_ship AS DATE) AS VARCHAR), CAST(CAST(last_ship AS DATE) AS VARCHAR)) END AS date_range,
    CASE WHEN p_size % 5 <> 0 THEN CAST(first_ship AS DATE) END AS launch_date,
    CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 = 1 THEN ''
         WHEN CAST(substr(p_brand, 7) AS INT) % 5 <> 0 THEN p_type || ' ' || p_name END AS desire,
    {_pick_sql("CAST(substr(p_brand, 7) AS INT) % 4", vocab.TRI_LEVELS)} AS desire_magnitude,
    {_pick_sql("p_size % 6", vocab.AWARENESS_LABELS)} AS awareness_level,
    {_pick_sql("(p_size // 6) % 4", vocab.TRI_LEVELS)} AS competition_level,
    p_size * 2 AS winner_score,
    CASE WHEN p_size % 3 <> 0 THEN first_ship END AS completed_at,
    p_partkey // 7 AS parent_id, p_size AS size
  FROM part LEFT JOIN lines ON p_partkey = l_partkey)"""

# --- trend rows: one per line item, dated by its order ---------------------------------


def trend_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice", "p_size")
    lines = table(spark, folder, "lineitem")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    size = F.col("p_size")
    return joined.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("l_quantity").alias("units"),
        F.when(F.col("l_linenumber") != 7, line_revenue()).alias("revenue"),
        F.when(size % 7 != 0, (10 + size % 41).cast("double") / 10).alias("rating"),
        F.col("o_orderdate").alias("import_date"),
    )


TREND_ROWS = f"""
trend_rows AS (
  SELECT p_partkey AS id, p_type AS category, p_retailprice AS price, l_quantity AS units,
    COALESCE(CASE WHEN l_linenumber <> 7 THEN {LINE_REVENUE} END,
      CAST(CAST(p_retailprice * l_quantity AS DECIMAL(18,4)) AS DECIMAL(18,4))) AS revenue,
    CASE WHEN p_size % 7 <> 0 THEN CAST(10 + p_size % 41 AS DOUBLE) / 10 END AS rating,
    o_orderdate AS import_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

# --- score rows: one per line item ------------------------------------------------------

SCORE_COLUMNS = {
    "total_score": "l_extendedprice",
    "momentum": "l_quantity",
    "saturation": "l_discount",
    "differentiation": "l_tax",
    "social_proof": "l_linenumber",
    "margin": "l_suppkey",
    "logistics": "l_orderkey",
}


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("created_at"),
        (F.col("l_quantity") * 2).cast("int").alias("winner_score"),
        *[F.col(c).cast("double").alias(n) for n, c in SCORE_COLUMNS.items()],
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("summary"),
    )


SCORES = f"""
scores AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id, l_shipdate AS created_at,
    CAST(l_quantity * 2 AS INT) AS winner_score,
    {", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, c in SCORE_COLUMNS.items())},
    l_returnflag || '/' || l_linestatus AS summary
  FROM lineitem),
latest AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC) AS rn
    FROM scores) WHERE rn = 1)"""

# --- lists: nations, their members are the parts numbered like their customers ----------


def lists(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")
    )


def list_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("long").alias("list_id"), F.col("c_custkey").alias("product_id")
    )


LISTS = """
lists AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation),
list_items AS (SELECT CAST(c_nationkey AS BIGINT) AS list_id, c_custkey AS product_id FROM customer)"""

# --- enrichment items: one per order; the order's customer number names the product -----


def signed_parts(spark: SparkSession, folder: str) -> DataFrame:
    from merchlens.functions.text import signature

    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    state = (
        F.when(F.col("o_orderstatus") == "F", "enriched")
        .when(F.col("o_orderstatus") == "O", "pending_enrich")
        .when(F.col("o_orderkey") % 2 == 0, "failed")
        .otherwise("raw")
    )
    return orders.join(signed_parts(spark, folder), F.col("o_custkey") == F.col("id")).select(
        F.col("o_orderkey").alias("item_id"),
        F.year("o_orderdate").cast("long").alias("job_id"),
        "sig_hash",
        state.alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("amount"),
    )


ITEMS = """
signed_parts AS (
  SELECT p_partkey AS id, sha1(lower(p_name) || '|' || lower(p_brand) || '||') AS sig_hash FROM part),
items AS (
  SELECT o_orderkey AS item_id, CAST(year(o_orderdate) AS BIGINT) AS job_id, sig_hash,
    CASE WHEN o_orderstatus = 'F' THEN 'enriched' WHEN o_orderstatus = 'O' THEN 'pending_enrich'
         WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'raw' END AS state,
    o_orderdate AS created_at, o_totalprice AS amount
  FROM orders JOIN signed_parts ON o_custkey = id)"""

# --- cache: one entry per signature, from the parts --------------------------------------


def cache(spark: SparkSession, folder: str) -> DataFrame:
    """One entry per signature, dated by the size of its last part: large ones have expired."""
    from merchlens.functions.text import signature

    parts = table(spark, folder, "part")
    sig = signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None))
    return parts.groupBy(sig.alias("sig_hash")).agg(
        F.max_by(F.struct("p_size", "p_partkey"), "p_partkey").alias("r")
    ).select(
        "sig_hash",
        F.col("r.p_size").cast("long").alias("cached_desire"),
        F.timestamp_add("DAY", -F.col("r.p_size"), F.lit(NOW)).alias("updated_at"),
    )


CACHE = """
cache AS (
  SELECT sig_hash, CAST(p_size AS BIGINT) AS cached_desire,
    TIMESTAMP '2002-01-01' - to_days(p_size) AS updated_at
  FROM (SELECT sha1(lower(p_name) || '|' || lower(p_brand) || '||') AS sig_hash, p_size,
      ROW_NUMBER() OVER (PARTITION BY lower(p_name), lower(p_brand) ORDER BY p_partkey DESC) AS rn
    FROM part) WHERE rn = 1)"""


def with_views(*views: str) -> str:
    """The ``WITH`` clause of some of the views above."""
    return "WITH " + ",".join(views) + "\n"


# --- events: measurements of batches, requests and failures ------------------------------


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in their JSON properties as ``k``."""
    return table(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )


EVENTS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
