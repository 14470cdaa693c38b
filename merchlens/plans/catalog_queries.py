"""Reading, mapping, merging, filtering, listing and exporting catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.text import low_quality_text, signature
from merchlens.operators import filters, imports, latest, lists, merge, scoring
from merchlens.plans import frames as fr
from merchlens.plans.registry import query
from merchlens.plans.trend_queries import P, rounded
from merchlens.session import scratch_path
from merchlens.sources import catalog, export, normalise, pages
from merchlens.streaming import jobs as streams

# --- raw files, written from the part table ---------------------------------------------


def raw_catalog(spark, folder, listed=None) -> DataFrame:
    """Parts as a messy sheet: mixed headers, two name columns, European numbers; all parts or those ``listed``."""
    size = F.col("p_size")
    cents = F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(","))
    parts = fr.table(spark, folder, "part")
    return (parts if listed is None else parts.where(listed)).select(
        F.when(size % 4 != 0, F.concat(F.lit("  "), F.col("p_name"))).alias("Nombre"),
        F.when(size % 10 != 0, F.concat_ws(" ", "p_brand", "p_name")).alias("Title"),
        F.col("p_type").alias("Categoria"),
        F.concat(cents, F.lit(" €")).alias("Precio"),
        F.col("p_brand").alias("Seller"),
        F.concat((size % 9).cast("string"), F.lit(",5k")).alias("Item Sold"),
        F.when(size % 3 == 0, F.concat_ws(",", (size % 5).cast("string"), F.lit("5"))).alias("Product Rating"),
        F.col("p_partkey").cast("string").alias("Part No"),
        F.when(size % 6 == 0, "boxed, \"large\"").alias("Remarks"),
    )


_NAME = """COALESCE(CASE WHEN p_size % 4 <> 0 THEN p_name END, CASE WHEN p_size % 10 <> 0 THEN p_brand || ' ' || p_name END)"""


def sheet(spark, folder) -> DataFrame:
    path = scratch_path(spark, "sheet")
    raw_catalog(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return catalog.read_catalog(spark, path)


@query(
    "read_catalog_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS part_no, CASE WHEN p_size % 10 <> 0 THEN p_brand || ' ' || p_name END AS title,
  CASE WHEN p_size % 6 = 0 THEN 'boxed, "large"' END AS remarks FROM part""",
)
def read_catalog_csv(spark, folder):
    rows = sheet(spark, folder)
    return rows.select(
        F.col("Part No").alias("part_no"), F.col("Title").alias("title"), F.col("Remarks").alias("remarks")
    )


@query(
    "read_catalog_json",
    """SELECT CAST(p_partkey AS VARCHAR) AS part_no, p_type AS category, CAST(p_size AS VARCHAR) AS size FROM part""",
)
def read_catalog_json(spark, folder):
    path = scratch_path(spark, "json")
    fr.table(spark, folder, "part").select("p_partkey", "p_type", "p_size").write.json(path)
    rows = catalog.read_catalog(spark, path, "json", whole_files=False)
    return rows.select(
        F.col("p_partkey").alias("part_no"), F.col("p_type").alias("category"), F.col("p_size").alias("size")
    )


@query(
    "read_catalog_csv_cells",
    """SELECT CAST(p_partkey AS VARCHAR) AS part_no, p_name || '"' || chr(10) || ' of ' || p_brand AS title,
  CASE WHEN p_size % 6 = 0 THEN chr(10) || '"' || chr(10) END AS remarks FROM part""",
)
def read_catalog_csv_cells(spark, folder):
    """Cells with line breaks and quotes, in files that are split all the same."""
    path = scratch_path(spark, "cells")
    parts = fr.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("Part No"),
        F.concat("p_name", F.lit('"\n of '), "p_brand").alias("Title"),
        F.when(F.col("p_size") % 6 == 0, '\n"\n').alias("Remarks"),
    )
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    parts.write.options(header=True, quoteAll=True, escape='"', **kept).csv(path)
    rows = catalog.read_catalog(spark, path)
    return rows.select(
        F.col("Part No").alias("part_no"), F.col("Title").alias("title"), F.nullif("Remarks", F.lit("")).alias("remarks")
    )


@query(
    "read_catalog_json_list",
    """SELECT CAST(p_partkey AS VARCHAR) AS part_no, p_name || ' }" {' AS title, p_size % 50 AS list,
  CASE WHEN p_size % 3 = 0 THEN '{"brand":"' || p_brand || '","tags":["[","}"]}' END AS made FROM part""",
)
def read_catalog_json_list(spark, folder):
    """Lists of objects, one a file, in which braces stand in texts and objects in objects."""
    path = scratch_path(spark, "lists")
    number = (F.col("p_size") % 50).alias("list")
    made = F.struct(F.col("p_brand").alias("brand"), F.array(F.lit("["), F.lit("}")).alias("tags"))
    parts = fr.table(spark, folder, "part")
    entry = F.to_json(
        F.struct("p_partkey", F.concat("p_name", F.lit(' }" {')).alias("title"), F.when(F.col("p_size") % 3 == 0, made).alias("made"))
    )
    entries = parts.select(number, F.lit(1).alias("place"), F.concat(F.lit(","), entry).alias("line"))
    end = lambda place, line: F.struct(F.lit(place).alias("place"), F.lit(line).alias("line"))
    ends = parts.select(number).distinct().select("list", F.inline(F.array(end(0, "[null"), end(2, "]"))))
    lines = entries.unionByName(ends).repartition("list").sortWithinPartitions("list", "place")
    lines.select("list", "line").write.partitionBy("list").text(path)
    rows = catalog.read_catalog(spark, path, "json")
    list_of = F.regexp_extract(F.col("_seq")["file"], r"list=(\d+)", 1).cast("int").alias("list")
    return rows.select(F.col("p_partkey").alias("part_no"), "title", list_of, "made")


@query(
    "read_catalog_dir",
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'csv' ELSE 'json' END AS kind, COUNT(*) AS rows, COUNT(DISTINCT p_name) AS names,
  COUNT(CASE WHEN p_size % 2 = 0 THEN p_brand END) AS brands FROM part GROUP BY 1""",
)
def read_catalog_dir(spark, folder):
    base = scratch_path(spark, "dir")
    parts = fr.table(spark, folder, "part")
    even = F.col("p_size") % 2 == 0
    parts.where(even).select("p_name", "p_brand").write.option("header", True).csv(base)
    parts.where(~even).select("p_name").write.mode("append").json(base)
    rows = catalog.read_catalog_dir(spark, base, whole_files=False)
    kind = F.regexp_extract(F.col("_seq")["file"], r"\.(csv|json)$", 1)
    return rows.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("p_name").alias("names"),
        F.count("p_brand").alias("brands"),
    )


@query(
    "map_columns",
    f"""SELECT {_NAME} AS name, p_type AS category, p_brand AS brand,
  CASE WHEN p_size % 4 <> 0 AND p_size % 10 <> 0 THEN p_brand || ' ' || p_name END AS other_title,
  CAST(p_partkey AS VARCHAR) AS part_no FROM part""",
)
def map_columns(spark, folder):
    mapped = catalog.map_columns(sheet(spark, folder))
    return mapped.select(
        "name", "category", "brand",
        F.try_element_at("other", F.lit("Title")).alias("other_title"),
        F.try_element_at("other", F.lit("Part No")).alias("part_no"),
    )


@query(
    "map_columns_contains",
    """SELECT CAST(p_partkey AS VARCHAR) AS part_no, CASE WHEN p_size % 3 = 0 THEN (p_size % 5) || ',5' END AS rating,
  (p_size % 9) || ',5k' AS units, CASE WHEN p_size % 10 <> 0 THEN p_brand || ' ' || p_name END AS name FROM part""",
)
def map_columns_contains(spark, folder):
    mapped = catalog.map_columns(sheet(spark, folder), "contains")
    return mapped.select(
        F.try_element_at("other", F.lit("Part No")).alias("part_no"),
        "rating", F.col("units_sold").alias("units"), "name",
    )


@query(
    "normalise_products",
    f"""SELECT sha1(lower({_NAME}) || '|' || lower(p_brand) || '||') AS sig_hash, {_NAME} AS name, p_type AS category,
  p_retailprice AS price, CAST((p_size % 9) * 1000 + 500 AS VARCHAR) AS units_sold,
  CASE WHEN p_size % 3 = 0 THEN (p_size % 5) || '.5' END AS rating, p_brand AS brand, 'sheet' AS source,
  CAST(p_partkey AS VARCHAR) AS part_no FROM part WHERE {_NAME} IS NOT NULL""",
)
def normalise_products(spark, folder):
    mapped = catalog.map_columns(sheet(spark, folder))
    rows = normalise.normalise_products(mapped, source="sheet", import_date=F.lit(fr.NOW))

    def extra(key):
        return F.try_element_at("extra", F.lit(key))

    return rows.select(
        "sig_hash", "name", "category", "price", extra("units_sold").alias("units_sold"), extra("rating").alias("rating"),
        extra("brand").alias("brand"), "source", extra("Part No").alias("part_no"),
    )


@query(
    "normalise_products_contains",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_brand || ' ' || p_name END AS name,
    CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price, p_size * 10 AS units FROM part)
SELECT name, ROUND(price, 4) AS price, CAST(units AS VARCHAR) AS units_sold,
  ROUND(COALESCE(CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 0.5 END, price * units), 4) AS revenue,
  (p_partkey % 100) / 100.0 AS tasa_conversion FROM x WHERE name IS NOT NULL""",
)
def normalise_products_contains(spark, folder):
    size, key = F.col("p_size"), F.col("p_partkey")
    raw = fr.table(spark, folder, "part").select(
        F.when(size % 10 != 0, F.concat_ws(" ", "p_brand", "p_name")).alias("Product Name"),
        F.when(size % 5 != 0, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).alias("Unit Cost"),
        F.concat((size * 10).cast("string"), F.lit(" pcs")).alias("Units Sold"),
        F.when(key % 2 == 0, F.concat(F.lit("$ "), key.cast("string"), F.lit(".5"))).alias("Total Revenue"),
        F.concat((key % 100).cast("string"), F.lit(" %")).alias("Tasa_Conversion"),
    )
    # "conversion" claims the last header for the conversion rate; read the metric from it
    mapped = catalog.map_columns(raw, "contains").withColumnRenamed("conversion_rate", "tasa_conversion")
    rows = normalise.normalise_products_contains(mapped)
    return rounded(
        rows.select(
            "name", "price", F.try_element_at("extra", F.lit("units_sold")).alias("units_sold"),
            F.try_element_at("extra", F.lit("revenue")).cast("double").alias("revenue"), "tasa_conversion",
        )
    )


@query(
    "assign_ids",
    """SELECT COUNT(*) AS rows, COUNT(*) AS ids, (SELECT MAX(l_partkey) FROM lineitem) + 2 AS first_id,
  (SELECT MAX(l_partkey) FROM lineitem) + 1 + COUNT(*) AS last_id, TRUE AS in_file_order FROM part""",
)
def assign_ids(spark, folder):
    existing = fr.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    rows = normalise.assign_ids(sheet(spark, folder), existing)
    from pyspark.sql.window import Window

    # the previous id of the same file has the smaller part number
    previous = F.lag(F.col("Part No").cast("long")).over(Window.partitionBy("_file").orderBy("id"))
    checked = rows.select("id", (F.coalesce(previous, F.lit(-1)) < F.col("Part No").cast("long")).alias("ordered"))
    return checked.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"), F.bool_and("ordered").alias("in_file_order"),
    )


# --- merge ------------------------------------------------------------------------------

SIG = "sha1(lower(p_name) || '|' || lower(p_brand) || '||')"


def _stored_and_staged(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Stored: one row per signature of parts with a document. Staged: parts with orders."""
    parts = fr.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("winner_score"),
        F.col("p_partkey").alias("seq"),
    )
    described = fr.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    ordered = fr.table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    stored = merge.dedup_last(parts.join(described, "id", "left_semi"), ["sig_hash"], "seq").drop("seq")
    stored = stored.withColumn("winner_score", F.coalesce("winner_score", F.lit(0)))
    return stored, parts.join(ordered, "id", "left_semi")


@query(
    "upsert_products",
    f"""WITH parts AS (SELECT p_partkey AS id, {SIG} AS sig_hash, p_name AS name, p_retailprice AS price,
    CASE WHEN p_size % 3 <> 0 THEN p_size END AS winner_score FROM part),
stored AS (SELECT id, sig_hash, name, price, COALESCE(winner_score, 0) AS winner_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sig_hash ORDER BY id DESC) AS rn FROM parts WHERE id IN (SELECT doc_id FROM documents)) WHERE rn = 1),
staged AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sig_hash ORDER BY id DESC) AS rn FROM parts WHERE id IN (SELECT o_custkey FROM orders)) WHERE rn = 1)
SELECT COALESCE(o.id, n.id) AS id, COALESCE(n.sig_hash, o.sig_hash) AS sig_hash, COALESCE(n.name, o.name) AS name, COALESCE(n.price, o.price) AS price,
  COALESCE(n.winner_score, o.winner_score, 0) AS winner_score
FROM stored o FULL OUTER JOIN staged n ON o.sig_hash = n.sig_hash""",
)
def upsert_products(spark, folder):
    stored, staged = _stored_and_staged(spark, folder)
    return merge.upsert_products(stored, staged)


@query(
    "snapshot_upsert",
    f"""SELECT COUNT(DISTINCT {SIG}) AS products, COUNT(DISTINCT {SIG}) AS signatures FROM part
WHERE p_partkey IN (SELECT doc_id FROM documents) OR p_partkey IN (SELECT o_custkey FROM orders)""",
)
def snapshot_upsert(spark, folder):
    """The upsert as changes that are stored one after the other and merged on reading."""
    root = scratch_path(spark, "products")
    stored, staged = _stored_and_staged(spark, folder)
    merge.append_changes(stored, root, "stored")
    merge.append_changes(merge.dedup_last(staged, ["sig_hash"], "seq").drop("seq"), root, "staged")
    return merge.read_merged(spark, root, keep_old_if_null={"winner_score": 0}, keep_always=["id"]).agg(
        F.count(F.lit(1)).alias("products"), F.countDistinct("sig_hash").alias("signatures")
    )


# --- from raw files to scores -----------------------------------------------------------

_ONLY_SALES = scoring.ScoreConfig(
    {**{f: 0 for f in vocab.SCORE_FIELDS}, "price": 40, "rating": 30, "units_sold": 90, "oldness": 50}, as_of=fr.AS_OF
)
# units are first in the default order, price fourth and rating seventh of eight: 90 x 8, 48 x 5 ... as shares of their sum
_EFF = {"price": "(4 / 17.0)", "rating": "(1 / 17.0)", "units_sold": "(12 / 17.0)"}
_SCORED_SHEET = f"""WITH rows AS (SELECT {_NAME} AS name, p_retailprice AS price, (p_size % 9) * 1000 + 500 AS units,
    CASE WHEN p_size % 3 = 0 THEN (p_size % 5) + 0.5 END AS rating, p_brand, p_partkey FROM part WHERE {_NAME} IS NOT NULL),
last AS (SELECT *, sha1(lower(name) || '|' || lower(p_brand) || '||') AS sig_hash,
  ROW_NUMBER() OVER (PARTITION BY lower(name), lower(p_brand) ORDER BY p_partkey DESC) AS rn FROM rows)
SELECT sig_hash, ROUND(100 * (least(1, price / 1000) * {_EFF["price"]} + COALESCE(rating / 5 * {_EFF["rating"]}, 0)
  + least(1, ln(1 + units) / ln(10001)) * {_EFF["units_sold"]}), 4) AS score_raw FROM last WHERE rn = 1"""


_IMPORTED = f"""WITH rows AS (SELECT {_NAME} AS name, p_retailprice AS price, (p_size % 9) * 1000 + 500 AS units,
    CASE WHEN p_size % 3 = 0 THEN (p_size % 5) + 0.5 END AS rating, p_brand, p_partkey, p_size % 7 <> 0 AS early FROM part WHERE {_NAME} IS NOT NULL),
keyed AS (SELECT *, sha1(lower(name) || '|' || lower(p_brand) || '||') AS sig_hash FROM rows),
first AS (SELECT sig_hash, ROW_NUMBER() OVER (ORDER BY MAX(p_partkey)) AS id FROM keyed WHERE early GROUP BY sig_hash),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sig_hash ORDER BY p_partkey DESC) AS rn FROM keyed),
late AS (SELECT sig_hash, (SELECT COALESCE(MAX(id), -1) + 1 FROM first) + ROW_NUMBER() OVER (ORDER BY p_partkey) AS id
  FROM last WHERE rn = 1 AND sig_hash NOT IN (SELECT sig_hash FROM first)),
ids AS (SELECT * FROM first UNION ALL SELECT * FROM late)
SELECT id, sig_hash, ROUND(100 * (least(1, price / 1000) * {_EFF["price"]} + COALESCE(rating / 5 * {_EFF["rating"]}, 0)
  + least(1, ln(1 + units) / ln(10001)) * {_EFF["units_sold"]}), 4) AS score_raw FROM last JOIN ids USING (sig_hash) WHERE rn = 1"""


@query("import_products", _IMPORTED)
def import_products(spark, folder):
    """Two imports into one store, the second of which brings new products and new values of old ones."""
    root, sheets = scratch_path(spark, "store"), [scratch_path(spark, "sheet") for _ in range(2)]
    raw = raw_catalog(spark, folder)
    early = raw_catalog(spark, folder, F.col("p_size") % 7 != 0).withColumn("Precio", F.lit("1,00 €"))
    for rows, path in zip((early, raw), sheets):
        rows.write.option("header", True).option("escape", '"').csv(path)
        scored = imports.import_catalog(spark, path, root, _ONLY_SALES, "csv", import_date=F.lit(fr.NOW))
    return rounded(scored.select("id", "sig_hash", "score_raw"))


@query("import_and_score", _SCORED_SHEET)
def import_and_score(spark, folder):
    """The whole import: read, map, type, deduplicate, score."""
    mapped = catalog.map_columns(sheet(spark, folder))
    staged = normalise.normalise_products(mapped, import_date=F.lit(fr.NOW))
    products = merge.dedup_last(staged, ["sig_hash"], "_seq")
    return rounded(scoring.winner_score(products, _ONLY_SALES).select("sig_hash", "score_raw"))


@query("stream_import", _SCORED_SHEET)
def stream_import(spark, folder):
    """The same import as a stream of files into a stored table."""
    path, root = scratch_path(spark, "incoming"), scratch_path(spark, "products")
    raw = raw_catalog(spark, folder)
    raw.write.option("header", True).option("escape", '"').csv(path)
    stream = catalog.stream_catalog(spark, path, raw.columns)
    streams.stream_import(stream, root, scratch_path(spark, "state")).awaitTermination()
    products = merge.read_merged(spark, root, "sig_hash", {"winner_score": 0})
    return rounded(scoring.winner_score(products, _ONLY_SALES).select("sig_hash", "score_raw"))


# --- filters ----------------------------------------------------------------------------


@query("select_ids", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_ids(spark, folder):
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    wanted = fr.table(spark, folder, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return filters.select_ids(parts, wanted)


_WANT = filters.ProductFilter(
    ids=filters.parse_id_query("5-900, 1700-950, 3"),
    category="o",
    price=(905.0, 1060.0),
    rating=(1.5, None),
    units_sold=(200.0, 1200.0),
    revenue=(None, 5e7),
    conversion_rate=(0.1, 0.9),
    winner_score=(4, 98),
    launched=("1995-01-10", "1995-12-31"),
    awareness_level="problem aware",
)
_WANT_SQL = """(id BETWEEN 5 AND 900 OR id BETWEEN 950 AND 1700 OR id = 3) AND lower(category) LIKE '%o%' AND price BETWEEN 905 AND 1060
  AND rating >= 1.5 AND units_sold BETWEEN 200 AND 1200 AND revenue <= 5e7 AND conversion_rate BETWEEN 0.1 AND 0.9
  AND winner_score BETWEEN 4 AND 98 AND regexp_replace(lower(awareness_level), '[ -]', '', 'g') = 'problemaware'"""


@query(
    "filter_products",
    P + f"SELECT id, price, rating FROM products WHERE {_WANT_SQL} AND launch_date BETWEEN DATE '1995-01-10' AND DATE '1995-12-31'",
)
def filter_products(spark, folder):
    return filters.filter_products(fr.products(spark, folder), _WANT).select("id", "price", "rating")


@query(
    "filter_products_lenient",
    P + f"SELECT id, price, rating FROM products WHERE {_WANT_SQL} AND (launch_date IS NULL OR launch_date BETWEEN DATE '1995-01-10' AND DATE '1995-12-31')",
)
def filter_products_lenient(spark, folder):
    return filters.filter_products(fr.products(spark, folder), _WANT, lenient_dates=True).select("id", "price", "rating")


@query(
    "filter_products_labels",
    P + """SELECT id FROM products WHERE desire_magnitude = 'High' AND competition_level = 'Low' AND date_range LIKE '%1995-02%'""",
)
def filter_products_labels(spark, folder):
    want = filters.ProductFilter(desire_magnitude="High", competition_level="Low", range_text="1995-02")
    return filters.filter_products(fr.products(spark, folder), want).select("id")


_GAPS = "desire IS NULL OR desire = '' OR desire_magnitude IS NULL OR awareness_level IS NULL OR competition_level IS NULL"


@query("missing_enrichment", P + f"SELECT id FROM products WHERE {_GAPS}")
def missing_enrichment(spark, folder):
    return filters.missing_enrichment(fr.products(spark, folder)).select("id")


@query("missing_enrichment_incomplete", P + "SELECT id FROM products WHERE completed_at IS NULL ORDER BY id DESC LIMIT 100")
def missing_enrichment_incomplete(spark, folder):
    return filters.missing_enrichment(fr.products(spark, folder), "incomplete", 100).select("id")


@query("missing_enrichment_candidates", P + f"SELECT id FROM products WHERE name <> '' AND (completed_at IS NULL OR {_GAPS})")
def missing_enrichment_candidates(spark, folder):
    return filters.missing_enrichment(fr.products(spark, folder), "candidate").select("id")


@query("list_products", P + "SELECT id, name, CAST(CAST(import_date AS DATE) AS VARCHAR) AS imported FROM products ORDER BY import_date DESC, id")
def list_products(spark, folder):
    rows = filters.list_products(fr.products(spark, folder).select("id", "name", "import_date"))
    return rows.select("id", "name", F.col("import_date").cast("date").cast("string").alias("imported"))


_UNITS = ", ".join(f"'{u}'" for u in vocab.UNIT_WORDS)
_CATS = "|".join(vocab.CATEGORY_WORDS)
# text folded to plain lower-case ASCII
_PLAIN = "lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g'))"
_LOW_QUALITY = """
folded AS (SELECT id, body, title, """ + _PLAIN.format(c="body") + """ AS t, """ + _PLAIN.format(c="title") + """ AS tt FROM texts),
low AS (SELECT id, length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) < 280
  OR list_has_any(regexp_split_to_array(t, '\\s+'), [{units}]) OR regexp_matches(t, '\\b({cats})\\b')
  OR len(list_intersect(list_distinct(list_concat(regexp_extract_all(tt, '[a-z]{{3,}}'), ['set', 'kit', 'pack'])),
         list_distinct(regexp_extract_all(t, '[a-z]{{3,}}')))) >= 3 AS low_quality FROM folded)
""".replace("{units}", _UNITS).replace("{cats}", _CATS).replace("{{", "{").replace("}}", "}")


@query(
    "low_quality_text",
    "WITH texts AS (SELECT doc_id AS id, text AS body, concat_ws(' ', p_brand, p_name, 'with the and') AS title FROM documents LEFT JOIN part ON doc_id = p_partkey),"
    + _LOW_QUALITY
    + "SELECT id, low_quality FROM low",
)
def low_quality_text_query(spark, folder):
    docs = fr.table(spark, folder, "documents").join(fr.table(spark, folder, "part"), F.col("doc_id") == F.col("p_partkey"), "left")
    title = F.concat_ws(" ", "p_brand", "p_name", F.lit("with the and"))
    return docs.select(F.col("doc_id").alias("id"), low_quality_text(F.col("text"), title).alias("low_quality"))


@query(
    "serve_products",
    P + """SELECT id, name, category, CAST(round_even(price, 2) AS DOUBLE) AS price_display, NULLIF(desire, '') AS desire, awareness_level, competition_level,
  NULLIF(winner_score, 0) AS winner_score, CAST(CAST(units_sold AS BIGINT) AS VARCHAR) AS units_sold, CAST(CAST(units_sold AS BIGINT) AS VARCHAR) AS item_sold,
  COALESCE(date_range, CAST(first_seen AS VARCHAR) || '—' || CAST(last_seen AS VARCHAR)) AS date_range,
  CAST(launch_date AS VARCHAR) AS launched FROM products""",
)
def serve_products(spark, folder):
    products = fr.products(spark, folder)
    extra = F.map_filter(
        F.create_map(
            F.lit("units_sold"), F.col("units_sold").cast("long").cast("string"),
            F.lit("launch_date"), F.col("launch_date").cast("string"),
            F.lit("LAST SEEN"), F.col("last_seen").cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    flamed = F.when(F.col("size") % 2 == 0, F.concat(F.col("name"), F.lit(vocab.FLAME * 2))).otherwise(F.col("name"))
    rows = products.withColumn("extra", extra).withColumn("name", flamed).drop("units_sold", "launch_date", "last_seen")
    return filters.serve_products(rows).select(
        "id", "name", "category", "price_display", "desire", "awareness_level", "competition_level", "winner_score", "units_sold",
        F.try_element_at("extras", F.lit("Item Sold")).alias("item_sold"), "date_range",
        F.try_element_at("extras", F.lit("Launch Date")).alias("launched"),
    )


_UPDATES = """upd AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'High' ELSE 'very high' END AS desire_magnitude,
  CASE WHEN toxic = 1 THEN 'unknown' ELSE 'Most Aware' END AS awareness_level FROM labels)"""


def _updates(spark, folder) -> DataFrame:
    return fr.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "High").otherwise("very high").alias("desire_magnitude"),
        F.when(F.col("toxic") == 1, "unknown").otherwise("Most Aware").alias("awareness_level"),
        F.lit("x").alias("no_such_column"),
    )


@query(
    "update_columns",
    fr.with_views(fr.PRODUCTS, _UPDATES)
    + """SELECT p.id, CASE WHEN upd.id IS NULL THEN p.desire_magnitude WHEN upd.desire_magnitude = 'High' THEN 'High' END AS desire_magnitude,
  CASE WHEN upd.id IS NULL THEN p.awareness_level WHEN upd.awareness_level = 'Most Aware' THEN 'Most Aware' END AS awareness_level
FROM products p LEFT JOIN upd ON p.id = upd.id""",
)
def update_columns(spark, folder):
    products = fr.products(spark, folder).select("id", "desire_magnitude", "awareness_level")
    return filters.update_columns(products, _updates(spark, folder))


@query(
    "update_columns_model",
    fr.with_views(fr.PRODUCTS, _UPDATES)
    + """SELECT p.id, COALESCE(CASE WHEN upd.desire_magnitude = 'High' THEN 'High' END, p.desire_magnitude) AS desire_magnitude,
  COALESCE(CASE WHEN upd.awareness_level = 'Most Aware' THEN 'Most Aware' END, p.awareness_level) AS awareness_level,
  CASE WHEN upd.id IS NULL THEN CAST(CAST(completed_at AS DATE) AS VARCHAR) ELSE '2002-01-01' END AS completed
FROM products p LEFT JOIN upd ON p.id = upd.id""",
)
def update_columns_model(spark, folder):
    products = fr.products(spark, folder).select("id", "desire_magnitude", "awareness_level", "completed_at")
    out = filters.update_columns(products, _updates(spark, folder), "coalesce", F.lit(fr.NOW))
    return out.select("id", "desire_magnitude", "awareness_level", F.col("completed_at").cast("date").cast("string").alias("completed"))


@query(
    "score_band",
    P + """SELECT CASE WHEN winner_score >= 80 THEN 'green' WHEN winner_score >= 60 THEN 'amber' ELSE 'red' END AS band, COUNT(*) AS products
FROM products GROUP BY 1""",
)
def score_band(spark, folder):
    rows = fr.products(spark, folder)
    return rows.groupBy(filters.score_band(F.col("winner_score")).alias("band")).agg(F.count(F.lit(1)).alias("products"))


@query(
    "delete_products",
    fr.with_views(fr.SCORES, fr.LISTS)
    + """SELECT 'products' AS kept, COUNT(*) AS rows FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'scores', COUNT(*) FROM scores WHERE product_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'list_items', COUNT(*) FROM list_items WHERE product_id NOT IN (SELECT doc_id FROM labels)""",
)
def delete_products(spark, folder):
    doomed = fr.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    products = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    kept = filters.delete_products(doomed, products, fr.scores(spark, folder), fr.list_items(spark, folder))
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("kept"), "rows")
        for name, df in zip(("products", "scores", "list_items"), kept)
    ]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


# --- lists and lookups ------------------------------------------------------------------

LISTS = fr.with_views(fr.LISTS)


@query(
    "products_in_list",
    fr.with_views(fr.PRODUCTS, fr.LISTS) + "SELECT id, name FROM products JOIN list_items ON id = product_id WHERE list_id = 3",
)
def products_in_list(spark, folder):
    return lists.products_in_list(fr.products(spark, folder), fr.list_items(spark, folder), 3).select("id", "name")


@query(
    "list_counts",
    LISTS + """SELECT id, name, COUNT(product_id) AS count FROM lists LEFT JOIN list_items ON list_id = id GROUP BY id, name""",
)
def list_counts(spark, folder):
    return lists.list_counts(fr.lists(spark, folder), fr.list_items(spark, folder))


@query(
    "add_remove_list_members",
    LISTS + """, added AS (SELECT list_id, product_id FROM list_items UNION SELECT 1, doc_id FROM documents)
SELECT list_id, COUNT(*) AS members FROM added WHERE NOT (list_id = 2 AND product_id IN (SELECT doc_id FROM labels)) GROUP BY 1""",
)
def add_remove_list_members(spark, folder):
    new = fr.table(spark, folder, "documents").select(
        F.lit(1).cast("long").alias("list_id"), F.col("doc_id").alias("product_id")
    )
    gone = fr.table(spark, folder, "labels").select(F.lit(2).cast("long").alias("list_id"), F.col("doc_id").alias("product_id"))
    members = lists.add_list_members(fr.list_items(spark, folder), new)
    return lists.remove_list_members(members, gone).groupBy("list_id").agg(F.count(F.lit(1)).alias("members"))


@query(
    "move_list_members",
    LISTS + """, grown AS (SELECT list_id, product_id FROM list_items UNION SELECT 5, product_id FROM list_items WHERE list_id = 4 AND product_id IN (SELECT doc_id FROM labels)),
moved AS (SELECT 5 AS list_id, product_id FROM grown WHERE list_id IN (4, 5) GROUP BY product_id)
SELECT list_id, COUNT(*) AS members FROM (SELECT * FROM grown WHERE list_id NOT IN (4, 5) UNION ALL SELECT * FROM moved) GROUP BY 1""",
)
def move_list_members(spark, folder):
    members = fr.list_items(spark, folder)
    labelled = fr.table(spark, folder, "labels").select(F.col("doc_id").alias("product_id"))
    shared = members.where(F.col("list_id") == 4).join(labelled, "product_id", "left_semi")
    shared = shared.select(F.lit(5).cast("long").alias("list_id"), "product_id")
    grown = lists.add_list_members(members, shared)
    _, after, _ = lists.move_list_members(fr.lists(spark, folder), grown, 4, 5)
    return after.groupBy("list_id").agg(F.count(F.lit(1)).alias("members"))


@query(
    "job_products",
    fr.with_views(fr.ITEMS) + "SELECT DISTINCT id FROM signed_parts WHERE sig_hash IN (SELECT sig_hash FROM items WHERE job_id = 1997)",
)
def job_products(spark, folder):
    return lists.job_products(fr.signed_parts(spark, folder), fr.items(spark, folder), 1997)


@query(
    "latest_score",
    fr.with_views(fr.SCORES)
    + """SELECT p_partkey AS id, winner_score, total_score, summary FROM part LEFT JOIN latest ON p_partkey = product_id""",
)
def latest_score(spark, folder):
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return latest.attach_latest_score(parts, fr.scores(spark, folder), ["winner_score", "total_score", "summary"])


@query(
    "compare_products",
    fr.with_views(fr.SCORES)
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, MAX({m}) FILTER (product_id = 3) AS p3, MAX({m}) FILTER (product_id = 77) AS p77, "
        f"MAX({m}) FILTER (product_id = 150) AS p150, MAX({m}) FILTER (product_id = 199) AS p199, MAX({m}) FILTER (product_id = 12) AS p12 FROM latest"
        for m in ["total_score", *vocab.SUB_SCORES]
    ),
)
def compare_products(spark, folder):
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return lists.compare_products(parts, fr.scores(spark, folder), [3, 77, 150, 199, 12])


@query(
    "find_by_name",
    "SELECT lower(p_name) AS wanted, MIN(p_partkey) AS id FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_brand = 'Brand#7') GROUP BY 1",
)
def find_by_name(spark, folder):
    parts = fr.table(spark, folder, "part")
    wanted = parts.where(F.col("p_brand") == "Brand#7").select(F.upper("p_name").alias("name"))
    return lists.find_by_name(parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), wanted)


# --- pages and exports ------------------------------------------------------------------


def shop_pages(spark, folder) -> DataFrame:
    """Pages with a price line and, for some, a description tag; every ninth loses its title.

    The pages have neither of their own, so both are made from the page number.
    """
    number = F.col("page_id")
    amount = F.concat(number.cast("string"), F.lit(",25"))
    price = (
        F.when(number % 5 == 0, F.concat(F.lit("<b>€ "), amount, F.lit("</b>")))
        .when(number % 5 == 1, F.concat(F.lit("<i>"), amount, F.lit(" &euro;</i>")))
        .when(number % 5 == 2, F.concat(F.lit("<p>only $"), amount, F.lit("</p><p>or 1.5 €</p>")))
        .when(number % 5 == 3, F.concat(amount, F.lit(" USD")))
        .otherwise("")
    )
    tag = (
        F.when(number % 3 == 0, F.concat(F.lit('<meta name="description" content=" Page '), number.cast("string"), F.lit(' > all">')))
        .when(number % 3 == 1, F.concat(F.lit("<META property='og:description' content='Graph "), number.cast("string"), F.lit("'/>")))
        .otherwise("")
    )
    html = F.replace(F.replace(F.col("html"), F.lit("</article>"), F.concat(price, F.lit("</article>"))), F.lit("</head>"), F.concat(tag, F.lit("</head>")))
    html = F.when(number % 9 == 0, F.regexp_replace(html, "<title>.*?</title>", "")).otherwise(html)
    return fr.table(spark, folder, "pages").select("page_id", "url", html.alias("html"))


_PAGES = """
x AS (SELECT page_id, url, trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&')) AS title,
    html LIKE '%</article>%' AS priced_page, html LIKE '%</head>%' AS headed FROM pages),
facts AS (SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN '' ELSE title END AS name,
    CASE WHEN headed AND page_id % 3 = 0 THEN 'Page ' || page_id || ' > all' WHEN headed AND page_id % 3 = 1 THEN 'Graph ' || page_id END AS description,
    CASE WHEN priced_page AND page_id % 5 <> 4 THEN page_id + 0.25 END AS price FROM x),
kept AS (SELECT * FROM facts WHERE name <> '' OR description IS NOT NULL)"""


@query("extract_pages", fr.with_views(_PAGES) + "SELECT page_id, name, description, CAST(price AS DOUBLE) AS price FROM kept")
def extract_pages(spark, folder):
    return pages.extract_pages(shop_pages(spark, folder)).select("page_id", "name", "description", "price")


@query(
    "page_hosts",
    fr.with_views(_PAGES)
    + """SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, COUNT(*) AS pages, COUNT(description) AS described,
  COUNT(price) AS priced, ROUND(AVG(length(name)), 4) AS avg_name_length FROM kept GROUP BY 1""",
)
def page_hosts(spark, folder):
    return rounded(pages.host_counts(pages.extract_pages(shop_pages(spark, folder))))


@query(
    "export_table",
    fr.with_views(fr.PRODUCTS, fr.SCORES)
    + """SELECT p.id, name, latest.winner_score AS "Winner Score", NULLIF(desire, '') AS "Desire", desire_magnitude AS "Desire Magnitude", awareness_level AS "Awareness Level",
  competition_level AS "Competition Level", date_range AS "Date Range" FROM products p LEFT JOIN latest ON p.id = product_id""",
)
def export_table(spark, folder):
    """Written as CSV and read back, so empty text comes back as missing."""
    path = scratch_path(spark, "export")
    export.write_table(export.export_table(fr.products(spark, folder), fr.scores(spark, folder)), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("id", F.col("id").cast("long")).withColumn("Winner Score", F.col("Winner Score").cast("int"))


@query(
    "rank_report",
    fr.with_views(fr.SCORES)
    + """SELECT p_partkey AS id, p_name AS name, total_score, momentum, margin, summary FROM part JOIN latest ON p_partkey = product_id
ORDER BY total_score DESC, p_partkey LIMIT 10""",
)
def rank_report(spark, folder):
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return export.rank_report(parts, fr.scores(spark, folder)).select("id", "name", "total_score", "momentum", "margin", "summary")


@query(
    "export_analysis",
    fr.with_views(
        fr.PRODUCTS,
        """src AS (SELECT id, CAST(units_sold AS BIGINT) AS u, CAST(round_even(rating, 2) AS DOUBLE) AS r,
    CASE WHEN size % 4 = 0 THEN CAST(round_even(size * 1.0 / 50 * 100, 0) AS BIGINT) WHEN size = 1 THEN 100 WHEN size % 4 = 1 THEN CAST(size AS BIGINT) END AS magnitude FROM products),
ranked AS (SELECT id, (RANK() OVER (ORDER BY u) - 1 + (COUNT(*) OVER (PARTITION BY u) - 1) / 2.0) / (COUNT(*) OVER () - 1) AS up FROM src WHERE u IS NOT NULL),
rated AS (SELECT id, (RANK() OVER (ORDER BY r) - 1 + (COUNT(*) OVER (PARTITION BY r) - 1) / 2.0) / (COUNT(*) OVER () - 1) AS rp FROM src WHERE r IS NOT NULL)""",
    )
    + """SELECT p.id, name, category, CAST(launch_date AS VARCHAR) AS "launch date", CAST(round_even(price, 2) AS DOUBLE) AS price, r AS rating,
  CAST(size * 1000 + 2 * size + 0.5 AS DOUBLE) AS revenue, u AS "items sold", COALESCE(desire, '') AS desire,
  COALESCE(magnitude, CAST(round_even((COALESCE(up, 0.5) + COALESCE(rp, 0.5)) / 2 * 100, 0) AS BIGINT)) AS "desire magnitude",
  CASE size % 3 WHEN 0 THEN 'Solution-aware' WHEN 1 THEN 'Most aware' ELSE '' END AS "awareness level",
  CASE WHEN size > 1 AND size < 35 THEN 'Low' WHEN size > 1 AND size < 70 THEN 'Medium' ELSE 'High' END AS "competition level"
FROM products p JOIN src ON p.id = src.id LEFT JOIN ranked ON p.id = ranked.id LEFT JOIN rated ON p.id = rated.id WHERE launch_date IS NOT NULL
UNION ALL
SELECT p.id, name, category, '', CAST(round_even(price, 2) AS DOUBLE), r,
  CAST(size * 1000 + 2 * size + 0.5 AS DOUBLE), u, COALESCE(desire, ''),
  COALESCE(magnitude, CAST(round_even((COALESCE(up, 0.5) + COALESCE(rp, 0.5)) / 2 * 100, 0) AS BIGINT)),
  CASE size % 3 WHEN 0 THEN 'Solution-aware' WHEN 1 THEN 'Most aware' ELSE '' END,
  CASE WHEN size > 1 AND size < 35 THEN 'Low' WHEN size > 1 AND size < 70 THEN 'Medium' ELSE 'High' END
FROM products p JOIN src ON p.id = src.id LEFT JOIN ranked ON p.id = ranked.id LEFT JOIN rated ON p.id = rated.id WHERE launch_date IS NULL""",
)
def export_analysis(spark, folder):
    products = fr.products(spark, folder)
    size = F.col("size")
    extra = F.map_filter(
        F.create_map(
            F.lit("Price($)"), F.concat(F.lit("$"), F.format_number("price", 4)),
            F.lit("Product Rating"), F.col("rating").cast("string"),
            F.lit("Item Sold"), F.format_number(F.col("units_sold").cast("long"), 0),
            F.lit("Revenue($)"), F.concat(size.cast("string"), F.lit("k")),
            F.lit("live revenue"), size.cast("string"),
            F.lit("Video Revenue($)"), F.concat(F.lit("$"), size.cast("string")),
            F.lit("shoppingmallrevenue"), F.lit("0.50"),
            F.lit("Launch Date"), F.date_format("launch_date", "dd/MM/yyyy"),
            F.lit("desire_score"), F.when(size % 4 == 0, (size / 50).cast("string")),
            F.lit("Desire Mag"), F.when(size % 4 == 1, size.cast("string")),
            F.lit("awareness_level"), F.when(size % 3 == 0, "2").when(size % 3 == 1, "1.0").otherwise("n/a"),
            F.lit("Competition"), size.cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    rows = products.select("id", "name", "category", "desire", extra.alias("extra"))
    out = export.export_analysis(rows)
    return out.drop("image preview", "TikTokUrl", "KalodataUrl", "Img_url")
