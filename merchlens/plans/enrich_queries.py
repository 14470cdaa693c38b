"""Enrichment bookkeeping, response checks, job metrics and streams over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.text import cache_key, signature
from merchlens.operators import enrich, jobs, merge, validate
from merchlens.plans import frames as fr
from merchlens.plans.catalog_queries import _LOW_QUALITY, SIG
from merchlens.plans.registry import query
from merchlens.plans.trend_queries import rounded
from merchlens.session import hadoop_path, scratch_path
from merchlens.streaming import jobs as streams

# white space as the library strips it, and a text without units and pack words
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '(?i)\b({units})\b', '', 'g'), '(?i)\b(set|kit|pack|x\d+)\b', '', 'g'), '\s{2,}', ' ', 'g'), '^[ ,;.\-]+|[ ,;.\-]+$', '', 'g')""".replace(
    "{units}", "|".join(vocab.UNIT_WORDS)
)

# --- cache ------------------------------------------------------------------------------


@query(
    "cache_lookup",
    fr.with_views(fr.ITEMS, fr.CACHE)
    + """SELECT job_id, COUNT(*) AS items, COUNT(sig) AS hits, CAST(SUM(cached_desire) AS BIGINT) AS desire_sum
FROM items LEFT JOIN (SELECT sig_hash AS sig, cached_desire FROM cache WHERE updated_at >= TIMESTAMP '2002-01-01' - to_days(30)) ON sig = sig_hash
GROUP BY job_id""",
)
def cache_lookup(spark, folder):
    found = enrich.cache_lookup(fr.items(spark, folder), fr.cache(spark, folder), fr.NOW)
    return found.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("hit").alias("hits"), F.sum("cached_desire").alias("desire_sum")
    )


@query(
    "cache_key",
    """SELECT p_partkey AS id, sha256('v1::{"category": "' || p_type || '", "desc": "say \\"' || p_brand || '\\"", "title": "' || p_name || '"}') AS key FROM part""",
)
def cache_key_query(spark, folder):
    return fr.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        cache_key("v1", title=F.col("p_name"), category=F.col("p_type"), desc=F.concat(F.lit('say "'), F.col("p_brand"), F.lit('"'))).alias("key"),
    )


@query(
    "cache_misses",
    fr.with_views(fr.ITEMS, fr.CACHE)
    + """SELECT item_id, job_id FROM items
WHERE sig_hash NOT IN (SELECT sig_hash FROM cache WHERE updated_at >= TIMESTAMP '2002-01-01' - to_days(30))""",
)
def cache_misses(spark, folder):
    return enrich.cache_misses(fr.items(spark, folder), fr.cache(spark, folder), fr.NOW).select("item_id", "job_id")


_CACHED_TEXTS = f"""
texts AS (SELECT id, COALESCE(NULLIF({_CLEAN}, ''), d) AS body, title FROM (
  SELECT doc_id AS id, trim(text, {_WHITE}) AS d, p_name AS title, sig, doc_id % 2 AS version,
    ROW_NUMBER() OVER (PARTITION BY sig, doc_id % 2 ORDER BY doc_id DESC) AS rn
  FROM documents JOIN (SELECT p_partkey, p_name, {SIG} AS sig FROM part) ON doc_id = p_partkey) WHERE rn = 1),
keyed AS (SELECT doc_id AS id, {SIG} AS sig, doc_id % 2 AS version FROM documents JOIN part ON doc_id = p_partkey)"""


@query(
    "cache_lookup_versioned",
    fr.with_views(_CACHED_TEXTS, _LOW_QUALITY)
    + f""", usable AS (SELECT sig, version, id AS doc FROM keyed JOIN low USING (id) WHERE NOT low_quality)
SELECT p_partkey AS id, doc IS NOT NULL AS hit FROM part LEFT JOIN usable ON sig = {SIG} AND version = p_size % 2""",
)
def cache_lookup_versioned(spark, folder):
    """Cache keyed by signature, model and version; a hit needs a text of good quality."""
    parts = fr.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
        (F.col("p_size") % 2).cast("long").alias("version"),
    )
    docs = fr.table(spark, folder, "documents").join(parts, F.col("doc_id") == F.col("id")).select(
        "sig_hash", (F.col("doc_id") % 2).alias("version"), "doc_id", F.col("text").alias("cached_text"),
    )
    cache = merge.dedup_last(docs, ["sig_hash", "version"], "doc_id").withColumn("model", F.lit("m1"))
    found = enrich.cache_lookup(
        parts.withColumn("model", F.lit("m1")), cache, fr.NOW, None, ["sig_hash", "model", "version"],
        enrich.good_cached_text("cached_text", "title"), ["title"],
    )
    return found.select("id", "hit")


@query(
    "cache_upsert",
    fr.with_views(fr.CACHE)
    + f""", fresh AS (SELECT * FROM (SELECT {SIG} AS sig_hash, CAST(p_size AS BIGINT) * 100 AS cached_desire,
    ROW_NUMBER() OVER (PARTITION BY {SIG} ORDER BY p_partkey DESC) AS rn FROM part JOIN labels ON p_partkey = doc_id) WHERE rn = 1)
SELECT COALESCE(f.sig_hash, c.sig_hash) AS sig_hash, COALESCE(f.cached_desire, c.cached_desire) AS cached_desire
FROM cache c FULL OUTER JOIN fresh f ON c.sig_hash = f.sig_hash""",
)
def cache_upsert(spark, folder):
    """Fresh entries come from the parts that have labels."""
    labelled = fr.table(spark, folder, "labels").select(F.col("doc_id").alias("p_partkey"))
    fresh = fr.table(spark, folder, "part").join(labelled, "p_partkey").select(
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
        (F.col("p_size").cast("long") * 100).alias("cached_desire"),
        F.timestamp_add("SECOND", F.col("p_partkey"), F.lit(fr.NOW)).alias("updated_at"),
    )
    return merge.cache_upsert(fr.cache(spark, folder), fresh, ["sig_hash"], "updated_at").select("sig_hash", "cached_desire")


# --- variants, triage, batches, budget --------------------------------------------------

_VARIANT = r"""substr(trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '[\W_]+', ' ', 'g')), '(?i){words}', '', 'g'), '\s+', ' ', 'g')), 1, 24)""".replace(
    "{words}", vocab.VARIANT_WORDS
)


@query(
    "propagate_variants",
    f"""WITH t AS (SELECT p_partkey AS id, p_brand || ' / ' || p_name || ' ' || p_size || ' cm' AS title,
    CASE WHEN p_size % 3 = 0 THEN 'High' END AS desire_magnitude, CASE WHEN p_size % 3 = 0 THEN p_type END AS desire FROM part),
k AS (SELECT *, {_VARIANT} AS group_key FROM t),
lead AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_key ORDER BY coalesce(desire, desire_magnitude) IS NULL, id) AS rn FROM k) WHERE rn = 1)
SELECT k.id, k.group_key, lead.id AS representative,
  CASE WHEN coalesce(k.desire, k.desire_magnitude) IS NOT NULL OR k.id < lead.id THEN k.desire ELSE lead.desire END AS desire,
  CASE WHEN coalesce(k.desire, k.desire_magnitude) IS NOT NULL OR k.id < lead.id THEN k.desire_magnitude ELSE lead.desire_magnitude END AS desire_magnitude
FROM k JOIN lead ON k.group_key = lead.group_key""",
)
def propagate_variants(spark, folder):
    scored = F.col("p_size") % 3 == 0
    rows = fr.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" cm")).alias("title"),
        F.when(scored, F.col("p_type")).alias("desire"), F.when(scored, "High").alias("desire_magnitude"),
    )
    return enrich.propagate_variants(rows, ["desire", "desire_magnitude"])


@query(
    "triage",
    fr.with_views(fr.PRODUCTS)
    + """SELECT id, CASE WHEN low THEN 'failed' ELSE 'pending_enrich' END AS state, CASE WHEN low THEN 'skipped_by_triage' END AS error FROM (
  SELECT id, COALESCE(COALESCE(CASE WHEN size % 2 = 0 THEN size / 10.0 END, rating) < 3, FALSE) OR COALESCE(units_sold < 700, FALSE)
    OR date_diff('day', COALESCE(CASE WHEN size % 4 <> 0 THEN last_seen END, first_seen), DATE '2002-01-01') > 540 AS low FROM products)""",
)
def triage(spark, folder):
    size = F.col("size")
    rows = fr.products(spark, folder).select(
        "id",
        F.when(size % 2 == 0, F.replace((size / 10).cast("string"), F.lit("."), F.lit(","))).otherwise("unknown").alias("stars"),
        "rating", "units_sold",
        F.when(size % 4 != 0, F.date_format("last_seen", "dd/MM/yyyy")).otherwise("soon").alias("released"),
        "first_seen",
    )
    rules = enrich.TriageRules(units_below=700)
    marked = enrich.triage(rows, fr.AS_OF, ["stars", "rating"], ["units_sold"], ["released", "first_seen"], rules)
    return enrich.skipped_by_triage(marked, exhaustive=False).select("id", "state", "error")


@query(
    "plan_batches",
    """WITH r AS (SELECT doc_id, length(text) AS chars, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT pos // 24 AS batch_no, COUNT(*) AS items, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id,
  CAST(ceil(SUM(chars) / 4.0) AS BIGINT) AS est_tokens FROM r GROUP BY 1""",
)
def plan_batches(spark, folder):
    return enrich.plan_batches(fr.table(spark, folder, "documents"), 24, F.length("text"), "doc_id")


_QUEUE = """q AS (SELECT o_orderkey AS queue_no, o_orderstatus = 'P' AS low_priority, CAST(floor(o_totalprice / 100) AS BIGINT) AS est_tokens FROM orders),
c AS (SELECT *, SUM(CAST(greatest(est_tokens, 1) * 15 AS DECIMAL(28,6)) / 1000) OVER w AS spent, COUNT(*) OVER w AS request_no FROM q {where}
  WINDOW w AS (ORDER BY low_priority, queue_no ROWS UNBOUNDED PRECEDING))
SELECT queue_no, ROUND(CAST(spent AS DOUBLE), 3) AS cumulative_cost, request_no, CAST(spent AS DOUBLE) <= {cost} AND request_no <= {requests} AS admitted FROM c"""


def queue(spark, folder) -> DataFrame:
    return fr.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("queue_no"), (F.col("o_orderstatus") == "P").alias("low_priority"),
        F.floor(F.col("o_totalprice") / 100).alias("est_tokens"),
    )


@query("budget_admission", "WITH " + _QUEUE.format(where="WHERE NOT low_priority", cost="200000", requests="1e18"))
def budget_admission(spark, folder):
    out = enrich.budget_admission(queue(spark, folder), max_cost=200000.0)
    return rounded(out.select("queue_no", "cumulative_cost", "request_no", "admitted"), 3)


@query("budget_admission_exhaustive", "WITH " + _QUEUE.format(where="", cost="1e18", requests="11000"))
def budget_admission_exhaustive(spark, folder):
    out = enrich.budget_admission(queue(spark, folder), max_requests=11000, exhaustive=True)
    return rounded(out.select("queue_no", "cumulative_cost", "request_no", "admitted"), 3)


# --- results ----------------------------------------------------------------------------


def _results(spark, folder) -> DataFrame:
    """Answers for the parts that have a document; its text is the reason."""
    docs = fr.table(spark, folder, "documents").select("doc_id", "text")
    parts = fr.table(spark, folder, "part")
    return parts.join(docs, F.col("p_partkey") == F.col("doc_id")).select(
        F.col("p_partkey").alias("id"),
        (F.col("p_size") * 3 - 10).cast("string").alias("desire"),
        F.when(F.col("p_size") % 5 == 0, "lots").otherwise((F.col("p_size") + 0.9).cast("string")).alias("awareness"),
        F.col("text").alias("reason"),
    )


_APPLIED = f"""
res AS (SELECT p_partkey AS item_id, least(100, greatest(0, p_size * 3 - 10)) AS desire,
    CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS awareness, trim(COALESCE(text, ''), {_WHITE}) AS body
  FROM part JOIN documents ON p_partkey = doc_id),
applied AS (SELECT i.item_id, i.sig_hash, CASE WHEN res.item_id IS NULL THEN 'failed' ELSE 'enriched' END AS state,
    CASE WHEN res.item_id IS NULL THEN 'missing_result' END AS error, desire, awareness,
    CASE WHEN length(body) > 120 THEN rtrim(substr(body, 1, 117), {_WHITE}) || '...' ELSE body END AS reason
  FROM items i LEFT JOIN res ON i.item_id = res.item_id)"""


@query(
    "apply_results",
    fr.with_views(fr.ITEMS, _APPLIED)
    + "SELECT item_id, state, error, CAST(desire AS BIGINT) AS desire, CAST(awareness AS BIGINT) AS awareness, reason FROM applied",
)
def apply_results(spark, folder):
    out = enrich.apply_results(fr.items(spark, folder), _results(spark, folder))
    return out.select("item_id", "state", "error", "desire", "awareness", "reason")


@query(
    "store_results",
    fr.with_views(fr.ITEMS, fr.CACHE, _APPLIED)
    + """, per_sig AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sig_hash ORDER BY item_id DESC) AS rn FROM applied WHERE state = 'enriched') WHERE rn = 1)
SELECT 'products' AS target, COUNT(*) AS rows, CAST(SUM(desire) AS BIGINT) AS desire_sum FROM signed_parts LEFT JOIN per_sig USING (sig_hash)
UNION ALL SELECT 'cache', COUNT(*), CAST(SUM(CASE WHEN per_sig.sig_hash IS NOT NULL THEN desire ELSE cached_desire END) AS BIGINT)
FROM cache FULL OUTER JOIN per_sig ON cache.sig_hash = per_sig.sig_hash""",
)
def store_results(spark, folder):
    applied = enrich.apply_results(fr.items(spark, folder), _results(spark, folder))
    products = fr.signed_parts(spark, folder).select(
        "id", "sig_hash", F.lit(None).cast("long").alias("desire"), F.lit(None).cast("long").alias("awareness"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("timestamp").alias("completed_at"),
    )
    cache = fr.cache(spark, folder).select(
        "sig_hash", F.col("cached_desire").alias("desire"), F.lit(None).cast("long").alias("awareness"),
        F.lit(None).cast("string").alias("reason"), "updated_at",
    )
    after, cached = enrich.store_results(products, cache, applied, F.lit(fr.NOW))
    totals = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.sum("desire").alias("desire_sum")).select(
            F.lit(name).alias("target"), "rows", "desire_sum"
        )
        for name, df in (("products", after), ("cache", cached))
    ]
    return totals[0].unionAll(totals[1])


@query(
    "route_by_confidence",
    """WITH r AS (SELECT CASE WHEN quality = 1 THEN COALESCE(CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100) / 100.0 END, (doc_id % 10) / 10.0) END AS c FROM labels)
SELECT COUNT(*) FILTER (c >= 0.7) AS covered, COUNT(*) FILTER (c IS NULL OR c < 0.7) AS fallback FROM r""",
)
def route_by_confidence(spark, folder):
    key, good = F.col("doc_id"), F.col("quality") == 1
    audit = F.when(good & (key % 3 == 0), (key % 100) / 100)
    top = F.when(good, (key % 10) / 10)
    return enrich.route_counts(enrich.route_by_confidence(fr.table(spark, folder, "labels"), audit, top))


@query(
    "advance_state",
    fr.with_views(fr.ITEMS)
    + """, ch AS (SELECT p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN 'pending_enrich' WHEN 1 THEN 'enriched' ELSE 'failed' END AS t FROM part)
SELECT job_id, state, COUNT(*) AS items FROM (SELECT job_id, CASE WHEN state = 'raw' AND t = 'pending_enrich' THEN t
    WHEN state = 'pending_enrich' AND t IN ('enriched', 'failed') THEN t ELSE state END AS state FROM items LEFT JOIN ch USING (item_id)) GROUP BY 1, 2""",
)
def advance_state(spark, folder):
    step = F.col("p_size") % 3
    to = F.when(step == 0, "pending_enrich").when(step == 1, "enriched").otherwise("failed")
    changes = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), to.alias("state"))
    moved = enrich.advance_state(fr.items(spark, folder), changes)
    return moved.groupBy("job_id", "state").agg(F.count(F.lit(1)).alias("items"))


# --- response checks --------------------------------------------------------------------


def expected_ids(spark, folder) -> DataFrame:
    return fr.table(spark, folder, "part").select(
        F.floor(F.col("p_partkey") / 4).alias("batch_id"), F.col("p_partkey").alias("product_id")
    )


def response_lines(spark, folder) -> DataFrame:
    """One JSON line per part in batches of four; some sizes break a rule each."""
    size, key = F.col("p_size"), F.col("p_partkey")
    number = F.when(size == 46, key - key % 4 + (key + 1) % 4).when(size == 45, key + 1000000).otherwise(key).cast("string")
    good = F.concat(
        F.lit('{"product_id": '), number, F.lit(', "desire": "'), F.col("p_name"),
        F.lit('", "desire_magnitude": '), size.cast("string"), F.lit(', "awareness_level": "Low", "competition_level": null}'),
    )
    line = (
        F.when(size == 49, F.concat(F.lit("not json "), F.col("p_name")))
        .when(size == 48, '{"desire": "x", "desire_magnitude": 1, "awareness_level": "Low", "competition_level": "Low"}')
        .when(size == 47, F.concat(F.lit('{"product_id": '), key.cast("string"), F.lit(', "desire": "x"}')))
        .otherwise(good)
    )
    return fr.table(spark, folder, "part").where(size != 50).select(
        F.floor(key / 4).alias("batch_id"), key.alias("line_no"), F.concat(F.lit("  "), line).alias("line")
    )


_LINES = """
got AS (SELECT p_partkey // 4 AS batch_id, p_size, CASE WHEN p_size IN (49, 48) THEN NULL WHEN p_size = 46 THEN p_partkey - p_partkey % 4 + (p_partkey + 1) % 4
    WHEN p_size = 45 THEN p_partkey + 1000000 ELSE p_partkey END AS product_id FROM part WHERE p_size <> 50),
want AS (SELECT p_partkey // 4 AS batch_id, p_partkey AS product_id FROM part),
ids AS (SELECT batch_id, product_id, COUNT(*) AS times FROM got WHERE product_id IS NOT NULL GROUP BY 1, 2),
sides AS (SELECT COALESCE(want.batch_id, ids.batch_id) AS batch_id, want.product_id AS w, ids.product_id AS g, times
  FROM want FULL OUTER JOIN ids ON want.batch_id = ids.batch_id AND want.product_id = ids.product_id),
s AS (SELECT batch_id, COUNT(w) AS expected, COUNT(*) FILTER (times > 1) AS dup, COUNT(*) FILTER (g IS NULL) AS missing, COUNT(*) FILTER (w IS NULL) AS extra FROM sides GROUP BY 1),
l AS (SELECT batch_id, COUNT(*) AS lines, COUNT(*) FILTER (p_size = 49) AS bad, COUNT(*) FILTER (p_size = 48) AS noid, COUNT(*) FILTER (p_size = 47) AS inc FROM got GROUP BY 1),
v AS (SELECT s.batch_id, expected, COALESCE(lines, 0) AS lines, missing, extra, CASE WHEN COALESCE(lines, 0) <> expected THEN 'length' WHEN bad > 0 THEN 'invalid_json'
   WHEN noid > 0 THEN 'missing_product_id' WHEN dup > 0 THEN 'duplicate_product_id' WHEN inc > 0 THEN 'missing_field' WHEN missing + extra > 0 THEN 'id_set' END AS reason
  FROM s LEFT JOIN l USING (batch_id))"""


@query("validate_responses", fr.with_views(_LINES) + "SELECT batch_id, expected, lines, missing, extra, reason IS NULL AS valid, reason FROM v")
def validate_responses(spark, folder):
    return validate.validate_responses(response_lines(spark, folder), expected_ids(spark, folder))


@query(
    "validate_responses_lenient",
    fr.with_views(_LINES) + "SELECT batch_id, product_id FROM want WHERE (batch_id, product_id) NOT IN (SELECT batch_id, product_id FROM ids)",
)
def validate_responses_lenient(spark, folder):
    return validate.missing_responses(response_lines(spark, folder), expected_ids(spark, folder), "line_no")


@query(
    "normalise_responses",
    f"""WITH raw AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN ' MEDIUM ' WHEN 2 THEN 'High' ELSE 'none' END AS aw,
    doc_id % 103 AS aw_m, doc_id % 101 AS d_m, doc_id % 100 AS c_m, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 11) / 10.0 END AS confidence,
    text || ' 30 ml kit x2.' AS d FROM documents),
e AS (SELECT *, CASE WHEN aw_m > 100 THEN 'aw_m' WHEN confidence IS NOT NULL AND confidence > 1 THEN 'confidence' WHEN id % 4 = 3 THEN 'aw' END AS error FROM raw)
SELECT id, error, CASE WHEN error IS NULL THEN COALESCE(NULLIF({_CLEAN}, ''), trim(d, {_WHITE}), '') END AS desire,
  CASE WHEN error IS NULL THEN CASE WHEN d_m <= 33 THEN 'Low' WHEN d_m >= 67 THEN 'High' ELSE 'Medium' END END AS desire_magnitude,
  CASE WHEN error IS NULL THEN CASE id % 4 WHEN 0 THEN CASE WHEN aw_m <= 10 THEN 'Unaware' ELSE 'Problem-Aware' END WHEN 1 THEN 'Solution-Aware'
    ELSE CASE WHEN aw_m >= 90 THEN 'Most Aware' ELSE 'Product-Aware' END END END AS awareness_level,
  CASE WHEN error IS NULL THEN CASE WHEN c_m <= 33 THEN 'Low' WHEN c_m >= 67 THEN 'High' ELSE 'Medium' END END AS competition_level FROM e""",
)
def normalise_responses(spark, folder):
    key = F.col("doc_id")
    aw = F.when(key % 4 == 0, "low").when(key % 4 == 1, " MEDIUM ").when(key % 4 == 2, "High").otherwise("none")
    rows = fr.table(spark, folder, "documents").select(
        key.alias("id"), aw.alias("aw"), (key % 103).cast("string").alias("aw_m"),
        F.concat(F.col("text"), F.lit(" 30 ml kit x2.")).alias("d"), (key % 101).cast("string").alias("d_m"),
        F.lit("medium").alias("c"), (key % 100).cast("string").alias("c_m"),
        F.when(key % 7 != 0, ((key % 11) / 10).cast("string")).alias("confidence"),
    )
    return validate.normalise_responses(rows).select(
        "id", "error", "desire", "desire_magnitude", "awareness_level", "competition_level"
    )


# --- job metrics ------------------------------------------------------------------------

EV = fr.with_views(fr.EVENTS)


@query(
    "job_status_counts",
    fr.with_views(fr.ITEMS)
    + """, c AS (SELECT job_id, COUNT(*) AS total, COUNT(*) FILTER (state = 'enriched') AS enriched, COUNT(*) FILTER (state = 'failed') AS failed,
  COUNT(*) FILTER (state = 'pending_enrich') AS queued, SUM(CAST(amount AS DECIMAL(18,2))) FILTER (state IN ('enriched', 'failed')) AS ms FROM items GROUP BY 1)
SELECT job_id, total, enriched, failed, queued, enriched + failed AS processed,
  ROUND(queued / ((enriched + failed) / (CAST(ms AS DOUBLE) / 1000)), 3) AS eta_estimate FROM c""",
)
def job_status_counts(spark, folder):
    rows = fr.items(spark, folder)
    durations = rows.where(F.col("state").isin("enriched", "failed")).groupBy("job_id").agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_duration_ms")
    )
    return rounded(jobs.job_status_counts(rows, durations).drop("total_duration_ms"), 3)


@query(
    "batch_metrics",
    EV + """SELECT user_id AS job_id, k // 10 AS batch_no, COUNT(*) AS rows, ROUND(SUM(value), 3) AS duration_ms, ROUND(COUNT(*) * 1000 / SUM(value), 3) AS throughput
FROM ev GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 500""",
)
def batch_metrics(spark, folder):
    facts = fr.events(spark, folder).select(
        F.col("user_id").alias("job_id"), F.floor(F.col("k") / 10).alias("batch_no"), F.col("value").alias("duration_ms")
    )
    out = jobs.recent_metrics(jobs.batch_metrics(facts), 500)
    return rounded(out, 3)


@query(
    "import_history",
    """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
)
def import_history(spark, folder):
    rows = fr.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")
    )
    return jobs.import_history(rows)


@query(
    "recent_metrics",
    EV + """SELECT user_id AS job_id, k // 10 AS batch_no, COUNT(*) AS rows, MAX(ts) AS created_at
FROM ev GROUP BY 1, 2 ORDER BY created_at DESC, 1 DESC, 2 DESC LIMIT 50""",
)
def recent_metrics(spark, folder):
    batches = fr.events(spark, folder).groupBy(F.col("user_id").alias("job_id"), F.floor(F.col("k") / 10).alias("batch_no"))
    return jobs.recent_metrics(batches.agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("created_at")), newest="created_at")


@query(
    "latency_summary",
    EV + """SELECT event_type, COUNT(*) AS requests, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.95), 6) AS p95,
  ROUND(CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 3) AS total,
  CAST(round_even(CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / 3600, 2) AS DOUBLE) AS concurrency_eff FROM ev GROUP BY 1""",
)
def latency_summary(spark, folder):
    rows = fr.events(spark, folder).select("event_type", "value")
    out = jobs.latency_summary(rows, "value", 3600.0, ["event_type"])
    return rounded(out.withColumn("total", F.round("total", 3)), 6)


@query(
    "duration_estimate",
    EV + """, runs AS (SELECT event_id, k * 3 AS total, value * 100 AS ms FROM ev WHERE k > 0),
b AS (SELECT *, CASE WHEN total <= 10 THEN 10 WHEN total <= 25 THEN 25 WHEN total <= 50 THEN 50 WHEN total <= 100 THEN 100 WHEN total <= 250 THEN 250 ELSE 500 END AS bucket FROM runs),
n AS (SELECT bucket, ms / total AS per_item, ROW_NUMBER() OVER (PARTITION BY bucket ORDER BY event_id DESC) AS rn FROM b),
m AS (SELECT bucket, quantile_cont(per_item, 0.5) AS ms_per_item, COUNT(*) AS runs FROM n WHERE rn <= 25 GROUP BY 1)
SELECT bucket, ROUND(COALESCE(ms_per_item, 2500), 4) AS ms_per_item, COALESCE(runs, 0) AS runs FROM (SELECT unnest([10, 25, 50, 100, 250, 500]) AS bucket) LEFT JOIN m USING (bucket)""",
)
def duration_estimate(spark, folder):
    runs = fr.events(spark, folder).select(
        F.col("event_id").alias("run_id"), (F.col("k") * 3).alias("total"), (F.col("value") * 100).alias("duration_ms")
    )
    return rounded(jobs.duration_estimate(runs))


# event numbers stand for reasons as they are logged
REASONS = [
    "", "Missing_API_Key for provider", "job hit COST_CAP", "HTTP 429 Too Many Requests", "request timed out", "SSL handshake failed",
    "invalid or broken JSON in answer", "401 unauthorized", "403 Forbidden", "model not found (404)", "missing product in answer", "503 bad gateway", "something else",
]


@query(
    "failure_summary",
    EV + f""", r AS (SELECT event_id, lower([{", ".join(f"'{r}'" for r in REASONS)}][k % {len(REASONS)} + 1]) AS t FROM ev),
c AS (SELECT event_id, CASE WHEN t = '' THEN 'ko.unknown' """
    + " ".join(
        "WHEN " + " AND ".join("(" + " OR ".join(f"contains(t, '{w}')" for w in g) + ")" for g in groups) + f" THEN '{code}'"
        for code, _, groups in vocab.FAILURE_RULES
    )
    + """ ELSE 'ko.unclassified' END AS code FROM r),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY event_id) AS rn FROM c)
SELECT code, COUNT(*) AS count, code NOT IN ('auth.missing_api_key', 'quota.cost_cap_reached', 'auth.unauthorized', 'auth.forbidden', 'remote.not_found') AS retryable,
  CASE code """
    + " ".join(f"WHEN '{code}' THEN '{message}'" for code, (message, _) in vocab.FAILURE_TEXTS.items())
    + " END AS message, CASE code "
    + " ".join(f"WHEN '{code}' THEN '{remedy}'" for code, (_, remedy) in vocab.FAILURE_TEXTS.items())
    + """ END AS remedy,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (rn <= 5) AS sample_ids FROM n GROUP BY code""",
)
def failure_summary(spark, folder):
    reasons = F.array(*[F.lit(r) for r in REASONS])
    rows = fr.events(spark, folder).select(
        F.col("event_id").alias("id"), F.element_at(reasons, (F.col("k") % len(REASONS) + 1).cast("int")).alias("reason")
    )
    out = jobs.failure_summary(rows)
    return out.withColumn("sample_ids", F.array_join(F.transform("sample_ids", lambda i: i.cast("string")), ","))


@query(
    "usage_cost",
    EV + """, u AS (SELECT event_type, CASE k % 4 WHEN 0 THEN k * 10 WHEN 1 THEN k * 20 WHEN 2 THEN k * 30 ELSE k * 40 END AS tin,
   CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k * 30 - k * 20 WHEN 2 THEN k * 2 ELSE 0 END AS tout FROM ev)
SELECT event_type, CAST(SUM(tin) AS DOUBLE) AS tokens_in, CAST(SUM(tout) AS DOUBLE) AS tokens_out, ROUND(SUM(tin) / 1e6 * 2.5 + SUM(tout) / 1e6 * 10, 6) AS cost FROM u GROUP BY 1""",
)
def usage_cost(spark, folder):
    k = F.col("k")

    def only(case: int, value):
        return F.when(k % 4 == case, value)

    rows = fr.events(spark, folder).select(
        "event_type", only(0, k * 10).alias("prompt_tokens"), only(0, k).alias("completion_tokens"),
        only(1, k * 20).alias("input_tokens"), only(2, k * 30).alias("tokens_in"), only(2, k * 2).alias("tokens_out"),
        F.when(k % 4 == 1, k * 30).when(k % 4 == 3, k * 40).alias("total_tokens"),
    )
    return rounded(jobs.usage_totals(jobs.usage_cost(rows, 2.5, 10.0), ["event_type"]), 6)


@query(
    "expire_stale_jobs",
    """SELECT status, error, COUNT(*) AS jobs FROM (SELECT CASE WHEN stale THEN 'error' ELSE status END AS status, CASE WHEN stale THEN 'server restarted' END AS error
  FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status,
    o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '2000-01-01' - INTERVAL 1440 MINUTE AS stale FROM orders)) GROUP BY 1, 2""",
)
def expire_stale_jobs(spark, folder):
    rows = fr.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("string").alias("error"),
    )
    out = jobs.expire_stale_jobs(rows, datetime(2000, 1, 1), 1440)
    return out.groupBy("status", "error").agg(F.count(F.lit(1)).alias("jobs"))


# --- streams ----------------------------------------------------------------------------


def stream_of(spark, folder, name) -> DataFrame:
    """A table as a stream of files."""
    schema = fr.table(spark, folder, name).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    # watermarks need a time zone
    zoned = {c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"}
    return rows.withColumns(zoned) if zoned else rows


@query(
    "stream_ingest",
    f"""SELECT id, sig_hash, winner_score FROM (SELECT p_partkey AS id, {SIG} AS sig_hash, COALESCE(CASE WHEN p_size % 3 <> 0 THEN p_size END, 0) AS winner_score,
  ROW_NUMBER() OVER (PARTITION BY {SIG} ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1""",
)
def stream_ingest(spark, folder):
    staged = stream_of(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("winner_score"),
        F.col("p_partkey").alias("seq"),
    )
    root = scratch_path(spark, "ingested")
    streams.stream_ingest(staged, root, scratch_path(spark, "state")).awaitTermination()
    return merge.read_merged(spark, root, "sig_hash", {"winner_score": 0}, ["id"])


@query(
    "stream_checkpoint_anew",
    f"""SELECT id, sig_hash, winner_score FROM (SELECT p_partkey AS id, {SIG} AS sig_hash, COALESCE(CASE WHEN p_size % 3 <> 0 THEN p_size END, 0) AS winner_score,
  ROW_NUMBER() OVER (PARTITION BY {SIG} ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1
UNION ALL SELECT s_suppkey, 'supplier ' || s_suppkey, 1 FROM supplier""",
)
def stream_checkpoint_anew(spark, folder):
    """Two streams into one table, the second with a checkpoint made anew at the first one's path."""
    parts = stream_of(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("winner_score"),
        F.col("p_partkey").alias("seq"),
    )
    suppliers = stream_of(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("sig_hash"),
        F.lit(1).alias("winner_score"), F.col("s_suppkey").alias("seq"),
    )
    root, state = scratch_path(spark, "ingested"), scratch_path(spark, "state")
    for stream in (parts, suppliers):
        streams.stream_ingest(stream, root, state).awaitTermination()
        path, files = hadoop_path(spark, state)
        files.delete(path, True)
    return merge.read_merged(spark, root, "sig_hash", {"winner_score": 0}, ["id"])


@query(
    "stream_latest",
    f"""SELECT id, sig_hash, seq FROM (SELECT p_partkey AS id, {SIG} AS sig_hash, p_size AS seq,
  ROW_NUMBER() OVER (PARTITION BY {SIG} ORDER BY p_size DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1""",
)
def stream_latest(spark, folder):
    """The row of the highest number per key from two streams, the second of which repeats the first's rows."""
    rows = stream_of(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash"),
        (F.col("p_size").cast("long") * 10**9 + F.col("p_partkey")).alias("seq"),
    )
    root = scratch_path(spark, "latest")
    for _ in range(2):
        streams.stream_latest(rows, root, scratch_path(spark, "state")).awaitTermination()
    last = merge.read_merged(spark, root)
    return last.withColumn("seq", F.floor(F.col("seq") / 10**9).cast("int"))


def _bucket_sql(unit: str, days: int) -> str:
    return EV + f"""SELECT CAST(CAST(date_trunc('{unit}', ts) AS DATE) AS VARCHAR) AS date, COUNT(*) AS rows, CAST(SUM(k) AS DOUBLE) AS units,
  ROUND(SUM(value), 4) AS revenue FROM ev
WHERE date_trunc('{unit}', ts) + to_days({days}) <= (SELECT MAX(ts) FROM ev) - to_days(1) GROUP BY 1"""


def _event_stream(spark, folder) -> DataFrame:
    return stream_of(spark, folder, "events").select(
        "ts", F.get_json_object("props", "$.k").cast("double").alias("units"), F.col("value").alias("revenue")
    )


def _buckets(spark, folder, weekly: bool) -> DataFrame:
    out = streams.run_to_files(
        streams.stream_trends(_event_stream(spark, folder), weekly=weekly), scratch_path(spark, "buckets"), scratch_path(spark, "state")
    )
    return rounded(out.withColumn("date", F.col("date").cast("string")))


@query("stream_trends_daily", _bucket_sql("day", 1))
def stream_trends_daily(spark, folder):
    """Days that the watermark has closed."""
    return _buckets(spark, folder, weekly=False)


@query("stream_trends_weekly", _bucket_sql("week", 7))
def stream_trends_weekly(spark, folder):
    return _buckets(spark, folder, weekly=True)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, folder):
    rows = stream_of(spark, folder, "events").select("ts", "user_id", "event_type")
    first = streams.stream_dedup(rows, ["user_id", "event_type"], delay="60 days").select("user_id", "event_type")
    return streams.run_to_files(first, scratch_path(spark, "firsts"), scratch_path(spark, "state"))


@query(
    "stream_enrich_lookup",
    fr.with_views(fr.CACHE)
    + f"""SELECT p_partkey AS id, sig IS NOT NULL AS hit, cached_desire FROM part
LEFT JOIN (SELECT sig_hash AS sig, cached_desire FROM cache WHERE updated_at >= TIMESTAMP '2002-01-01' - to_days(30)) ON sig = {SIG}""",
)
def stream_enrich_lookup(spark, folder):
    rows = stream_of(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), signature(F.col("p_name"), F.col("p_brand"), F.lit(None), F.lit(None)).alias("sig_hash")
    )
    found = streams.stream_enrich_lookup(rows, fr.cache(spark, folder), fr.NOW).select("id", "hit", "cached_desire")
    return streams.run_to_files(found, scratch_path(spark, "looked-up"), scratch_path(spark, "state"))


@query("stream_metrics", "SELECT CAST(0 AS BIGINT) AS batch_no, COUNT(*) AS rows FROM events")
def stream_metrics(spark, folder):
    metrics = scratch_path(spark, "metrics")
    streams.finish(
        *streams.stream_metrics(stream_of(spark, folder, "events"), scratch_path(spark, "events"), metrics, scratch_path(spark, "state"))
    )
    return spark.read.parquet(metrics).select("batch_no", "rows")
