"""Scores, ranks, calibration, weights and name similarity over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.numbers import score_fraction
from merchlens.operators import calibrate, ranks, scoring, similarity, weights
from merchlens.plans import frames as fr
from merchlens.plans.registry import query
from merchlens.plans.trend_queries import P, rounded
from merchlens.session import cut_lineage

CONFIG = scoring.ScoreConfig(
    weights={
        "price": 40, "rating": 55, "units_sold": 70, "revenue": 80, "desire": 60, "competition": 35,
        "oldness": 20, "awareness": 44,
    },
    order=["revenue", "units_sold", "rating", "desire"],
    enabled={"price": True},
    as_of=fr.AS_OF,
)
# the same weights worked out in SQL: base weight x places behind, over the sum
_SLIDERS = {**CONFIG.weights, "oldness": 60}
_PLACES = ["revenue", "units_sold", "rating", "desire", "price", "competition", "oldness", "awareness"]
_WEIGHT_ROWS = ", ".join(f"('{f}', {_SLIDERS[f]}, {8 - i})" for i, f in enumerate(_PLACES))

_NORMS = f"""
eff AS (SELECT f, w * place * 1.0 / SUM(w * place) OVER () AS w FROM (VALUES {_WEIGHT_ROWS}) AS t(f, w, place)),
aged AS (SELECT *, greatest(0, date_diff('day', first_seen, DATE '{fr.AS_OF}')) AS age,
  CASE lower(replace(awareness_level, '-', ' ')) WHEN 'unaware' THEN 10 WHEN 'problem aware' THEN 30
    WHEN 'solution aware' THEN 50 WHEN 'product aware' THEN 70 WHEN 'most aware' THEN 90 ELSE 50 END AS centre
  FROM products),
bounds AS (SELECT MIN(age) AS lo, MAX(age) AS hi FROM aged),
norms AS (SELECT id, winner_score,
    CASE WHEN price IS NOT NULL THEN least(1, greatest(0, price / 1000)) END AS n_price,
    CASE WHEN rating IS NOT NULL THEN least(1, greatest(0, rating / 5)) END AS n_rating,
    CASE WHEN units_sold IS NOT NULL THEN least(1, greatest(0, ln(1 + units_sold) / ln(10001))) END AS n_units_sold,
    CASE WHEN revenue IS NOT NULL THEN least(1, greatest(0, ln(1 + revenue) / ln(1000001))) END AS n_revenue,
    CASE desire_magnitude WHEN 'Low' THEN 0.2 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.8 END AS n_desire,
    CASE competition_level WHEN 'Low' THEN 0.8 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.2 END AS n_competition,
    1 - CASE WHEN age IS NULL THEN NULL WHEN hi = lo THEN 0.5 ELSE (age - lo) * 1.0 / (hi - lo) END AS n_oldness,
    greatest(0, 1 - abs(44 - centre) / 80.0) AS n_awareness
  FROM aged, bounds),
w AS (SELECT {", ".join(f"MAX(w) FILTER (f = '{f}') AS w_{f}" for f in vocab.SCORE_FIELDS)} FROM eff),
scored AS (SELECT norms.*, least(1.0, greatest(0.0, {" + ".join(f"COALESCE(CAST(n_{f} AS DOUBLE) * w_{f}, 0)" for f in vocab.SCORE_FIELDS)})) * 100 AS raw
  FROM norms, w)
"""
SCORED = fr.with_views(fr.PRODUCTS, _NORMS)


def score_input(spark, folder):
    """Products as the score reads them: desire comes from its label, not from its text."""
    return fr.products(spark, folder).drop("date_range", "desire", "import_date")


@query(
    "winner_score",
    SCORED + "SELECT id, ROUND(raw, 4) AS score_raw, CAST(round_even(raw, 0) AS BIGINT) AS score FROM scored",
)
def winner_score(spark, folder):
    out = scoring.winner_score(score_input(spark, folder), CONFIG).select("id", "score_raw", "score")
    return rounded(out)


@query(
    "oldness_bounds",
    P + f"""SELECT MIN(age) AS min_age, MAX(age) AS max_age FROM (
  SELECT greatest(0, date_diff('day', COALESCE(TRY_CAST(split_part(date_range, '~', 1) AS DATE), first_seen), DATE '{fr.AS_OF}')) AS age FROM products)""",
)
def oldness_bounds(spark, folder):
    return scoring.oldness_bounds(fr.products(spark, folder), fr.AS_OF)


@query(
    "score_catalog",
    SCORED + """SELECT COUNT(*) AS processed, COUNT(*) FILTER (CAST(round_even(raw, 0) AS BIGINT) <> winner_score) AS updated FROM scored""",
)
def score_catalog(spark, folder):
    return scoring.score_counts(scoring.score_catalog(score_input(spark, folder), CONFIG))


_HAS = {f: f"n_{f} IS NOT NULL" for f in vocab.SCORE_FIELDS}


@query(
    "explain_score",
    SCORED + f"""SELECT id,
  concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _HAS.items())}) AS present,
  concat_ws(',', {", ".join(f"CASE WHEN NOT ({c}) THEN '{f}' END" for f, c in _HAS.items())}) AS missing,
  (SELECT ROUND(w_revenue, 3) FROM w) AS revenue_weight,
  CAST(round_even(raw, 0) AS BIGINT) AS score FROM scored""",
)
def explain_score(spark, folder):
    return scoring.explain_score(score_input(spark, folder), CONFIG).select(
        "id",
        F.array_join("present", ",").alias("present"),
        F.array_join("missing", ",").alias("missing"),
        F.col("effective_weights")["revenue"].alias("revenue_weight"),
        "score",
    )


# --- legacy metric score ----------------------------------------------------------------

METRIC_WEIGHTS = {
    "magnitud_deseo": 3.0, "nivel_consciencia_headroom": 2.0, "evidencia_demanda": 4.0,
    "tasa_conversion": 2.0, "ventas_por_dia": 3.0, "recencia_lanzamiento": 1.0,
    "competition_level_invertido": 2.0, "facilidad_anuncio": 0.0,
}


def metric_input(spark, folder):
    products = fr.products(spark, folder)
    aware = F.lower(F.split("awareness_level", "[- ]")[0])
    return products.select(
        "id",
        F.col("desire_magnitude").alias("magnitud_deseo"),
        aware.alias("nivel_consciencia_headroom"),
        F.col("units_sold").alias("evidencia_demanda"),
        (F.col("conversion_rate") * 100).alias("tasa_conversion"),
        (F.col("units_sold") / (F.datediff("last_seen", "first_seen") + 1)).alias("ventas_por_dia"),
        F.datediff(F.lit(fr.AS_OF), "last_seen").alias("recencia_lanzamiento"),
        F.col("competition_level").alias("competition_level_invertido"),
        F.col("competition_level").alias("facilidad_anuncio"),
    )


_METRICS = """
m AS (SELECT id, lower(desire_magnitude) AS md, lower(regexp_split_to_array(awareness_level, '[- ]')[1]) AS nc,
    ln(1 + units_sold) AS ed, conversion_rate * 100 AS tc,
    units_sold / (date_diff('day', first_seen, last_seen) + 1) AS vd,
    date_diff('day', last_seen, DATE '2002-01-01') AS rl, lower(competition_level) AS cl FROM products),
eds AS (SELECT ed, ROW_NUMBER() OVER (ORDER BY ed) - 1 AS pos, COUNT(*) OVER () AS n FROM m WHERE ed IS NOT NULL),
vds AS (SELECT vd, ROW_NUMBER() OVER (ORDER BY vd) - 1 AS pos, COUNT(*) OVER () AS n FROM m WHERE vd IS NOT NULL),
rg AS (SELECT
  (SELECT ed FROM eds WHERE pos = CAST(floor(0.05 * (n - 1)) AS BIGINT)) AS ed5,
  (SELECT ed FROM eds WHERE pos = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS ed95,
  (SELECT vd FROM vds WHERE pos = CAST(floor(0.05 * (n - 1)) AS BIGINT)) AS vd5,
  (SELECT vd FROM vds WHERE pos = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS vd95)"""


@query(
    "score_ranges",
    fr.with_views(fr.PRODUCTS, _METRICS)
    + "SELECT ROUND(ed5, 6) AS demand_p5, ROUND(ed95, 6) AS demand_p95, ROUND(vd5, 6) AS sales_p5, ROUND(vd95, 6) AS sales_p95 FROM rg",
)
def score_ranges(spark, folder):
    rows = metric_input(spark, folder)
    demand = rows.select(F.log1p("evidencia_demanda").alias("v"))
    probs = {"p5": 0.05, "p95": 0.95}
    first = ranks.exact_quantiles(demand, "v", probs, method="floor").select(
        F.col("p5").alias("demand_p5"), F.col("p95").alias("demand_p95")
    )
    second = ranks.exact_quantiles(rows, "ventas_por_dia", probs, method="floor")
    return rounded(
        first.withColumn("sales_p5", second.select("p5").scalar()).withColumn("sales_p95", second.select("p95").scalar()), 6
    )


@query(
    "metric_score",
    fr.with_views(fr.PRODUCTS, _METRICS)
    + """, v AS (SELECT id,
    CASE md WHEN 'low' THEN 0.33 WHEN 'medium' THEN 0.66 WHEN 'high' THEN 1.0 END AS a,
    CASE nc WHEN 'unaware' THEN 1.0 WHEN 'problem' THEN 0.8 WHEN 'solution' THEN 0.6 WHEN 'product' THEN 0.4 WHEN 'most' THEN 0.2 END AS b,
    least(1, greatest(0, (ed - ed5) / (ed95 - ed5))) AS c,
    least(1, greatest(0, CASE WHEN tc > 1 THEN tc / 100 ELSE tc END)) AS d,
    least(1, greatest(0, (vd - vd5) / (vd95 - vd5))) AS e,
    exp(-rl / 180.0) AS f,
    CASE cl WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.0 END AS g FROM m, rg)
SELECT id, ROUND((COALESCE(a * 3, 0) + COALESCE(b * 2, 0) + COALESCE(CAST(c AS DOUBLE) * 4, 0) + COALESCE(d * 2, 0) + COALESCE(e * 3, 0) + COALESCE(f, 0) + COALESCE(g * 2, 0))
  / NULLIF((CASE WHEN a IS NULL THEN 0 ELSE 3 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END + CASE WHEN c IS NULL THEN 0 ELSE 4 END
   + CASE WHEN d IS NULL THEN 0 ELSE 2 END + CASE WHEN e IS NULL THEN 0 ELSE 3 END + CASE WHEN f IS NULL THEN 0 ELSE 1 END
   + CASE WHEN g IS NULL THEN 0 ELSE 2 END), 0), 6) AS metric_score FROM v""",
)
def metric_score(spark, folder):
    rows = metric_input(spark, folder)
    return rounded(scoring.metric_score(rows, METRIC_WEIGHTS, scoring.score_ranges(rows)).select("id", "metric_score"), 6)


# sixty-fourths, so that sums are exact in both engines
_SHARES = dict(zip(vocab.RUBRIC_FIELDS, (16, 12, 10, 8, 8, 4, 4, 2)))
RUBRIC_WEIGHTS = {f: w / 64 for f, w in _SHARES.items()}
_RUBRIC_SOURCES = {
    "magnitud_deseo": ("p_size % 7", lambda: F.col("p_size") % 7),
    "nivel_consciencia": ("p_size % 5 + 1", lambda: F.col("p_size") % 5 + 1),
    "saturacion_mercado": ("p_partkey % 6", lambda: F.col("p_partkey") % 6),
    "escalabilidad": ("length(p_name)", lambda: F.length("p_name")),
    "durabilidad_recurrencia": ("p_size // 10", lambda: F.floor(F.col("p_size") / 10)),
}
_RUBRIC_SUM = " + ".join(
    [f"least(5, greatest(1, {sql})) * {_SHARES[f]}" for f, (sql, _) in _RUBRIC_SOURCES.items()]
    + [f"3 * {w}" for f, w in _SHARES.items() if f not in _RUBRIC_SOURCES]
)


@query(
    "rubric_score",
    f"""SELECT p_partkey AS id, ROUND(s * 8, 6) AS rubric_raw,
  CAST(round_even(least(100, greatest(0, (s * 8 - 8) / 32 * 100)), 0) AS DOUBLE) AS rubric_pct
FROM (SELECT p_partkey, CAST({_RUBRIC_SUM} AS DOUBLE) / 64 AS s FROM part)""",
)
def rubric_score(spark, folder):
    parts = fr.table(spark, folder, "part")
    marks = parts.select(F.col("p_partkey").alias("id"), *[c().alias(f) for f, (_, c) in _RUBRIC_SOURCES.items()])
    out = scoring.rubric_score(marks, RUBRIC_WEIGHTS)
    return rounded(out.select("id", "rubric_raw", "rubric_pct"), 6)


@query(
    "metric_rescale",
    """WITH m AS (SELECT l_partkey AS id, CAST(COUNT(*) AS DOUBLE) AS orders, CAST(COUNT(DISTINCT l_suppkey) AS DOUBLE) AS sellers,
    SUM(l_quantity) AS weight FROM lineitem GROUP BY 1),
b AS (SELECT MIN(orders) AS o0, MAX(orders) AS o1, MIN(sellers) AS s0, MAX(sellers) AS s1, MIN(weight) AS w0, MAX(weight) AS w1 FROM m)
SELECT id, CAST(round_even(1 + (orders - o0) / (o1 - o0) * 4, 0) AS BIGINT) AS magnitud_deseo,
  CAST(round_even(1 + (1 - (sellers - s0) / (s1 - s0)) * 4, 0) AS BIGINT) AS saturacion_mercado,
  CAST(round_even(1 + (1 - (weight - w0) / (w1 - w0)) * 4, 0) AS BIGINT) AS facilidad_logistica FROM m, b""",
)
def metric_rescale(spark, folder):
    metrics = fr.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("l_suppkey").alias("sellers"),
        F.sum("l_quantity").alias("weight"),
    )
    metrics = cut_lineage(metrics)
    bounds = scoring.metric_bounds(metrics, ["orders", "sellers", "weight"])
    return scoring.metric_rescale(metrics, bounds).select(
        "id", "magnitud_deseo", "saturacion_mercado", "facilidad_logistica"
    )


# --- ranks ------------------------------------------------------------------------------


@query(
    "pct_rank",
    """SELECT o_orderkey AS id, ROUND(percent_rank() OVER (ORDER BY o_totalprice), 9) AS pct FROM orders""",
)
def pct_rank(spark, folder):
    orders = fr.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return rounded(ranks.pct_rank(orders, "o_totalprice", "pct").select("id", "pct"), 9)


@query(
    "pct_rank_probes",
    """WITH pop AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
probes AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F'),
steps AS (SELECT v, SUM(own) AS own FROM (SELECT v, 1 AS own FROM pop UNION ALL SELECT v, 0 FROM probes) GROUP BY v),
below AS (SELECT v, COALESCE(SUM(own) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
  SUM(own) OVER () AS n FROM steps)
SELECT id, ROUND(CAST(b AS DOUBLE) / greatest(1, n - 1), 9) AS pct FROM probes JOIN below USING (v)""",
)
def pct_rank_probes(spark, folder):
    orders = fr.table(spark, folder, "orders")
    population = orders.where(F.col("o_orderstatus") == "F").select("o_totalprice")
    probes = orders.where(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return rounded(ranks.pct_rank(probes, "o_totalprice", "pct", population).select("id", "pct"), 9)


_TIES = """ranked AS (SELECT id, u, r,
    (RANK() OVER (ORDER BY u) - 1 + (COUNT(*) OVER (PARTITION BY u) - 1) / 2.0) / (COUNT(*) OVER () - 1) AS up FROM src WHERE u IS NOT NULL),
rated AS (SELECT id, (RANK() OVER (ORDER BY r) - 1 + (COUNT(*) OVER (PARTITION BY r) - 1) / 2.0) / (COUNT(*) OVER () - 1) AS rp FROM src WHERE r IS NOT NULL)"""


@query(
    "rank_percentile",
    "WITH src AS (SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS u, NULL AS r FROM events), "
    + _TIES
    + " SELECT src.id, ROUND(COALESCE(up, 0.5), 9) AS pct FROM src LEFT JOIN ranked USING (id)",
)
def rank_percentile(spark, folder):
    ev = fr.events(spark, folder)
    rows = ev.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("k")).alias("u"))
    return rounded(ranks.rank_percentile(rows, "u", "pct").select("id", "pct"), 9)


@query(
    "fill_by_rank",
    fr.with_views(
        fr.PRODUCTS,
        "src AS (SELECT id, units_sold AS u, rating AS r, CASE WHEN size % 3 = 0 THEN CAST(size AS BIGINT) END AS magnitude FROM products)",
        _TIES,
    )
    + """SELECT src.id, COALESCE(magnitude, least(100, greatest(0, CAST(round_even((COALESCE(up, 0.5) + COALESCE(rp, 0.5)) / 2 * 100, 0) AS BIGINT)))) AS magnitude
FROM src LEFT JOIN ranked USING (id) LEFT JOIN rated USING (id)""",
)
def fill_by_rank(spark, folder):
    rows = fr.products(spark, folder).select(
        "id", "units_sold", "rating", F.when(F.col("size") % 3 == 0, F.col("size").cast("long")).alias("magnitude")
    )
    return ranks.fill_by_rank(cut_lineage(rows), "magnitude").select("id", "magnitude")


@query(
    "exact_quantiles",
    """SELECT l_returnflag, COUNT(*) AS n, ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
  ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS p50, ROUND(quantile_cont(l_extendedprice, 0.99), 4) AS p99
FROM lineitem GROUP BY l_returnflag""",
)
def exact_quantiles(spark, folder):
    lines = fr.table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(
        ranks.exact_quantiles(lines, "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p99": 0.99}, ["l_returnflag"])
    )


@query(
    "apportion",
    """WITH v AS (SELECT c_nationkey AS nation, c_custkey AS key, greatest(0, CAST(c_acctbal AS DOUBLE)) AS v FROM customer),
s AS (SELECT *, v / CAST(SUM(CAST(v AS DECIMAL(28,6))) OVER (PARTITION BY nation) AS DOUBLE) * 100 AS exact FROM v),
r AS (SELECT *, floor(exact) AS fl, 100 - SUM(floor(exact)) OVER (PARTITION BY nation) AS left_over,
  ROW_NUMBER() OVER (PARTITION BY nation ORDER BY exact - floor(exact) DESC, key DESC) AS rn FROM s)
SELECT nation, key, CAST(fl AS BIGINT) + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS share FROM r""",
)
def apportion(spark, folder):
    rows = fr.table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")
    )
    return ranks.apportion(rows, ["nation"]).select("nation", "key", "share")


@query(
    "apportion_all",
    """WITH v AS (SELECT CASE WHEN p_size % 7 > 0 THEN p_brand END AS key, CAST(SUM(p_size) AS DOUBLE) / 1e8 AS v FROM part GROUP BY 1),
s AS (SELECT key, v / SUM(v) OVER () * 100 AS exact FROM v),
r AS (SELECT *, 100 - SUM(floor(exact)) OVER () AS left_over,
  ROW_NUMBER() OVER (ORDER BY round(exact - floor(exact), 9) DESC, key DESC NULLS LAST) AS rn FROM s)
SELECT key, CAST(floor(exact) AS BIGINT) + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS share FROM r""",
)
def apportion_all(spark, folder):
    """One split over the whole table, of tiny weights and with a NULL key."""
    rows = fr.table(spark, folder, "part").groupBy(F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("key"))
    return ranks.apportion(rows.agg((F.sum("p_size").cast("double") / 1e8).alias("value"))).select("key", "share")


@query(
    "apportion_previous",
    """WITH v AS (SELECT p_size AS size, p_partkey AS key, CASE WHEN p_size % 3 > 0 THEN 0.0 ELSE CAST(p_partkey AS DOUBLE) END AS v,
    CASE WHEN p_size % 3 = 2 AND p_partkey % 2 = 0 THEN p_partkey % 50 END AS prev FROM part),
s AS (SELECT *, SUM(v) OVER g AS total, COUNT(*) OVER g AS n, COUNT(prev) OVER g AS known FROM v WINDOW g AS (PARTITION BY size)),
e AS (SELECT *, CASE WHEN total > 0 THEN v / total * 100 ELSE floor(100 / n) END AS exact FROM s),
r AS (SELECT *, 100 - SUM(floor(exact)) OVER (PARTITION BY size) AS left_over, ROW_NUMBER() OVER (PARTITION BY size
    ORDER BY exact - floor(exact) DESC, CASE WHEN total > 0 THEN -key ELSE key END) AS rn FROM e)
SELECT size, key, CASE WHEN total <= 0 AND known > 0 THEN COALESCE(prev, 0) ELSE CAST(floor(exact) AS BIGINT) + CASE WHEN rn <= left_over THEN 1 ELSE 0 END END AS share FROM r""",
)
def apportion_previous(spark, folder):
    """Groups with weights, with none but earlier shares, and with neither."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = fr.table(spark, folder, "part").select(
        size.alias("size"), key.alias("key"), F.when(size % 3 > 0, 0.0).otherwise(key.cast("double")).alias("value"),
        F.when((size % 3 == 2) & (key % 2 == 0), key % 50).alias("before"),
    )
    return ranks.apportion(rows, ["size"], previous="before").select("size", "key", "share")


@query(
    "row_numbers",
    "SELECT o_orderkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders",
)
def row_numbers(spark, folder):
    rows = fr.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day")
    )
    return ranks.row_numbers(rows, "day", "id", "place").select("id", "place")


# --- calibration ------------------------------------------------------------------------

_MIN_SHARES = """
counts1 AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (label = 'Medium') AS med FROM l0),
cand1 AS (SELECT id, ROW_NUMBER() OVER (ORDER BY abs(score - 0.5), CAST(id AS VARCHAR)) AS rn FROM l0 WHERE label <> 'Medium'),
l1 AS (SELECT l0.id, score, CASE WHEN rn <= ceil({medium} * n) - med THEN 'Medium' ELSE label END AS label
  FROM l0 CROSS JOIN counts1 LEFT JOIN cand1 USING (id)),
counts2 AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (label = 'Medium') AS med, COUNT(*) FILTER (label = 'Low') AS low FROM l1),
cand2 AS (SELECT id, ROW_NUMBER() OVER (ORDER BY abs(score - (SELECT q33 FROM q)), CAST(id AS VARCHAR)) AS rn FROM l1 WHERE label = 'Medium'),
l2 AS (SELECT l1.id, score, CASE WHEN rn <= least(ceil({low} * n) - low, med - ceil({medium} * n)) THEN 'Low' ELSE label END AS label
  FROM l1 CROSS JOIN counts2 LEFT JOIN cand2 USING (id)),
counts3 AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (label = 'Medium') AS med, COUNT(*) FILTER (label = 'High') AS high FROM l2),
cand3 AS (SELECT id, ROW_NUMBER() OVER (ORDER BY abs(score - (SELECT q67 FROM q)), CAST(id AS VARCHAR)) AS rn FROM l2 WHERE label = 'Medium'),
l3 AS (SELECT l2.id, score, CASE WHEN rn <= least(ceil({high} * n) - high, med - ceil({medium} * n)) THEN 'High' ELSE label END AS label
  FROM l2 CROSS JOIN counts3 LEFT JOIN cand3 USING (id))
"""


def _terciles_sql(source: str, low: float, medium: float, high: float) -> str:
    return (
        f"WITH src AS ({source}), "
        """lim AS (SELECT quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM src),
w AS (SELECT id, least(greatest(score, lo), hi) AS score FROM src, lim),
q AS (SELECT quantile_cont(score, 1.0 / 3) AS q33, quantile_cont(score, 2.0 / 3) AS q67 FROM w),
l0 AS (SELECT id, score, CASE WHEN score <= q33 THEN 'Low' WHEN score >= q67 THEN 'High' ELSE 'Medium' END AS label FROM w, q),"""
        + _MIN_SHARES.format(low=low, medium=medium, high=high)
        + "SELECT id, label FROM l3"
    )


_VALUE_SCORE = "SELECT event_id AS id, value / 500 AS score FROM events"


@query("classify_terciles", _terciles_sql(_VALUE_SCORE, 0.05, 0.05, 0.05))
def classify_terciles(spark, folder):
    rows = fr.table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("score"))
    return calibrate.calibrate(rows, "score").select("id", "label")


# two scores hold most rows, so that the middle class starts empty and rows have to move
_FLAT_SCORE = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 0.9 WHEN 'view' THEN 0.9
  WHEN 'error' THEN 0.6 + CAST(json_extract_string(props, '$.k') AS BIGINT) / 1000.0 ELSE 0.2 END AS score FROM events"""


@query("enforce_min_shares", _terciles_sql(_FLAT_SCORE, 0.45, 0.3, 0.25))
def enforce_min_shares(spark, folder):
    ev = fr.events(spark, folder)
    score = (
        F.when(F.col("event_type").isin("click", "view"), 0.9)
        .when(F.col("event_type") == "error", 0.6 + F.col("k") / 1000.0)
        .otherwise(0.2)
    )
    rows = ev.select(F.col("event_id").alias("id"), score.alias("score"))
    shares = calibrate.Shares(0.45, 0.3, 0.25)
    return calibrate.calibrate(rows, "score", shares=shares).select("id", "label")


@query(
    "classify_by_rank",
    """WITH s AS (SELECT doc_id AS id, ROW_NUMBER() OVER (ORDER BY quality, doc_id) AS place, COUNT(*) OVER () AS n FROM labels)
SELECT id, CASE WHEN place <= round_even(CAST(n AS DOUBLE) / 3, 0) THEN 'Low' WHEN place <= round_even(2 * CAST(n AS DOUBLE) / 3, 0) THEN 'Medium' ELSE 'High' END AS label FROM s""",
)
def classify_by_rank(spark, folder):
    rows = fr.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    fitted = calibrate.fit_terciles(rows, "score")
    return calibrate.classify_terciles(rows, "score", fitted).select("id", "label")


@query(
    "classify_with_thresholds",
    "WITH src AS (SELECT event_id AS id, value / 500 AS score FROM events), q AS (SELECT 0.05 AS q33, 0.3 AS q67), "
    "l0 AS (SELECT id, score, CASE WHEN score <= q33 THEN 'Low' WHEN score >= q67 THEN 'High' ELSE 'Medium' END AS label FROM src, q),"
    + _MIN_SHARES.format(low=0.05, medium=0.05, high=0.15)
    + "SELECT id, label FROM l3",
)
def classify_with_thresholds(spark, folder):
    rows = fr.table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("score"))
    stored = calibrate.Thresholds(0.05, 0.3)
    return calibrate.classify_with_thresholds(rows, "score", stored, calibrate.Shares(0.05, 0.05, 0.15)).select("id", "label")


@query(
    "score_fraction",
    """SELECT event_id AS id, ROUND(CASE k % 5 WHEN 0 THEN k / 100.0 WHEN 1 THEN k / 100.0 WHEN 2 THEN 0.2 WHEN 3 THEN 0.5 ELSE 0.8 END, 6) AS fraction
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def score_fraction_query(spark, folder):
    ev = fr.events(spark, folder)
    k = F.col("k")
    text = (
        F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(" %")))
        .when(k % 5 == 1, (k / 100).cast("string"))
        .when(k % 5 == 2, "Low demand")
        .when(k % 5 == 3, " med ")
        .otherwise("HIGH")
    )
    return ev.select(F.col("event_id").alias("id"), F.round(score_fraction(text), 6).alias("fraction"))


_BASELINE = """
ranked AS (SELECT id, percent_rank() OVER (ORDER BY units_sold) AS u FROM products WHERE units_sold IS NOT NULL),
conv AS (SELECT id, percent_rank() OVER (ORDER BY conversion_rate) AS c FROM products WHERE conversion_rate IS NOT NULL),
dem AS (SELECT id, name, category, desire_magnitude, competition_level, u, c, CASE WHEN rating IS NOT NULL THEN least(1, greatest(0, (rating - 3) / 2)) END AS r FROM products LEFT JOIN ranked USING (id) LEFT JOIN conv USING (id)),
demand AS (SELECT *, ROUND(0.45 * COALESCE(u, 0) + 0.35 * COALESCE(c, 0) + 0.20 * COALESCE(r, 0), 9) AS signal FROM dem),
demand_b AS (SELECT *, CASE WHEN signal > 0.66 AND u IS NOT NULL AND c IS NOT NULL AND r IS NOT NULL THEN 'High'
   WHEN signal < 0.33 THEN 'Low' ELSE 'Medium' END AS demand FROM demand)"""


@query(
    "demand_baseline",
    fr.with_views(fr.PRODUCTS, _BASELINE) + "SELECT id, signal AS demand_signal, demand FROM demand_b",
)
def demand_baseline(spark, folder):
    rows = cut_lineage(fr.products(spark, folder).select("id", "units_sold", "conversion_rate", "rating"))
    return rounded(calibrate.demand_baseline(rows).select("id", "demand_signal", "demand"), 9)


_TOKENS = """
names AS (SELECT p_name AS name, COUNT(*) AS c FROM part GROUP BY 1),
probes AS (SELECT name, t FROM (SELECT name, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM names) AS words
  WHERE t NOT IN ({stops})),
idx AS (SELECT DISTINCT name, t FROM probes),
shared AS (SELECT a.name, b.name AS other, COUNT(*) AS s FROM probes a JOIN idx b USING (t) GROUP BY 1, 2),
sim AS (SELECT shared.name, CAST(SUM(n.c) AS BIGINT) - 1 AS similar_names FROM shared JOIN names n ON n.name = shared.other WHERE s >= 2 GROUP BY 1)
""".replace("{stops}", ", ".join(f"'{w}'" for w in vocab.NAME_STOP_WORDS))


@query(
    "name_similarity",
    "WITH " + _TOKENS + "SELECT p_partkey AS id, COALESCE(similar_names, 0) AS similar_names FROM part LEFT JOIN sim ON p_name = name",
)
def name_similarity(spark, folder):
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return similarity.name_similarity(parts)


_TITLE_TOKENS = _TOKENS.replace("p_name AS name", "title AS name").replace("FROM part GROUP BY 1", "FROM titles GROUP BY 1")


@query(
    "name_similarity_brands",
    "WITH titles AS (SELECT p_partkey AS id, p_brand || ' ' || p_name || ' ' || p_type AS title FROM part), " + _TITLE_TOKENS
    + "SELECT id, COALESCE(similar_names, 0) AS similar_names FROM titles LEFT JOIN sim ON title = name",
)
def name_similarity_brands(spark, folder):
    """Longer names whose every token is frequent: the counting path without pairs."""
    parts = fr.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("name")
    )
    return similarity.name_similarity(parts)


@query(
    "name_similarity_long",
    "WITH titles AS (SELECT p_partkey AS id, array_to_string(list_transform(generate_series(0, 19), lambda i: 'w' || ((p_partkey * (i + 3) + i * i * (p_size + 1)) % 47)), ' ') AS title FROM part), "
    + _TITLE_TOKENS
    + "SELECT id, COALESCE(similar_names, 0) AS similar_names FROM titles LEFT JOIN sim ON title = name",
)
def name_similarity_long(spark, folder):
    """Names of twenty tokens, repeats among them, that are all frequent."""
    token = lambda i: F.concat(F.lit("w"), ((F.col("p_partkey") * (i + 3) + i * i * (F.col("p_size") + 1)) % 47).cast("string"))
    name = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), token), " ")
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return similarity.name_similarity(parts)


@query(
    "similar_up_to",
    "WITH titles AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey // 3) || ' ' || p_name AS title FROM part), " + _TITLE_TOKENS
    + "SELECT id, least(12, COALESCE(similar_names, 0)) AS similar_at_least FROM titles LEFT JOIN sim ON title = name",
)
def similar_up_to(spark, folder):
    """Names that repeat their words, so that one shared word is enough."""
    name = F.concat_ws(" ", "p_name", F.floor(F.col("p_partkey") / 3).cast("string"), "p_name")
    parts = fr.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return similarity.similar_up_to(parts, 12)


@query(
    "similar_up_to_rare",
    "WITH titles AS (SELECT c_custkey AS id, 'shop ' || (c_custkey // 4) || ' ' || (c_custkey % 40) || 'x' AS title FROM customer), " + _TITLE_TOKENS
    + "SELECT id, least(12, COALESCE(similar_names, 0)) AS similar_at_least FROM titles LEFT JOIN sim ON title = name",
)
def similar_up_to_rare(spark, folder):
    """Names of one common and two rarer words: some are counted, some are compared."""
    key = F.col("c_custkey")
    name = F.concat_ws(" ", F.lit("shop"), F.floor(key / 4).cast("string"), F.concat((key % 40).cast("string"), F.lit("x")))
    rows = fr.table(spark, folder, "customer").select(key.alias("id"), name.alias("name"))
    return similarity.similar_up_to(rows, 12)


_COMPETITION = """
cats AS (SELECT category, COUNT(*) AS n FROM products GROUP BY 1),
freq AS (SELECT category, percent_rank() OVER (ORDER BY n) AS p FROM cats),
comp AS (SELECT products.id, p AS category_pct, COALESCE(similar_names, 0) AS similar_names,
  CASE WHEN p >= 0.70 OR COALESCE(similar_names, 0) >= 8 THEN 'High' WHEN p <= 0.30 AND COALESCE(similar_names, 0) <= 2 THEN 'Low' ELSE 'Medium' END AS competition
  FROM products JOIN freq USING (category) LEFT JOIN sim ON products.name = sim.name)"""
_LINE_SIM = _TOKENS.strip()


@query(
    "competition_baseline",
    fr.with_views(fr.PRODUCTS, _LINE_SIM, _COMPETITION)
    + f"SELECT id, ROUND(category_pct, 9) AS category_pct, least({calibrate.MANY_SIMILAR}, similar_names) AS similar_at_least, competition FROM comp",
)
def competition_baseline(spark, folder):
    rows = fr.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category")
    )
    out = calibrate.competition_baseline(rows, similarity.similar_up_to(rows, calibrate.MANY_SIMILAR))
    return rounded(out.select("id", "category_pct", "similar_at_least", "competition"), 9)


@query(
    "reconcile_labels",
    fr.with_views(fr.PRODUCTS, _BASELINE, _LINE_SIM, _COMPETITION)
    + """, o AS (SELECT * FROM (VALUES ('Low', 1), ('Medium', 2), ('High', 3)) AS t(l, i))
SELECT demand_b.id,
  CASE least((SELECT i FROM o WHERE l = COALESCE(desire_magnitude, 'Medium')), (SELECT i FROM o WHERE l = demand)) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS demand_final,
  CASE greatest((SELECT i FROM o WHERE l = COALESCE(competition_level, 'Medium')), (SELECT i FROM o WHERE l = competition)) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS competition_final
FROM demand_b JOIN comp USING (id)""",
)
def reconcile_labels(spark, folder):
    rows = cut_lineage(
        fr.products(spark, folder).select(
            "id", "name", "category", "units_sold", "conversion_rate", "rating", "desire_magnitude", "competition_level"
        )
    )
    demand = calibrate.demand_baseline(rows).select("id", "demand", "desire_magnitude", "competition_level")
    similar = similarity.similar_up_to(rows, calibrate.MANY_SIMILAR)
    competition = calibrate.competition_baseline(rows, similar).select("id", "competition")
    joined = demand.join(competition, "id")
    return calibrate.reconcile_labels(joined, "desire_magnitude", "demand", "competition_level", "competition").select(
        "id", "demand_final", "competition_final"
    )


# --- weights ----------------------------------------------------------------------------

PROFILED = ["price", "rating", "units_sold", "revenue", "desire", "competition", "oldness", "awareness"]


def profile_input(spark, folder):
    products = fr.products(spark, folder)
    level = {"Low": 0.2, "Medium": 0.5, "High": 0.8}
    return products.select(
        F.col("category").alias("segment"), "price", "rating", "units_sold", "revenue",
        F.when(F.col("desire_magnitude") == "Low", level["Low"]).when(F.col("desire_magnitude") == "Medium", level["Medium"]).when(F.col("desire_magnitude") == "High", level["High"]).alias("desire"),
        F.when((F.col("competition_level") == "Low") & (F.col("id") % 3 == 0), level["Low"]).when((F.col("competition_level") == "High") & (F.col("id") % 3 == 0), level["High"]).alias("competition"),
        F.datediff(F.lit(fr.AS_OF), "first_seen").cast("double").alias("oldness"),
        (F.col("size") % 5).cast("double").alias("awareness"),
    )


_PROFILE = """
src AS (SELECT category AS segment, price, rating, units_sold, revenue,
    CASE desire_magnitude WHEN 'Low' THEN 0.2 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.8 END AS desire,
    CASE WHEN id % 3 = 0 THEN CASE competition_level WHEN 'Low' THEN 0.2 WHEN 'High' THEN 0.8 END END AS competition,
    CAST(date_diff('day', first_seen, DATE '2002-01-01') AS DOUBLE) AS oldness, CAST(size % 5 AS DOUBLE) AS awareness FROM products),
long AS (""" + " UNION ALL ".join(f"SELECT segment, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM src" for m in PROFILED) + """),
profile AS (SELECT segment, metric, MIN(v) AS min, MAX(v) AS max, AVG(v) AS mean, stddev_samp(v) AS std,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, CAST(COUNT(v) AS DOUBLE) / COUNT(*) AS coverage
  FROM long GROUP BY 1, 2)"""


@query(
    "profile_metrics",
    fr.with_views(fr.PRODUCTS, _PROFILE)
    + "SELECT segment, metric, " + ", ".join(f"ROUND({c}, 3) AS {c}" for c in ("min", "max", "mean", "std", "p25", "p50", "p75", "coverage")) + " FROM profile",
)
def profile_metrics(spark, folder):
    rows = cut_lineage(profile_input(spark, folder))
    return rounded(weights.profile_metrics(rows, PROFILED, ["segment"]), 3)


_BASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.PROFILE_BASE_WEIGHTS.items())


@query(
    "weights_from_profile",
    fr.with_views(fr.PRODUCTS, _PROFILE)
    + f""", p AS (SELECT segment, metric, coverage, CASE WHEN max > min THEN (p50 - min) / (max - min) END AS pos,
   CASE WHEN max > min THEN (p75 - p25) / (max - min + 1e-9) ELSE 0.5 END AS spread FROM profile),
s AS (SELECT *, 0.65 * CASE WHEN pos IS NULL THEN 0.5 WHEN metric IN ('rating', 'units_sold', 'revenue', 'desire') THEN pos
     WHEN metric IN ('competition', 'oldness') THEN 1 - pos ELSE 1 - abs(pos - 0.5) * 2 END + 0.35 * (0.3 + 0.7 * spread) AS strength FROM p),
w AS (SELECT *, CASE metric {_BASE} END * (0.6 + 0.8 * strength) * (0.1 + 0.9 * coverage)
   * CASE WHEN pos IS NULL THEN 1 WHEN metric = 'competition' THEN 0.5 + 0.5 * (1 - pos) WHEN metric = 'oldness' THEN 0.8 + 0.4 * (1 - pos)
      WHEN metric = 'price' THEN least(1.15, greatest(0.3, 1 - abs(pos - 0.4) * 1.6))
      WHEN metric = 'awareness' THEN least(1.1, greatest(0.35, 1 - abs(pos - 0.55) * 1.2)) ELSE 1 END AS weight FROM s)
SELECT segment, metric, CAST(round_even(least(100, CASE WHEN coverage < 0.35 THEN least(weight, 15) ELSE weight END), 0) AS BIGINT) AS weight,
  concat_ws('; ', CASE WHEN metric = 'competition' AND pos >= 0.7 THEN '{vocab.NOTE_CROWDED}' END,
    CASE WHEN coverage < 0.35 THEN metric || ': cobertura baja (' || printf('%.2f', coverage) || ')' END) AS notes FROM w""",
)
def weights_from_profile(spark, folder):
    rows = cut_lineage(profile_input(spark, folder))
    profile = weights.profile_metrics(rows, PROFILED, ["segment"])
    out = weights.weights_from_profile(profile, ["segment"])
    return out.select("segment", "metric", "weight", F.array_join("notes", "; ").alias("notes"))


@query(
    "weights_by_correlation",
    """WITH c AS (SELECT abs(corr(l_extendedprice, l_quantity * l_extendedprice)) AS price, abs(corr(l_quantity, l_quantity * l_extendedprice)) AS units_sold,
  abs(corr(l_discount, l_quantity * l_extendedprice)) AS rating FROM lineitem),
f AS (SELECT unnest(['price', 'units_sold', 'rating', 'desire']) AS feature, unnest([price, units_sold, rating, 0]) AS c, greatest(price, units_sold, rating) AS best FROM c)
SELECT feature, ROUND(c, 6) AS correlation, CAST(round_even(c / best * 100, 0) AS BIGINT) AS weight FROM f""",
)
def weights_by_correlation(spark, folder):
    rows = fr.table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("units_sold"), F.col("l_discount").alias("rating"),
        F.lit(1.0).alias("desire"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("target"),
    )
    return rounded(weights.weights_by_correlation(rows, ["price", "units_sold", "rating", "desire"], "target"), 6)


@query(
    "weights_inverse_mean",
    fr.with_views(fr.SCORES)
    + "SELECT metric, ROUND(inv * 6 / SUM(inv) OVER (), 6) AS weight FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, 1 / (AVG({m}) + 1e-6) AS inv FROM latest" for m in vocab.SUB_SCORES)
    + ")",
)
def weights_inverse_mean(spark, folder):
    return rounded(weights.weights_inverse_mean(fr.scores(spark, folder)), 6)


def sample_products(spark, folder):
    """Products whose extras carry revenue, and units for every third one."""
    products = fr.products(spark, folder)
    extra = F.map_filter(
        F.create_map(
            F.lit("revenue"), F.when(F.col("size") % 4 != 0, F.col("revenue").cast("string")),
            F.lit("units"), F.when(F.col("size") % 3 == 0, F.col("units_sold").cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return products.select("id", extra.alias("extra"))


def rubric_scores(spark, folder):
    """Score rows whose breakdown holds the rubric marks; some lack one."""
    marks = F.create_map(
        *[
            x
            for i, f in enumerate(vocab.RUBRIC_FIELDS)
            for x in (F.lit(f), ((F.col("id") + i) % 5 + 1).cast("double"))
        ]
    )
    complete = F.when(F.col("id") % 11 == 0, F.map_filter(marks, lambda k, _: k != "escalabilidad")).otherwise(marks)
    return fr.scores(spark, folder).select("id", "product_id", "created_at", complete.alias("breakdown"))


@query(
    "weight_samples",
    fr.with_views(fr.PRODUCTS, fr.SCORES)
    + """, s AS (SELECT id, CASE WHEN size % 4 <> 0 THEN revenue END AS r, CASE WHEN size % 3 = 0 THEN units_sold END AS u FROM products),
sticky AS (SELECT r IS NOT NULL AS by_revenue FROM s WHERE r IS NOT NULL OR u IS NOT NULL ORDER BY id LIMIT 1)
SELECT s.id, ROUND(CASE WHEN by_revenue THEN COALESCE(r, u) ELSE COALESCE(u, r) END, 4) AS success,
  """ + ", ".join(f"CAST((l.id + {i}) % 5 + 1 AS DOUBLE) AS {f}" for i, f in enumerate(vocab.RUBRIC_FIELDS)) + """
FROM s CROSS JOIN sticky JOIN latest l ON s.id = l.product_id
WHERE l.id % 11 <> 0 AND COALESCE(r, u) IS NOT NULL
ORDER BY s.id LIMIT 50""",
)
def weight_samples(spark, folder):
    return rounded(weights.weight_samples(sample_products(spark, folder), rubric_scores(spark, folder)))
