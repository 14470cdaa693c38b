"""The package's queries: thin steps from the given tables to product records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm import decontaminate, exact, language, licenses, line_runs, minhash, mixing, phrases, suffixes, tokens, treap, warc, winnow
from merchlens.llm.common import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def products(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as product records: id, description, source."""
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"), "source"
    )


@query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(products(spark, folder)).withColumnRenamed("id", "doc_id")


@query("op2_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.fingerprint_edits(products(spark, folder)).withColumnRenamed("id", "doc_id")


TOKENIZER = "byte_bpe_50k.json"


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    cache = scratch(spark, "token-counts")
    counted = tokens.count_tokens(products(spark, folder), cache, public_tokenizers.path(TOKENIZER))
    return counted.withColumnRenamed("id", "doc_id")


@query("op8_source_mix")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(products(spark, folder)).withColumnRenamed("id", "doc_id").drop("text_digest")


# Runs of 1 to 5 lines by their text: every run of five words or more consists of such runs that hold five words.
OP9_SQL = """
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
every AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM split),
spoken AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM every),
numbered AS (SELECT doc_id, pos, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM spoken WHERE words > 0),
runs AS (
  SELECT doc_id, i, width,
    string_agg(line, chr(10)) OVER w AS run, sum(words) OVER w AS words, count(*) OVER w AS held
  FROM numbered, (VALUES (1), (2), (3), (4), (5)) AS widths(width)
  WINDOW w AS (PARTITION BY doc_id, width ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING)),
later AS (
  SELECT doc_id, i, width, words, row_number() OVER (PARTITION BY width, run ORDER BY doc_id, i) AS copy
  FROM runs WHERE held = width),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + width - 1)) AS i FROM later WHERE copy > 1 AND words >= 5),
marked AS (
  SELECT e.doc_id, e.pos, e.line, g.i IS NOT NULL AS cut
  FROM every e LEFT JOIN numbered n ON n.doc_id = e.doc_id AND n.pos = e.pos LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i),
edged AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE starts) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM edged GROUP BY doc_id
"""


@query("op9_line_runs", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_runs.dedup_lines(products(spark, folder))
    return kept.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        "n_removed",
        "n_runs",
        F.sha2(F.encode(F.coalesce("description", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM f
"""


@query("op10_page_archive", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(F.col("page_id").alias("id"), "url", "html")
    records = warc.archive_pages(pages, scratch(spark, "warc"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    labelled = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("lang").alias("language")
    )
    found = language.identify_languages(labelled)
    return found.select(F.col("id").alias("doc_id"), "held_out", F.col("language_pred").alias("lang_pred"), "score")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("description"))


@query("op3_question_leaks")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_questions(products(spark, folder), questions(spark, folder))
    return found.select(F.col("id").alias("doc_id"), F.col("question_id").alias("item_id"), "n_windows", "coverage", "changed")


@query("op6_near_duplicates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(products(spark, folder), width=2)
    return found.withColumnRenamed("id", "doc_id")


@query("op4_repeated_bytes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffixes.remove_repeats(products(spark, folder))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words),
runs AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM placed, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n FROM f WHERE k > 1),
inner_runs AS (
  SELECT c.lang, array_to_string(list_slice(c.w, i, i + s.k - 1), ' ') AS phrase, max(c.n) AS longer
  FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM candidates) c, (VALUES (2), (3), (4)) AS s(k)
  WHERE s.k < c.k AND i + s.k - 1 <= c.k GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_runs r ON r.lang = c.lang AND r.phrase = c.phrase
  WHERE r.longer IS NULL OR 100 * r.longer < 100 * c.n),
cuts AS (
  SELECT lang, phrase, n, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, k), ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.n AS a, h.n AS l, t.n AS r, totals.n AS n, c.cut,
    (1000 * c.n::HUGEINT * totals.n::HUGEINT) // (h.n::HUGEINT * t.n::HUGEINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN totals ON totals.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@query("op11_phrases", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    labelled = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("text").alias("description"), F.col("lang").alias("language"))
    found = phrases.mine_phrases(labelled)
    names = {"language": "lang", "n_phrase": "a", "n_left": "l", "n_right": "r", "n_words": "n"}
    return found.withColumnsRenamed(names)


OP12_SQL = """
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
long AS (SELECT doc_id, sum(tf) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS texts, sum(n) AS terms FROM long),
m AS (SELECT doc_id, (75 + (25 * n * texts) // terms)::BIGINT AS m FROM long, whole),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * texts + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term, texts),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
scored AS (
  SELECT item_id, held.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m.m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN held USING (term) JOIN m ON m.doc_id = held.doc_id GROUP BY item_id, held.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_ranked_search", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    index = scratch(spark, "search-index")
    treap.index_products(products(spark, folder), index)
    found = treap.search_products(spark, index, questions(spark, folder))
    return found.withColumnsRenamed({"question_id": "item_id", "id": "doc_id"})


OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
ARRIVALS = 3  # batches, by rising id


@query("op13_exact_dedup", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = products(spark, folder)
    cuts = rows.agg(F.percentile_approx("id", [i / ARRIVALS for i in range(1, ARRIVALS)]).alias("cuts")).head()["cuts"] or []
    batch = sum((F.coalesce((F.col("id") > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    found = exact.dedup_batches([rows.where(batch == i) for i in range(len(cuts) + 1)], scratch(spark, "exact-store"))
    return found.withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})
