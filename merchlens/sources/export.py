"""Export jobs: product table, normalised analysis report, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.dates import EXPORT_FORMATS, parse_date, serial_date
from merchlens.functions.numbers import as_int, clamp, half_even, parse_us
from merchlens.functions.text import clean_name, header_key, lookup
from merchlens.operators.latest import attach_latest_score, latest_score
from merchlens.operators.ranks import fill_by_rank
from merchlens.session import cut_lineage

RANK_TOP = 10


def export_table(products: DataFrame, scores: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Eight columns of selected or all products with their newest score."""
    rows = products.where(F.col("id").isin(ids)) if ids else products
    scored = attach_latest_score(rows, scores, ["winner_score"])
    source = [
        F.col("id"), F.coalesce(clean_name(F.col("name")), F.lit("")), F.col("winner_score"),
        F.col("desire"), F.col("desire_magnitude"), F.col("awareness_level"),
        F.col("competition_level"), F.col("date_range"),
    ]
    return scored.select(*[c.alias(n) for c, n in zip(source, vocab.EXPORT_TABLE_COLUMNS)])


def rank_report(products: DataFrame, scores: DataFrame, top: int | None = RANK_TOP) -> DataFrame:
    """Newest scores by total, best first; ``top`` None gives the whole list."""
    columns = ["total_score", *vocab.SUB_SCORES, "summary"]
    newest = latest_score(scores).select(F.col("product_id").alias("id"), *columns)
    rows = products.select("id", "name").join(newest, "id").orderBy(F.desc("total_score"), "id")
    return rows if top is None else rows.limit(top)


def canonical_order(df: DataFrame) -> DataFrame:
    """Known headers renamed and moved to the front in report order, the others behind.

    A column called ``image`` is dropped where the report already has a preview column.
    """
    by_lower = {c.lower(): c for c in df.columns}
    renamed: dict[str, str] = {}
    for target, headers in vocab.EXPORT_HEADER_SYNONYMS.items():
        found = next((by_lower[h] for h in headers if h in by_lower), None)
        if found is not None and found not in renamed:
            renamed[found] = target
    rest = [c for c in df.columns if c not in renamed]
    if "image preview" in renamed.values():
        rest = [c for c in rest if c.lower() != "image"]
    return df.select(*[F.col(f"`{c}`").alias(t) for c, t in renamed.items()], *[F.col(f"`{c}`") for c in rest])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes a report as CSV (with header), JSON or Parquet, one file per partition."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


# --- analysis report ------------------------------------------------------------------


def _present(value: Column) -> Column:
    text = F.trim(value)
    return F.when((text != "") & ~F.lower(text).isin(vocab.MISSING_WORDS), value)


def _cells(df: DataFrame) -> Column:
    """All present values of a row by spelling: columns first, then extra cells as written,
    in lower case, and reduced to letters and digits. The first spelling of a key wins."""
    columns = [c for c in df.columns if c != "extra"]
    own = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]
    own += [
        F.struct(F.lit(header_key(c)).alias("key"), F.col(c).cast("string").alias("value"))
        for c in columns
        if header_key(c) != c
    ]
    extra = F.reverse(F.map_entries("extra"))

    def respelled(spell) -> Column:
        return F.transform(extra, lambda e: F.struct(spell(e["key"]).alias("key"), e["value"].alias("value")))

    entries = F.concat(
        F.array(*own),
        extra,
        respelled(F.lower),
        respelled(lambda k: F.regexp_replace(F.lower(k), r"[^\p{L}\p{N}]", "")),
    )
    known = F.filter(entries, lambda e: e["key"].isin(_known_spellings()))
    # most headers are spelled alike in several forms: keep the first of equal cells
    return F.filter(F.array_distinct(known), lambda e: _present(e["value"]).isNotNull())


def _as_lookup(cells: Column) -> Column:
    """A map of the cells; of equal keys the first counts."""
    keys = F.transform(cells, lambda e: e["key"])
    first = F.filter(cells, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(first)


def _known_spellings() -> list[str]:
    """Every spelling the report looks for."""
    keys = [k for table in (vocab.EXPORT_TEXT_KEYS, vocab.EXPORT_NUMBER_KEYS) for ks in table.values() for k in ks]
    keys += [k for ks in vocab.EXPORT_REVENUE_KEYS for k in ks]
    return sorted({s for key in keys for s in _spellings(key)})


def _spellings(key: str) -> list[str]:
    compact = key.replace(" ", "")
    return list(dict.fromkeys([key, key.lower(), header_key(key), compact, compact.lower()]))


def _seek(keys: list[str]) -> Column:
    """First present value over keys and their spellings."""
    spellings = dict.fromkeys(s for key in keys for s in _spellings(key))
    wanted = F.split(F.lit("\n".join(spellings)), "\n")
    found = F.transform(wanted, lambda s: F.try_element_at("_lookup", s))
    return F.get(F.filter(found, lambda v: v.isNotNull()), 0)


def _percent_score(number: Column) -> Column:
    return as_int(clamp(F.when(number <= 1.0, number * 100.0).otherwise(number), 0.0, 100.0))


def _awareness_stage(number: Column) -> Column:
    return clamp(as_int(F.when(number <= 1.0, number * 4).otherwise(number)), 0, 4).cast("int")


def _awareness(stage: Column, text: Column) -> Column:
    return F.coalesce(lookup(stage, dict(enumerate(vocab.EXPORT_AWARENESS_LABELS))), F.trim(text), F.lit(""))


def _competition(number: Column, text: Column) -> Column:
    share = F.when(number <= 1.0, number).otherwise(number / 100.0)
    band = F.when(share < 0.35, "Low").when(share < 0.7, "Medium").when(share.isNotNull(), "High")
    return F.coalesce(band, F.trim(text), F.lit(""))


def _launch(c: Column) -> Column:
    """ISO day as text; spreadsheet day numbers are converted, other text is kept."""
    text = F.trim(c)
    serial = F.when(text.rlike(r"^\d+(\.\d+)?$"), serial_date(text.try_cast("double")))
    day = F.coalesce(serial, parse_date(text, EXPORT_FORMATS))
    return F.coalesce(day.cast("string"), text, F.lit(""))


def export_analysis(products: DataFrame) -> DataFrame:
    """The fifteen-column report: synonyms resolved, four revenue channels summed, labels
    mapped, and missing desire magnitudes filled from the units and rating percentiles."""
    extra = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
    cells = products.withColumn("extra", extra)
    # generators keep the lookup from being worked out again for every field
    cells = cells.select("id", F.explode(F.array(_cells(cells))).alias("_cells"))
    rows = cells.select("id", F.explode(F.array(_as_lookup(F.col("_cells")))).alias("_lookup"))
    wanted = {**vocab.EXPORT_TEXT_KEYS, **vocab.EXPORT_NUMBER_KEYS}
    wanted |= {f"channel_{i}": keys for i, keys in enumerate(vocab.EXPORT_REVENUE_KEYS)}
    found = rows.select("id", F.inline(F.array(F.struct(*[_seek(k).alias(n) for n, k in wanted.items()]))))
    # parsed once each, before anything builds on the numbers
    scored = ("desire_magnitude", "desire_score", "desire", "awareness_level", "competition_level")
    channels = [f"channel_{i}" for i in range(len(vocab.EXPORT_REVENUE_KEYS))]
    parsed = {f"{n}_number": parse_us(F.col(n)) for n in (*scored, *vocab.EXPORT_NUMBER_KEYS, *channels)}
    parsed = found.withColumns(parsed).withColumn("stage", _awareness_stage(F.col("awareness_level_number")))
    text = {name: F.col(name) for name in vocab.EXPORT_TEXT_KEYS}
    number = {name: F.col(f"{name}_number") for name in (*scored, *vocab.EXPORT_NUMBER_KEYS)}
    revenue = [F.coalesce(F.col(f"{c}_number"), F.lit(0.0)) for c in channels]
    magnitude = F.coalesce(
        *[
            F.when(text[k].isNotNull(), F.coalesce(_percent_score(number[k]), F.lit(-1)))
            for k in ("desire_magnitude", "desire_score")
        ],
        _percent_score(number["desire"]),
    )
    draft = parsed.select(
        F.col("id"),
        F.coalesce(clean_name(F.trim(text["name"])), F.lit("")).alias("name"),
        F.coalesce(F.trim(text["category"]), F.lit("")).alias("category"),
        _launch(text["launch_date"]).alias("launch_date"),
        half_even(number["price"], 2).alias("price"),
        half_even(number["rating"], 2).alias("rating"),
        half_even(sum(revenue[1:], revenue[0]), 2).alias("revenue"),
        as_int(number["items_sold"]).alias("items_sold"),
        F.coalesce(F.trim(text["desire"]), F.lit("")).alias("desire"),
        F.nullif(magnitude, F.lit(-1)).alias("desire_magnitude"),
        _awareness(F.col("stage"), text["awareness_level"]).alias("awareness_level"),
        _competition(number["competition_level"], text["competition_level"]).alias("competition_level"),
        *[F.coalesce(F.trim(text[k]), F.lit("")).alias(k) for k in ("tiktok_url", "kalodata_url", "img_url")],
    )
    # the ranks read the draft several times: resolve the synonyms only once
    filled = fill_by_rank(cut_lineage(draft), "desire_magnitude", "items_sold", "rating")
    preview = F.lit(None).cast("string")
    source = [
        preview, *[F.col(c) for c in (
            "name", "category", "launch_date", "price", "rating", "revenue", "items_sold", "desire",
            "desire_magnitude", "awareness_level", "competition_level", "tiktok_url", "kalodata_url", "img_url",
        )],
    ]
    return filled.select("id", *[c.alias(n) for c, n in zip(source, vocab.EXPORT_COLUMN_ORDER)])
