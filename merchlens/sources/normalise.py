"""Mapped catalogue rows to typed products, and ids in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.functions import vocab
from merchlens.functions.numbers import (
    as_int, digits_only, parse_metric, parse_number, repair_dots, strict_double,
)
from merchlens.functions.text import signature
from merchlens.sources.catalog import FILE_COLUMN, SEQ_COLUMN

TEXT_FIELDS = [
    "description", "currency", "image_url", "desire", "desire_magnitude", "awareness_level",
    "competition_level", "date_range",
]


def _reader(df: DataFrame):
    def read(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return read


def _as_map(entries: dict[str, Column]) -> Column:
    pairs = [x for key, value in entries.items() for x in (F.lit(key), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _merged(other: Column, typed: Column) -> Column:
    """Typed entries plus the remaining cells; a cell of the same name wins, as it comes last."""
    cells = F.coalesce(other, F.create_map().cast("map<string,string>"))
    own = F.map_filter(typed, lambda k, _: ~F.map_contains_key(cells, k))
    return F.map_concat(own, cells)


def normalise_products(
    mapped: DataFrame,
    locale: str = "eu",
    source: str | None = None,
    import_date: Column | None = None,
    numeric_input: bool = False,
) -> DataFrame:
    """Typed product rows; rows without a name are dropped.

    ``locale`` says how numbers are written (``eu`` or ``us``). ``numeric_input`` marks
    cells that were numbers already, as in JSON, and are only cast. Measures without a
    column of their own go to the ``extra`` map.
    """
    read = _reader(mapped)

    def number(name: str) -> Column:
        return strict_double(read(name)) if numeric_input else parse_number(read(name), locale)

    category = F.coalesce(read("category"), read("category_path"))
    path = read("category_path")
    default_source = F.lit(source) if source is not None else read(FILE_COLUMN)
    typed = _as_map(
        {
            "rating": number("rating"),
            "units_sold": as_int(number("units_sold")),
            "revenue": number("revenue"),
            "conversion_rate": number("conversion_rate"),
            "launch_date": F.substring(read("launch_date"), 1, 10),
            "category_path": F.when(~path.eqNullSafe(category), path),
            "brand": read("brand"),
            "asin": read("asin"),
            "product_url": read("url"),
        }
    )
    kept = [SEQ_COLUMN] if SEQ_COLUMN in mapped.columns else []
    return mapped.where(F.col("name").isNotNull()).select(
        *kept,
        signature(read("name"), read("brand"), read("asin"), read("url")).alias("sig_hash"),
        F.col("name"),
        category.alias("category"),
        number("price").alias("price"),
        *[read(f).alias(f) for f in TEXT_FIELDS],
        F.coalesce(read("source"), default_source).alias("source"),
        (F.current_timestamp() if import_date is None else import_date).alias("import_date"),
        as_int(number("winner_score")).cast("int").alias("winner_score"),
        _merged(F.col("other"), typed).alias("extra"),
    )


def normalise_products_contains(mapped: DataFrame) -> DataFrame:
    """Typed rows of the substring mode: repaired numbers, derived revenue, legacy metrics.

    Missing revenue is price x units. Measures are kept under both their spellings.
    """
    read = _reader(mapped)
    price = strict_double(F.replace(read("price"), F.lit(","), F.lit(".")))
    rating, units = repair_dots(read("rating")), digits_only(read("units_sold"))
    revenue = F.coalesce(repair_dots(read("revenue")), price * units)
    typed = _as_map(
        {
            "rating": rating,
            "Product Rating": rating,
            "units_sold": units,
            "Item Sold": units,
            "revenue": revenue,
            "Revenue($)": revenue,
            "conversion_rate": read("conversion_rate"),
            "launch_date": read("launch_date"),
        }
    )
    metrics = [
        (parse_metric(read(m)) if m in vocab.LEGACY_NUMERIC else read(m)).alias(m)
        for m in vocab.LEGACY_METRICS
    ]
    kept = [SEQ_COLUMN] if SEQ_COLUMN in mapped.columns else []
    return mapped.where(F.col("name").isNotNull()).select(
        *kept,
        "name",
        read("description").alias("description"),
        read("category").alias("category"),
        price.alias("price"),
        read("currency").alias("currency"),
        read("image_url").alias("image_url"),
        F.coalesce(read("date_range"), F.lit("")).alias("date_range"),
        _merged(F.col("other"), typed).alias("extra"),
        *metrics,
    )


def assign_ids(df: DataFrame, existing: DataFrame | None = None, sequence: str = SEQ_COLUMN) -> DataFrame:
    """Dense ids in file order: from 1 for an empty catalogue, else from ``max(id) + 2``.

    The base of a filled catalogue is ``max + 1`` and counting starts at one, so one id is
    left out. ``sequence`` comes from :func:`read_catalog`; rows are counted per block of a
    file, which gives every block its offset, and only a block is numbered in one task.
    """
    start = 0
    if existing is not None:
        top = existing.agg(F.max("id")).first()[0]
        start = 0 if top is None else top + 1
    rows = df.withColumn("_part", F.struct(F.col(sequence)["file"], F.col(sequence)["block"]))
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))  # one row per block
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_part").orderBy(sequence)
    numbered = rows.join(offsets, "_part").withColumn(
        "id", F.col("_offset") + F.row_number().over(inside) + F.lit(start)
    )
    return numbered.drop("_part", "_offset")
