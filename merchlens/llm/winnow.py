"""Document fingerprints of product descriptions by winnowing, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens.llm.common import partitions, text_key

GRAM = 4  # words; a power of two, as gram hashes are built by doubling
HASH_BITS, PLACE_BITS = 33, 30  # of an entry's 63; a text of 2 GB has fewer words than 2^30
WINDOW = 8  # grams; a power of two, as window minima are built by doubling


def _doubled(df: DataFrame, array: str, size: int, join) -> DataFrame:
    """Joins each element of ``array`` with the ``size - 1`` after it by repeated doubling.

    Entry i of the result covers entries i .. i + size - 1; there are ``size - 1`` fewer. Each
    step is a column of its own, so that it is worked out once.
    """
    step = 1
    while step < size:
        rest = F.greatest(F.size(array) - step, F.lit(0))
        df = df.withColumn("_a", F.slice(array, F.lit(1), rest)).withColumn("_b", F.slice(array, F.lit(step + 1), rest))
        df = df.withColumn(array, F.zip_with("_a", "_b", join)).drop("_a", "_b")
        step *= 2
    return df


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the winnowed fingerprint of column ``text``, an array of hashes with positions.

    The text's lower-cased words are hashed and joined to rolling hashes of ``gram`` words. Of
    every ``window`` grams in a row the smallest hash is chosen, of equal ones the rightmost;
    it is kept once, with its position. So any run of ``window + gram - 1`` words that two texts
    share puts a common hash into both. A text of fewer words than a gram has its words as one
    gram, one of fewer grams than a window has one window; without words there is nothing.

    An entry is one long: the gram hash's upper bits, then its position counted down, so that
    the smallest entry is the smallest hash and, among equal ones, the one furthest right.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\S+"), F.lit(0))
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.array_repeat(F.xxhash64(F.array_join(F.transform("_h", lambda h: h.cast("string")), " ")), gram)
    df = df.withColumn("_h", F.when(F.size("_h").between(1, gram - 1), whole).otherwise(F.col("_h")))
    df = _doubled(df, "_h", gram, lambda a, b: F.xxhash64(a, b))
    entry = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(F.lit((1 << PLACE_BITS) - 1) - i)
    df = df.withColumn("_p", F.transform("_h", entry)).drop("_h")
    df = df.withColumn("_one", F.when(F.size("_p").between(1, window - 1), F.array(F.array_min("_p"))))
    df = _doubled(df, "_p", window, lambda a, b: F.least(a, b))
    return df.withColumn(out, F.array_distinct(F.coalesce("_one", "_p"))).drop("_p", "_one")


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as ``position:hash`` entries in order, hashes in hexadecimal."""
    place = lambda e: F.lit((1 << PLACE_BITS) - 1) - e.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    entry = lambda e: F.concat(place(e).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(e, PLACE_BITS))))
    return F.array_join(F.transform(fingerprint, entry), " ")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda e: F.shiftright(e, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _range_of(id: Column, borders: list[int]) -> Column:
    """Index of the first border that is not below ``id``; found in two steps of about its square root."""
    step = max(1, int(len(borders) ** 0.5))
    blocks = [borders[i : i + step] for i in range(0, len(borders), step)]
    longs = lambda values: F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")
    below = lambda values: F.size(F.filter(values, lambda b: b < id))
    block = below(longs([b[-1] for b in blocks]))
    inner = F.get(F.array(*[longs(b) for b in blocks]), block)
    return block * step + F.coalesce(below(inner), F.lit(0))


def range_tops(products: DataFrame, id: str, ranges: int) -> list[int]:
    """The largest id of each of about ``ranges`` ranges of ids with similar row counts, rising.

    As many numbers as there are ranges come to the driver, whatever the table's size.
    """
    cuts = products.approxQuantile(id, [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    known = products.where(F.col(id).isNotNull())
    number = _range_of(F.col(id), sorted({int(c) for c in cuts})) if cuts else F.lit(0)
    return sorted(r[0] for r in known.groupBy(number.alias("range")).agg(F.max(id)).select(f"max({id})").collect())


def with_next(products: DataFrame, id: str, carried: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``next_<c>`` of the next record in order of falling id; after the last comes the first.

    Records are dealt to ``ranges`` ranges of ids (twice the shuffle partitions if not given),
    each ordered by itself. The top record of a range is also copied to the end of the range
    above it, so no range waits for another. Records with one id are ordered by the digest
    ``_key``; those without an id come last.
    """
    tops = range_tops(products, id, ranges or 2 * partitions(products.sparkSession))
    number = F.coalesce(_range_of(F.col(id), tops), F.lit(0)) if tops else F.lit(0)
    cell = lambda number, order: F.struct(number.cast("int").alias("range"), F.lit(order).alias("order"))
    copies = [F.when(F.col(id).eqNullSafe(F.lit(tops[-1] if tops else None).cast("long")), cell(F.lit(0), 2))]
    if len(tops) > 1:
        is_top = F.coalesce(F.get(F.expr("array(" + ", ".join(f"{t}L" for t in tops) + ")"), number) == F.col(id), F.lit(False))
        copies.append(F.when(is_top & (number < len(tops) - 1), cell(number + 1, 1)))
    cells = F.filter(F.array(cell(number, 0), *copies), lambda c: c.isNotNull())
    order = Window.partitionBy("_cell.range").orderBy("_cell.order", F.desc_nulls_last(id), "_key")
    return (
        products.withColumn("_cell", F.explode(cells))
        .select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
        .where(F.col("_cell.order") == 0)
        .drop("_cell")
    )


def fingerprint_edits(products: DataFrame, id: str = "id", text: str = "description") -> DataFrame:
    """One row per product: its fingerprint, that of its edited description, and likenesses.

    A description is edited by replacing its last floor(n_chars / 2) characters with as many
    first ones (or all) of the next product's, in order of falling id; after the last comes the
    first. Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; fingerprints as text by :func:`as_text`, likenesses as the share of chosen
    hashes that two fingerprints have in common (:func:`likeness`).

    Equal texts have equal fingerprints. A missing text is empty; an empty one has the empty
    fingerprint, which is wholly like another empty one. A product alone in the table is its
    own next. Rows that share an id follow each other in order of their text's digest, rows
    without an id come last; ids are whole numbers, as their order is cut into ranges. Further
    columns are ignored whatever their names; an empty table gives no rows.
    """
    texts = products.select(
        F.col(id).alias("id"), text_key(F.col(text)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    printed = with_fingerprint(texts, "text", "print")
    paired = with_next(printed, "id", ["text", "print"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substr(F.col("next_text"), F.lit(1), half))
    paired = with_fingerprint(paired.withColumn("edited", edited).drop("next_text"), "edited", "edited_print")
    for name in ("print", "edited_print", "next_print"):
        paired = paired.withColumn(f"{name}_hashes", hashes(F.col(name)))
    return paired.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print_hashes"), F.col("edited_print_hashes")).alias("near_edited"),
        likeness(F.col("print_hashes"), F.col("next_print_hashes")).alias("near_next"),
    )
