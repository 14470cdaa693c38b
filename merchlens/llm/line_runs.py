"""Deletes later copies of line runs that product descriptions repeat, in built-in functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens.llm.common import WORD, stored

MIN_WORDS = 5


def _spoken(lines: Column) -> Column:
    """Positions of the lines that hold a word."""
    held = F.transform(lines, lambda line, i: F.when(F.regexp(line, F.lit(WORD)), i))
    return F.filter(held, lambda i: i.isNotNull())


def _place() -> Column:
    """Where a suffix starts, ordered by id (missing last), text and line."""
    return F.struct(F.col("id").isNull().alias("missing"), "id", "_key", "i")


def line_suffixes(products: DataFrame, min_words: int = MIN_WORDS, id: str = "id", text: str = "description") -> DataFrame:
    """The sequences of line ids: one row per line that holds a word, numbered within its text.

    ``need`` is how many lines from here on it takes to hold ``min_words`` words.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    spoken = F.filter(lines, lambda line: F.regexp(line, F.lit(WORD)))
    texts = products.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), spoken.alias("spoken"))
    counted = texts.withColumn("words", F.transform("spoken", lambda line: F.regexp_count(line, F.lit(WORD))))

    def need(words: Column, i: Column) -> Column:
        none = F.struct(F.lit(0).alias("held"), F.lit(1).alias("lines"))
        add = lambda s, n: F.struct((s["held"] + n).alias("held"), (s["lines"] + (s["held"] + n < min_words).cast("int")).alias("lines"))
        return F.aggregate(F.slice("words", i + 1, min_words), none, add)["lines"]

    rows = counted.select("id", "_key", F.posexplode(F.arrays_zip("spoken", F.transform("words", need).alias("need"))).alias("i", "at"))
    # 96 bits tell lines apart
    return rows.select("id", "_key", "i", F.xxhash64("at.spoken").alias("a"), F.hash("at.spoken").cast("long").alias("b"), F.col("at.need").alias("need"))


def _ranked(suffixes: DataFrame) -> DataFrame:
    """Ranks suffixes by their next lines: equal (a, b) get one rank; those that occur once go.

    ``later`` tells whether an equal run starts earlier. Copies are counted before the shuffle,
    so that a line most texts share costs one row per task.
    """
    ranks = (
        suffixes.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(_place()).alias("first"))
        .where("copies > 1")
        .select("a", "b", "first")
    )
    return suffixes.join(ranks, ["a", "b"]).select(
        "id", "_key", "i", F.xxhash64("a", "b").alias("rank"), (_place() != F.col("first")).alias("later"), "need"
    )


def repeated_runs(products: DataFrame, min_words: int = MIN_WORDS, id: str = "id", text: str = "description") -> DataFrame:
    """Lines that lie in a repeated run of at least ``min_words`` words starting earlier elsewhere.

    A suffix array over the line-id sequences by prefix doubling: suffixes are ranked by their
    first 2^k lines, from the pairs of ranks of half as many. Runs of any other length between
    2^k and 2^(k + 1) get their ranks from two runs of 2^k lines that overlap. Suffixes of one
    rank are copies of the first of them. As a line that counts holds a word, every run of
    ``min_words`` lines is long enough, and a longer one consists of such runs: lengths from 1 to
    ``min_words`` find each line of every maximal run, and stand in for the intervals of a
    longest-common-prefix array; with a large ``min_words`` each length costs a join.
    Returns ``id, _key, i``, each line once; i counts the lines that hold a word.
    """
    base, span, deleted = stored(_ranked(line_suffixes(products, min_words, id, text)), "line-ranks"), 1, []
    for width in range(1, min_words + 1):
        runs = base
        if width > 1:
            shift = width - span
            after = Window.partitionBy("id", "_key").orderBy("i").rangeBetween(shift, shift)
            pairs = base.withColumn("next", F.first("rank").over(after)).where(F.col("next").isNotNull())
            pairs = pairs.select("id", "_key", "i", F.col("rank").alias("a"), F.col("next").alias("b"), "need")
            # runs that later rounds don't build on are ranked only if they hold enough words
            runs = stored(_ranked(pairs if width == 2 * span else pairs.where(F.col("need") <= width)), "line-ranks")
        long = runs.where(F.col("later") & (F.col("need") <= width))
        deleted.append(long.select("id", "_key", F.explode(F.sequence(F.col("i"), F.col("i") + width - 1)).alias("i")))
        if width == 2 * span:
            base, span = runs, width
    return reduce(DataFrame.unionByName, deleted).distinct()


def dedup_lines(
    products: DataFrame, min_words: int = MIN_WORDS, carry: tuple[str, ...] = (), id: str = "id", text: str = "description"
) -> DataFrame:
    """One row per product: its description without later copies of repeated line runs.

    Lines end at a line feed. A run is a number of consecutive lines, lines without a word left
    out of the count; of equal runs the first by id, then line, stays. A line goes if it lies in
    a run, of any number of lines, with ``min_words`` words or more that occurs earlier, be it in
    the same text. Lines without a word stay.

    Returns ``id, n_lines, n_removed, n_runs, description``: the lines, those deleted, the
    stretches of lines they form, and what is left, then the columns named in ``carry``. A missing description stays missing, with
    one empty line. Products that share an id are ordered by a hash of the text; rows equal in
    id and text are one product, each gets its result. A NULL id comes last. Further columns
    are ignored whatever their names; an empty table gives no rows.
    """
    gone = repeated_runs(products, min_words, id, text).groupBy("id", "_key").agg(F.collect_set("i").alias("gone"))
    gone = gone.withColumnsRenamed({"id": "_id", "_key": "_of"})
    texts = products.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.struct(*carry).alias("_carried") if carry else F.lit(None).alias("_carried"))
    joined = texts.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    lines = joined.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn(
        "spoken", F.when(F.col("gone").isNotNull(), _spoken(F.col("lines")))
    )
    cut = lines.withColumn("cut", F.coalesce(F.transform("gone", lambda i: F.get("spoken", i)), F.expr("array()").cast("array<int>")))
    starts = F.array_except("cut", F.transform("cut", lambda p: p + 1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut")), lambda p: F.get("lines", p))
    return cut.select(
        "id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("cut").cast("long").alias("n_removed"),
        F.size(starts).cast("long").alias("n_runs"),
        F.when(F.size("cut") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("description"),
        *[F.col("_carried")[c].alias(c) for c in carry],
    )
