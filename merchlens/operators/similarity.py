"""How many other products share at least two name tokens.

:func:`similar_up_to` answers "how many, up to a limit", which is all a label needs, and is
linear in the names: token pairs are counted first, and only names whose every pair is rare
are compared, with a handful of partners each.

:func:`name_similarity` gives the full count. It is exact and never pairs up the members of
a large group:

* equal names collapse to one row with a count;
* tokens carried by few distinct names (``light``) are joined, each such group being small;
* names that meet only on frequent tokens (``heavy``) are counted without being formed as pairs.
  Names merge into distinct sets of heavy tokens, sets are numbered in blocks, and each frequent
  token is a bitmap over a block. A probing set adds its tokens' bitmaps into a two-bit counter
  for all sets of the block at once; what reaches two is weighed by how many products the sets
  hold. The work grows with a name's tokens, never with their combinations.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions.text import name_tokens
from merchlens.session import cut_lineage

LIGHT_GROUP = 64
BLOCK = 8192  # sets of heavy tokens whose bitmaps a task holds


def _names(df: DataFrame, name: str) -> DataFrame:
    """Distinct token lists: ``key``, distinct ``tokens``, ``repeated`` ones, ``count``."""
    words = F.array_sort(name_tokens(F.col(name)))
    repeated = F.array_distinct(
        F.filter("words", lambda w: F.size(F.filter("words", lambda v: v == w)) > 1)
    )
    return (
        df.select(words.alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.array_join("words", " ").alias("key"),
            F.array_distinct("words").alias("tokens"),
            repeated.alias("repeated"),
            "count",
        )
    )


def _meets(shared: Column, repeated: Column) -> Column:
    """Two shared tokens, or one that the probing name repeats."""
    return (F.size(shared) >= 2) | F.arrays_overlap(shared, repeated)


def _triggers(tokens: Column, repeated: Column) -> Column:
    """What two names have to share to be similar: any token pair, or one repeated token."""

    def with_later(token: Column, i: Column) -> Column:
        later = F.slice(tokens, i + 2, F.size(tokens))
        return F.transform(later, lambda other: F.concat_ws(" ", token, other))

    return F.concat(F.flatten(F.transform(tokens, with_later)), repeated)


def similar_up_to(df: DataFrame, limit: int, name: str = "name") -> DataFrame:
    """``id`` and ``similar_at_least``: other products sharing two name tokens, counted up to ``limit``.

    Below the limit the count is exact; at the limit it means "that many or more". The full
    count is :func:`name_similarity`.
    """
    names = cut_lineage(_names(df, name))
    wanted = names.select("key", "count", F.explode(_triggers(F.col("tokens"), F.col("repeated"))).alias("trigger"))
    # a name answers to its token pairs and, for names that repeat a token, to single tokens
    doubled = cut_lineage(names.select(F.explode("repeated").alias("trigger")).distinct())
    singles = names.select("key", "count", F.explode("tokens").alias("trigger")).join(doubled, "trigger", "left_semi")
    pairs = names.select("key", "count", F.explode(_triggers(F.col("tokens"), F.array().cast("array<string>"))).alias("trigger"))
    offered = pairs.unionByName(singles.select("key", "count", "trigger"))
    holders = cut_lineage(offered.groupBy("trigger").agg(F.sum("count").alias("products")))
    # Spark takes exploded rows for no more than the names they come from, and would broadcast them all
    rated = wanted.hint("merge").join(holders, "trigger")
    many = cut_lineage(rated.groupBy("key").agg((F.max("products") - 1 >= limit).alias("many")))
    few = many.where(~F.col("many")).select("key")
    # every trigger left is held by at most ``limit`` products
    probes = rated.where(F.col("products") <= limit).hint("merge").join(few, "key", "left_semi").select("key", "trigger")
    partners = offered.select(F.col("key").alias("other"), "trigger", F.col("count").alias("other_count"))
    met = probes.hint("merge").join(partners, "trigger").select("key", "other", "other_count").distinct()
    exact = met.groupBy("key").agg(F.sum("other_count").alias("met"))
    counts = many.hint("merge").join(exact, "key", "left").select(
        "key",
        F.when(F.col("many"), limit)
        .otherwise(F.least(F.lit(limit), F.coalesce("met", F.lit(1)) - 1))
        .cast("long")
        .alias("_similar"),
    )
    return _per_product(df, name, counts, "similar_at_least")


def _per_product(df: DataFrame, name: str, counts: DataFrame, out: str = "similar_names") -> DataFrame:
    keyed = df.select("id", F.array_join(F.array_sort(name_tokens(F.col(name))), " ").alias("key"))
    return keyed.join(counts, "key", "left").select(
        "id", F.coalesce("_similar", F.lit(0)).cast("long").alias(out)
    )


def name_similarity(df: DataFrame, name: str = "name", light_group: int = LIGHT_GROUP, block: int = BLOCK) -> DataFrame:
    """``id`` and ``similar_names``: other products sharing two name tokens or more.

    A token the probing name repeats counts twice on its side and once on the other's. Tokens of
    more than ``light_group`` distinct names are counted by bitmaps over blocks of about ``block``
    distinct sets of such tokens. A missing name, or one without tokens, is similar to none.
    """
    names = cut_lineage(_names(df, name))
    spread = names.select("key", F.explode("tokens").alias("token"))
    frequency = spread.groupBy("token").agg(F.count(F.lit(1)).alias("names"))
    heavy = frequency.where(F.col("names") > light_group).select("token")

    light_rows = spread.join(heavy, "token", "left_anti")
    heavy_rows = spread.join(heavy, "token", "left_semi")
    heavy_sets = heavy_rows.groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("heavy"))
    facts = cut_lineage(
        names.join(heavy_sets, "key", "left").withColumn("heavy", F.coalesce("heavy", F.array().cast("array<string>")))
    )

    near = _through_light_tokens(light_rows, facts)
    far = _through_heavy_tokens(facts, block)
    own = F.when(_meets(F.col("tokens"), F.col("repeated")), 1).otherwise(0)
    counts = (
        facts.select("key", own.alias("own"))
        .join(near, "key", "left")
        .join(far, "key", "left")
        .select(
            "key",
            (F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0)) - F.col("own"))
            .cast("long")
            .alias("_similar"),
        )
    )
    return _per_product(df, name, counts)


def _through_light_tokens(light_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Weighted count of names met on a light token, less those the heavy part counts too."""
    probe = light_rows.select(F.col("key").alias("key"), "token")
    other = light_rows.select(F.col("key").alias("other"), "token")
    pairs = probe.join(other, "token").select("key", "other").distinct()
    left = facts.select("key", "tokens", "repeated", "heavy")
    right = facts.select(
        F.col("key").alias("other"),
        F.col("tokens").alias("o_tokens"),
        F.col("heavy").alias("o_heavy"),
        F.col("count").alias("o_count"),
    )
    checked = pairs.join(left, "key").join(right, "other")
    meets = _meets(F.array_intersect("tokens", "o_tokens"), F.col("repeated")).cast("int")
    elsewhere = _meets(F.array_intersect("heavy", "o_heavy"), F.col("repeated")).cast("int")
    return checked.groupBy("key").agg(F.sum((meets - elsewhere) * F.col("o_count")).alias("near"))


def _through_heavy_tokens(facts: DataFrame, block: int) -> DataFrame:
    """Weighted count of names that meet on heavy tokens alone, block by block of their sets."""
    holders = facts.where(F.size("heavy") > 0).withColumn(
        "doubled", F.array_sort(F.array_intersect("heavy", "repeated"))
    )
    sets = cut_lineage(
        holders.groupBy("heavy").agg(F.sum("count").alias("products"), F.collect_set("doubled").alias("probes"))
    )
    blocks = max(1, ceil(sets.count() / block))
    number = F.pmod(F.xxhash64("heavy"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    probes = sets.select("heavy", F.explode("probes").alias("doubled"), number.alias("asking")).withColumn("held", every)
    held = sets.select("heavy", "products", number.alias("held")).withColumn("asking", every)
    by = ["asking", "held"]
    met = probes.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(
        _meet_block, "heavy array<string>, doubled array<string>, met long"
    )
    far = met.groupBy("heavy", "doubled").agg(F.sum("met").alias("far"))
    return holders.join(far, ["heavy", "doubled"]).select("key", "far")


def _meet_block(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """How many products of the held sets share two tokens with each probing set, or one of its doubled."""
    if not len(probes) or not len(held):
        return pd.DataFrame({"heavy": pd.Series([], dtype=object), "doubled": pd.Series([], dtype=object), "met": pd.Series([], dtype="int64")})
    tokens = pd.Index(np.unique(np.concatenate(held["heavy"].to_list())))
    words = -(-len(held) // 64)
    bitmaps = np.zeros((len(tokens) + 1, words * 8), np.uint8)  # the last stands for tokens nobody holds
    sizes = held["heavy"].str.len().to_numpy()
    place = np.repeat(np.arange(len(held)), sizes)
    np.bitwise_or.at(
        bitmaps, (tokens.get_indexer(np.concatenate(held["heavy"].to_list())), place >> 3), np.uint8(1) << (place & 7).astype(np.uint8)
    )
    bitmaps = bitmaps.view(np.uint64)
    products = held["products"].to_numpy()
    digits = [
        np.packbits(np.pad((products >> d) & 1, (0, words * 64 - len(held))).astype(np.uint8), bitorder="little").view(np.uint64)
        for d in range(int(products.max()).bit_length())
    ]

    def columns(lists: pd.Series) -> np.ndarray:
        """Token numbers, one row a probe, filled up with the empty bitmap."""
        length = lists.str.len().to_numpy()
        out = np.full((len(lists), max(1, int(length.max()))), len(tokens))
        if length.sum():
            found = tokens.get_indexer(np.concatenate([x for x in lists if len(x)]))
            out[np.arange(out.shape[1])[None, :] < length[:, None]] = np.where(found < 0, len(tokens), found)
        return out

    shared, doubled = columns(probes["heavy"]), columns(probes["doubled"])
    met = np.zeros(len(probes), np.int64)
    step = max(1, (1 << 21) // words)  # probes at a time, for bitmaps of 16 MB
    for a in range(0, len(probes), step):
        once = np.zeros((min(step, len(probes) - a), words), np.uint64)
        twice = np.zeros_like(once)
        for token in shared[a : a + step].T:
            bits = bitmaps[token]
            twice |= once & bits
            once |= bits
        for token in doubled[a : a + step].T:
            twice |= bitmaps[token]
        for d, digit in enumerate(digits):
            met[a : a + step] += np.bitwise_count(twice & digit).sum(axis=1).astype(np.int64) << d
    return pd.DataFrame({"heavy": probes["heavy"], "doubled": probes["doubled"], "met": met})
