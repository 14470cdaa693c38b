"""Mixing products' texts by source to target weights with Sainte-Laguë quotas."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlens.llm.common import WORD, stored, text_key

MOST_EPOCHS = 3
BLOCKS = 1_000_000  # a mix of T words is cut into blocks of about T / BLOCKS words
BLOCK_WORDS = 256  # or of so many, if that is less
SHARD_BLOCKS = 4096  # blocks of a shard, unless the mix then has too many
MOST_SHARDS = 100_000  # beyond one for each source: what the driver plans with


def targets(weights: np.ndarray, sizes: np.ndarray, total: float, most: float = MOST_EPOCHS) -> np.ndarray:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared anew."""
    cap = most * sizes.astype(float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = float(total)
    while free.any():
        share = weights * (left / weights[free].sum())
        above = free & (share >= cap)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = cap[above]
        free &= ~above
        left = max(0.0, total - out[~free].sum())
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Allots ``seats`` by the highest quotients votes / (2 k + 1), k being the seats held so far.

    Ties go to the earlier party; no party gets more than ``most`` seats. All seats but a few per
    party are found at once from a divisor that surely allots too few, the rest one by one.
    """
    votes = np.asarray(votes, float)
    bound = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    bound = np.where(votes > 0, bound, 0)
    held = np.zeros(len(votes), np.int64)
    if seats <= 0 or not votes.sum():
        return held
    held = np.minimum(np.maximum(np.floor(votes * (seats / votes.sum())).astype(np.int64) - 1, 0), bound)
    heap = [(-votes[i] / (2 * int(held[i]) + 1), i) for i in range(len(votes)) if held[i] < bound[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - held.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < bound[i]:
            heapq.heappush(heap, (-votes[i] / (2 * int(held[i]) + 1), i))
    return held


def source_quotas(goal: np.ndarray, sizes: np.ndarray, total: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each source's whole blocks and its words: targets below a block to the word, others in blocks."""
    small = goal < block
    words = np.where(small, np.floor(goal + 0.5), 0).astype(np.int64)
    seats = int(max(0, total - words.sum()) // block)
    whole = sainte_lague(np.where(small, 0.0, goal), seats, (MOST_EPOCHS * sizes) // block)
    return whole, words + whole * block


def mix_sources(
    products: DataFrame,
    seed: int = 7,
    blocks: int = BLOCKS,
    shard_blocks: int = SHARD_BLOCKS,
    id: str = "id",
    text: str = "description",
    source: str = "source",
) -> DataFrame:
    """One row per product: how many of its words a mix of all sources takes.

    Sources, by code point with a missing one last, weigh 1, 2, 3, 1, 2, 3 ... and share as many
    words as there are; a source's target stops at three times its size (:func:`targets`).
    A mix is cut into blocks of equal size. Sources get whole blocks by Sainte-Laguë, one after the
    other to the highest quotient of target and blocks held, as far as three times a source's size
    has room for them; so a source is at most a few blocks off its target. Only a target smaller than
    a block is taken to the word. A source's records are dealt to shards by a seeded hash, and its
    quota is dealt to the shards by Sainte-Laguë again. In a shard the records follow each other in
    seeded order; a quota is taken as whole passes over the shard and then as blocks in seeded order,
    the last cut to what is left. So no record is taken more than three times its size.

    Returns ``id, size, source_size, target, taken, text_digest``: words of the text, of its
    source, the source's target, the words taken from this record, repeats counted, and the
    digest that tells records of one id apart. Equal input gives
    equal results. A missing or empty text has size 0 and nothing is taken from it; rows may
    repeat, ids may be NULL; further columns are ignored; an empty table gives no rows. The driver
    holds one row per source and per shard. Shards grow in number with the words, to
    :data:`MOST_SHARDS`, and beyond that in size.
    """
    spark = products.sparkSession
    sized = stored(
        products.select(
            F.col(id).alias("id"),
            F.col(source).alias("source"),
            text_key(F.col(text)).alias("_key"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).toPandas()
    per_source = per_source.sort_values("source", key=lambda s: s.map(lambda v: (v is None, v or "")), ignore_index=True)
    sizes = per_source["source_size"].to_numpy(np.int64)
    total = int(sizes.sum())
    block = max(1, min(total // blocks, BLOCK_WORDS) if blocks == BLOCKS else total // blocks)
    goal = targets(np.arange(len(sizes)) % 3 + 1.0, sizes, total)
    whole, quota = source_quotas(goal, sizes, total, block)
    shard_words = max(block * shard_blocks, total // MOST_SHARDS)
    per_source["number"] = np.arange(len(sizes))
    per_source["target"] = goal
    per_source["shards"] = np.maximum(1, -(-sizes // shard_words))
    listed = spark.createDataFrame(
        [(r.source, int(r.number), int(r.source_size), float(r.target), int(r.shards)) for r in per_source.itertuples()],
        "source string, number int, source_size long, target double, shards int",
    ).withColumnRenamed("source", "_source")
    dealt = sized.join(listed, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id",
        "_key",
        "size",
        "number",
        "source_size",
        "target",
        F.pmod(F.xxhash64(F.lit(seed), "id", "_key"), F.col("shards")).cast("int").alias("shard"),
        F.xxhash64("_key", F.lit(seed), "id").alias("_order"),
    )
    shard_sizes = dealt.groupBy("number", "shard").agg(F.sum("size").alias("shard_size")).toPandas().sort_values(["number", "shard"])
    plan = []
    for number, rows in shard_sizes.groupby("number"):
        size = rows["shard_size"].to_numpy(np.int64)
        most = MOST_EPOCHS * size // block
        got = sainte_lague(size, int(whole[number]), most) * block
        # what a whole block can't hold goes where room is left, largest shard first
        rest = int(quota[number] - got.sum())
        for i in np.argsort(-size, kind="stable"):
            step = int(np.clip(rest, -got[i], MOST_EPOCHS * size[i] - got[i]))
            got[i] += step
            rest -= step
        for shard, n, q in zip(rows["shard"], size, got):
            passes = int(q // n) if n else 0
            plan.append((int(number), int(shard), int(n), passes, int(q - passes * n)))
    quotas = spark.createDataFrame(plan, "number int, shard int, shard_size long, passes long, rest long")

    # which blocks of a shard are taken once more, and how far
    picked = quotas.where("rest > 0").select(
        "number", "shard", "shard_size", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size") - 1) / block))).alias("block")
    )
    length = F.least(F.lit(block).cast("long"), F.col("shard_size") - F.col("block") * block)
    seeded = Window.partitionBy("number", "shard").orderBy(F.xxhash64(F.lit(seed), "block", "shard", "number"), "block")
    before = F.coalesce(F.sum("length").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = (
        picked.withColumn("length", length)
        .withColumn("before", before)
        .where(F.col("before") < F.col("rest"))
        .select("number", "shard", "block", F.least("length", F.col("rest") - F.col("before")).alias("use"))
    )
    ordered = Window.partitionBy("number", "shard").orderBy("_order", "id", "_key")
    begin = F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rows that repeat id and text are told apart by their place in the order
    placed = stored(dealt.withColumn("begin", begin).withColumn("_row", F.row_number().over(ordered)), "placed")
    spans = placed.where("size > 0").select(
        "number",
        "shard",
        "_row",
        "begin",
        "size",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"),
    )
    start = F.greatest(F.col("begin"), F.col("block") * block)
    end = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("use"))
    extra = (
        spans.join(picked, ["number", "shard", "block"])
        .groupBy("number", "shard", "_row")
        .agg(F.sum(F.greatest(end - start, F.lit(0))).alias("extra"))
    )
    return (
        placed.join(extra, ["number", "shard", "_row"], "left")
        .join(quotas.select("number", "shard", "passes"), ["number", "shard"])
        .select(
            "id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("passes") + F.coalesce("extra", F.lit(0))).cast("long").alias("taken"),
            F.col("_key").alias("text_digest"),
        )
    )
