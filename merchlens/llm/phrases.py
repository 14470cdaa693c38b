"""Collocations of product descriptions, counted in a weighted graph of overlapping word runs."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.llm.common import free_shuffles, in_batches, in_pieces, joined_bytes, mix, prefix_hash, release, span_hash, stored, word_bounds

SLOT_BITS = 23  # a count filter has 2^23 slots, or 1 MB, at least
MOST_BITS = 27  # and 16 MB at most, counted in 128 MB of a worker
CROWD = 8  # words of the input for each slot of the filters for pairs and triples, up to that size
SECTION = 1 << 19  # slots in one packed row
ADDED = 256  # tasks whose counts of a section are added up at a time
FILTERED = 3  # runs of 1, 2 and 3 words have a filter each; further ones would leave few runs less
HELD_RUNS = 1 << 20  # distinct runs that a task holds before it passes them on
TASK_WORDS = 1 << 26  # words that a counting task takes, or more where every core has two tasks
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True


class Words:
    """The words of some texts, and which of them stand in a piece together."""

    def __init__(self, texts: list[str | None], languages: list[str | None]) -> None:
        raw, begins = joined_bytes(texts)  # the line end between two texts ends a piece
        data = _LOWER[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, np.uint8)
        start, end = word_bounds(data, _OUTSIDE)
        self.names, of_text = np.unique(np.array(["und" if x is None else x for x in languages], object), return_inverse=True)
        self.language = of_text[np.searchsorted(begins, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
        self.data, self.start, self.end = data, start, end
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)
        follows = np.zeros(len(start), bool)  # whether the next word stands in the same piece
        if len(start):
            follows[:-1] = breaks[start[1:]] == breaks[end[:-1] - 1]
        self.follows = follows
        hashes = span_hash(prefix_hash(data), start, end)
        salt = np.array([int.from_bytes(x.encode("utf-8")[:7].ljust(7, b"\0"), "big") + len(x) for x in self.names], np.uint64)
        self.hashes = mix(hashes + mix(salt)[self.language]) if len(start) else hashes

    def spelled(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and each word's number among them."""
        offsets = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        packed = self.data[~_OUTSIDE[self.data]]
        words = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(offsets), pa.py_buffer(packed)).dictionary_encode()
        return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def slots(self, width: int, slot_bits: int = SLOT_BITS) -> np.ndarray:
        """Count slots of the runs of ``width`` words, by their first words."""
        size = max(0, len(self.hashes) - width + 1)
        h = self.hashes[:size]
        for j in range(1, width):
            h = mix(h * np.uint64(3) + self.hashes[j : j + size])
        return (h >> np.uint64(64 - slot_bits)).astype(np.int32)

    def runs(self, width: int, filters: list[Frequent]) -> Iterator[np.ndarray]:
        """For 1, 2 .. ``width`` words, where runs of them start that lie in one piece and may be frequent.

        A run may be if both its parts one word shorter may and, for as many widths as there are
        ``filters``, its own slot counts enough.
        """
        alive = np.ones(len(self.start), bool)
        for w in range(1, width + 1):
            if w > 1:
                both = alive[:-1] & alive[1:]
                alive = np.append(both & self.follows[:-1] if w == 2 else both, False) if len(alive) else alive
            if w <= len(filters):
                at = np.flatnonzero(alive[: max(0, len(alive) - w + 1)])
                alive = np.zeros(len(alive), bool)
                alive[at] = filters[w - 1].has(self.slots(w, filters[w - 1].slot_bits)[at])
            yield alive


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in in_pieces(batches):
        texts, languages = batch.column("text").to_pylist(), batch.column("language").to_pylist()
        for a, b in in_batches(texts):
            yield Words(texts[a:b], languages[a:b])


class Frequent:
    """A bitmap of the slots that count enough occurrences; what hashes elsewhere occurs less often."""

    def __init__(self, sections: list[tuple[int, bytes]], slot_bits: int = SLOT_BITS) -> None:
        self.slot_bits = slot_bits
        self.bits = np.zeros((1 << slot_bits) // 8, np.uint8)
        for number, held in sections:
            self.bits[number * (SECTION // 8) : (number + 1) * (SECTION // 8)] = np.frombuffer(held, np.uint8)

    def has(self, slots: np.ndarray) -> np.ndarray:
        return (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


SLOT_SCHEMA = pa.schema([("task", pa.int64()), ("section", pa.int32()), ("data", pa.binary()), ("language", pa.string()), ("n", pa.int64())])


def _kind(min_count: int) -> np.dtype:
    """The smallest type for counts up to ``min_count``, as more need not be told apart."""
    return np.min_scalar_type(min_count)


def _slot_bits(words: int) -> int:
    """Slots grow with the input: in a filter of one size ever more rare runs would share a slot that counts enough."""
    return min(MOST_BITS, max(SLOT_BITS, (words // CROWD).bit_length()))


def _for_cores(texts: DataFrame, words: int) -> DataFrame:
    """Gives each task more texts, as each counts on its own: a frequent run makes a row in every one of them.

    A task for each small piece of the input would make tasks times frequent runs, which both grow with the input.
    """
    return texts.coalesce(max(2 * texts.sparkSession.sparkContext.defaultParallelism, words // TASK_WORDS))


def _count_slots(filters, min_count: int, slot_bits: int = SLOT_BITS):
    """Each task's own counts by slot, packed by section, and with single words the languages' totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        width = len(known) + 1
        counts, totals = np.zeros(1 << slot_bits, _kind(min_count)), Counter()
        for words in _chunks(batches):
            *_, alive = words.runs(width, known)
            slots, n = np.unique(words.slots(width, slot_bits)[alive[: max(0, len(alive) - width + 1)]], return_counts=True)
            counts[slots] = np.minimum(counts[slots] + n, min_count)
            if width == 1:
                totals.update(dict(zip(words.names, np.bincount(words.language, minlength=len(words.names)).tolist())))
        task = TaskContext.get().partitionId()
        held = [i for i in range(len(counts) // SECTION) if counts[i * SECTION : (i + 1) * SECTION].any()]
        rows = [(task, i, zlib.compress(counts[i * SECTION : (i + 1) * SECTION].tobytes(), 1), None, None) for i in held]
        rows += [(task, None, None, language, n) for language, n in totals.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SLOT_SCHEMA.types)], schema=SLOT_SCHEMA)

    return count


def _added(min_count: int, last: bool):
    """The sum of some tasks' counts of one section, packed like these, or as bits of those that are enough."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(d), _kind(min_count)).astype(np.uint32) for d in rows["data"])
        if last:
            packed = np.packbits(total >= min_count, bitorder="little").tobytes()
        else:
            packed = zlib.compress(np.minimum(total, min_count).astype(_kind(min_count)).tobytes(), 1)
        return pd.DataFrame({"task": [key[0]], "section": [key[1]], "data": [packed]})

    return add


def _frequent(slots: DataFrame, min_count: int, slot_bits: int = SLOT_BITS) -> Frequent:
    """Adds up the tasks' counts, so many of a section at a time, and keeps which slots have enough."""
    part = F.floor(F.col("task") / ADDED).alias("task")
    slots = slots.where("section IS NOT NULL").select("task", "section", "data")
    tasks = (slots.agg(F.max("task")).head()[0] or 0) + 1
    while tasks:
        last = tasks <= ADDED
        slots = slots.groupBy(part, "section").applyInPandas(_added(min_count, last), "task long, section int, data binary")
        tasks = 0 if last else -(-tasks // ADDED)
    return Frequent([(r["section"], bytes(r["data"])) for r in slots.collect()], slot_bits)


def _count_runs(filters, most: int):
    """Runs of up to ``most`` words from each frequent word on, as far as its piece and frequent runs go."""
    schema = pa.schema([("language", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = [f.value for f in filters], []
        for words in _chunks(batches):
            held.append(_runs_of(words, known, most, schema))
            if sum(t.num_rows for t in held) > HELD_RUNS:
                held = [_summed(held)]
                if held[0].num_rows > HELD_RUNS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    return count


def _summed(tables: list[pa.Table]) -> pa.Table:
    keys = ["language", "words", "phrase"]
    summed = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")])
    return summed.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()


def _runs_of(words: Words, known: list[Frequent], most: int, schema: pa.Schema) -> pa.Table:
    if not len(words.start):
        return schema.empty_table()
    spelling, number = words.spelled()
    last, cells = len(number) - 1, {}
    for k, alive in enumerate(words.runs(most, known)):
        if not k:
            starts = np.flatnonzero(alive)
            cells = {"l": words.language[starts], "w0": number[starts]}
        else:
            cells[f"w{k}"] = np.where(alive[starts], number[np.minimum(starts + k, last)], -1)
    runs = pa.table(cells).group_by(list(cells)).aggregate([([], "count_all")])
    columns = [runs.column(f"w{k}").combine_chunks() for k in range(most)]
    spelled = [spelling.take(pc.if_else(pc.less(c, 0), None, c)) for c in columns]
    phrase = pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string()), null_handling="skip")
    long = sum(pc.greater_equal(c, 0).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in columns)
    names = pa.array(words.names, pa.string()).take(runs.column("l").combine_chunks())
    arrays = [names, pa.array(long, pa.int32()), phrase.cast(pa.string()), runs.column("count_all").combine_chunks()]
    return pa.Table.from_arrays(arrays, schema=schema)


# --- the graph ---------------------------------------------------------------------------


def first_words(phrase, k: int):
    return F.substring_index(phrase, " ", k)


def last_words(phrase, k: int):
    return F.substring_index(phrase, " ", -k)


def compact_paths(edges: DataFrame, most: int) -> DataFrame:
    """Joins edges (language, phrase, n) of ``most`` words where the node between them has no other.

    A node is the ``most - 1`` words that two edges share; ``enters`` and ``leaves`` say how often an
    edge's first and last node occur. Where both edges weigh as much as the node between them, no other
    edge, start or end of a piece touches it: such edges make one path, found by doubling, in which
    each edge knows the edge 2^i steps ahead, until none does. Returns ``language, phrase, n, n_edges``; edges on a ring stay single.
    """
    inner = most - 1
    ahead = edges.select("language", "phrase", "n", last_words("phrase", inner).alias("node"), "leaves").where("n = leaves")
    behind = edges.select(
        "language", F.col("phrase").alias("next"), first_words("phrase", inner).alias("node"), F.col("n").alias("next_n"), "enters"
    ).where("next_n = enters")
    same = ahead.join(behind, ["language", "node"]).where("n = next_n")
    steps = stored(same.select("language", "phrase", "next"), "steps")
    follows = steps.select("language", F.col("next").alias("phrase"), F.lit(True).alias("entered"))
    heads = edges.join(follows, ["language", "phrase"], "left")
    # place: how many edges are ahead of it up to the path's end; jump: the edge 2^i ahead, or the path's last
    places = stored(
        heads.join(steps, ["language", "phrase"], "left").select(
            "language", "phrase", "n", F.col("entered").isNotNull().alias("entered"), F.col("next").alias("jump"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("far"),
            F.coalesce("next", "phrase").alias("last"),
        ),
        "places",
    )
    longest = places.where("jump IS NOT NULL").count()
    span = 1
    while span <= longest and places.where("jump IS NOT NULL").head(1):
        there = places.select("language", F.col("phrase").alias("jump"), F.col("jump").alias("_jump"), F.col("far").alias("_far"), F.col("last").alias("_last"))
        places = stored(
            places.join(there, ["language", "jump"], "left").select(
                "language", "phrase", "n", "entered", F.col("_jump").alias("jump"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("_last", "last").alias("last")
            ),
            "places",
        )
        span *= 2
    on_ring = F.col("jump").isNotNull()
    lines = places.where(~on_ring).groupBy("language", "last").agg(F.max("n").alias("n"), F.count("*").alias("n_edges"), F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("at"), "phrase"))).alias("run"))
    text = F.concat_ws(" ", F.col("run")[0]["phrase"], F.transform(F.slice("run", 2, F.greatest(F.size("run") - 1, F.lit(0))), lambda r: last_words(r["phrase"], 1)))
    # concat_ws leaves out an empty list
    paths = lines.select("language", text.alias("phrase"), "n", "n_edges")
    return paths.unionByName(places.where(on_ring).select("language", "phrase", "n", F.lit(1).cast("long").alias("n_edges")))


def _runs_within(paths: DataFrame, length: int) -> DataFrame:
    """Every run of ``length`` words on a path, with the path's weight."""
    words = F.split("phrase", " ")
    held = paths.select("language", "n", words.alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - (length - 1))
    return held.select("language", "n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))).alias("phrase"))


def phrase_counts(products: DataFrame, language: str, text: str, min_count: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of all phrases of up to ``most`` words that occur ``min_count`` times, words by language, paths."""
    spark = products.sparkSession
    texts = products.select(F.col(language).alias("language"), F.col(text).alias("text"))
    filters, totals, slot_bits = [], None, SLOT_BITS
    for _ in range(min(FILTERED, most)):
        counted = stored(texts.mapInArrow(_count_slots(filters, min_count, slot_bits), "task long, section int, data binary, language string, n long"), "slots")
        filters = [*filters, spark.sparkContext.broadcast(_frequent(counted, min_count, slot_bits))]
        if totals is None:
            totals = stored(counted.where("section IS NULL").groupBy("language").agg(F.sum("n").alias("n_words")), "totals")
            n_words = totals.agg(F.sum("n_words")).head()[0] or 0
            slot_bits, texts = _slot_bits(n_words), _for_cores(texts, n_words)
        release(counted)
        free_shuffles(spark)
    runs = texts.mapInArrow(_count_runs(filters, most), "language string, words int, phrase string, n long")
    graph = stored(runs.groupBy("language", "words", "phrase").agg(F.sum("n").alias("n")), "graph")
    free_shuffles(spark)
    # Runs of all words are edges. Shorter ones end with their piece and correct the counts of what they begin with.
    inner = most - 1
    edges = graph.where(F.col("words") == most).select("language", "phrase", "n")
    levels = [stored(_flow(edges, graph, inner), "flow")]
    heavy = edges.where(F.col("n") >= min_count)
    nodes = levels[0].where(F.col("n") >= min_count).select("language", F.col("phrase").alias("node"), F.col("n").alias("through"))
    around = (
        heavy.withColumn("node", first_words("phrase", inner))
        .join(nodes.withColumnRenamed("through", "enters"), ["language", "node"])
        .withColumn("node", last_words("phrase", inner))
        .join(nodes.withColumnRenamed("through", "leaves"), ["language", "node"])
        .select("language", "phrase", "n", "enters", "leaves")
    )
    paths = stored(compact_paths(stored(around, "heavy"), most), "paths")
    for k in range(inner - 1, 0, -1):
        levels.append(stored(_flow(levels[-1], graph, k), "flow"))
    frequent = [level.where(F.col("n") >= min_count).withColumn("words", F.lit(inner - i)) for i, level in enumerate(levels)]
    frequent.append(heavy.withColumn("words", F.lit(most)))
    return reduce(DataFrame.unionByName, frequent), totals, paths


def _flow(longer: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Counts of runs of ``k`` words: the flow out of each into longer runs, and pieces that end after it."""
    leaving = longer.select("language", first_words("phrase", k).alias("phrase"), "n")
    ending = graph.where(F.col("words") == k).select("language", "phrase", "n")
    return leaving.unionByName(ending).groupBy("language", "phrase").agg(F.sum("n").alias("n"))


def mine_phrases(
    products: DataFrame, language: str = "language", text: str = "description", min_count: int = 100, max_words: int = 5, top: int = 2000
) -> DataFrame:
    """The strongest collocations of the descriptions in each language.

    Descriptions, A-Z lower-cased, are cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
    into words at blanks and tabs. A phrase of 2 to ``max_words`` words that occurs ``n_phrase`` >=
    ``min_count`` times is a candidate. Cut after its first words into parts that occur ``n_left``
    and ``n_right`` times it scores floor(1000 * n_phrase * n_words / (n_left * n_right)), where
    ``n_words`` are all words of the language; the cut of the lowest score counts, the earliest of
    those. A candidate inside a longer one that occurs as often is dropped.

    Counting: small count filters, those for pairs and triples the larger the more words there are,
    first tell words, pairs and triples that are rarer than ``min_count``, which no candidate holds;
    runs end there as they do with a piece. Few tasks count, two a core or one for 2^26 words, so that
    a run's counts are added up over many texts before they are passed on. Runs of
    ``max_words`` words are the edges of a graph whose nodes are one word shorter. What is
    shorter is counted by the flow out of it and by pieces that end with it. Edges that nothing
    joins or leaves between are compacted to paths, which tell what lies inside longer phrases.

    Returns ``language, rank, phrase, n_phrase, n_left, n_right, n_words, score``: each language's
    first ``top`` by score, count (both falling) and phrase, from rank 1. NULLs: a missing language
    is ``und``, a missing description has no words. Rows may repeat and count each time; texts of
    any length are counted whole; other columns are ignored whatever their names; an empty table
    gives no rows.
    """
    counts, totals, paths = phrase_counts(products, language, text, min_count, max_words)
    counts = stored(counts, "counts")
    candidates = counts.where("words > 1")
    parts = counts.where(F.col("words") < max_words)
    within = [_runs_within(paths, k) for k in range(2, max_words)]
    within += [_runs_within(candidates.where(F.col("words") == k), j) for k in range(3, max_words) for j in range(2, k)]
    covered = reduce(DataFrame.unionByName, within).groupBy("language", "phrase").agg(F.max("n").alias("longer")) if within else None
    if covered is not None:
        candidates = candidates.join(covered, ["language", "phrase"], "left").where("longer IS NULL OR longer < n").drop("longer")
    cuts = candidates.select("language", "phrase", "words", "n", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    left = parts.select("language", F.col("phrase").alias("left"), F.col("n").alias("n_left"))
    right = parts.select("language", F.col("phrase").alias("right"), F.col("n").alias("n_right"))
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    scored = cuts.join(left, ["language", "left"]).join(right, ["language", "right"]).join(totals, "language")
    scored = scored.withColumn("above", F.lit(1000).cast("decimal(38,0)") * wide("n") * wide("n_words")).withColumn("below", wide("n_left") * wide("n_right"))
    lowest = scored.groupBy("language", "phrase").agg(
        F.min(F.struct(F.expr("above div below").alias("score"), "k", "n_left", "n_right", "n_words", F.col("n").alias("n_phrase"))).alias("cut")
    )
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("n_phrase"), "phrase")
    ranked = lowest.select("language", "phrase", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("language", F.col("rank").cast("long").alias("rank"), "phrase", "n_phrase", "n_left", "n_right", "n_words", "score")
