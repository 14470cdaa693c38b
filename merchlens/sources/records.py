"""Whole records of files that are read in splits, where only what came before tells where they end.

A CSV cell may hold line breaks, and an element of a JSON list any braces. Files are cut into
pieces at a character that ends every record but may also stand inside one: line feeds, closing
braces. What a piece does to the reader's state (inside quotes or not, depth of brackets) is known
for either state it may begin with, so pieces of a block, then blocks of a file, add up to the
state every block begins with. With that, each block is cut on its own, and only records that
reach over its ends are put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.session import cut_lineage

MANY_BLOCKS = 100_000  # up to so many blocks their states are broadcast (a few MB), beyond that joined
EFFECTS = ["open0", "open1", "deep0", "deep1"]
_EFFECT_DDL = "open0 boolean, open1 boolean, deep0 long, deep1 long"


def pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """``text, file, block, row``: what stands between the ``end`` characters, by file, split and order."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


# --- what a piece does --------------------------------------------------------------------


def opens_cell(line: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell.

    Doubled quotes mean nothing here. A quote opens a cell at its very beginning only; what follows
    the closing one up to the next comma belongs to the cell.
    """
    return F.regexp(F.regexp_replace(_single(line), r'(?<![^,])"[^"]*+"[^,]*+', ""), F.lit(r'(?<![^,])"'))


def _single(line: Column) -> Column:
    return F.replace(line, F.lit('""'), F.lit(""))


def csv_effects(lines: DataFrame) -> DataFrame:
    """Lines of CSV files with their effects: no depth, and quoted cells that go on in the next line."""
    behind = F.regexp_replace(_single(F.col("text")), r'^[^"]*+"[^,]*+', "")
    closes = F.contains(_single(F.col("text")), F.lit('"'))
    return lines.select(
        "*",
        opens_cell(F.col("text")).alias("open0"),
        (~closes | opens_cell(behind)).alias("open1"),
        F.lit(0).cast("long").alias("deep0"),
        F.lit(0).cast("long").alias("deep1"),
    )


def json_effects(parts: DataFrame) -> DataFrame:
    """Parts of JSON files up to a closing brace, which counts unless it stands in a string."""
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    behind = F.when(F.contains(plain, F.lit('"')), F.regexp_replace(plain, r'^[^"]*+"', ""))

    def effect(text: Column) -> tuple[Column, Column]:
        outside = F.regexp_replace(text, r'"[^"]*+"', "")
        opened = F.contains(outside, F.lit('"'))
        before = F.substring_index(outside, '"', 1)
        deeper = F.length(F.regexp_replace(before, r"[^\[{]++", "")) - F.length(F.regexp_replace(before, r"[^\]}]++", ""))
        return opened, (deeper - F.when(opened, 0).otherwise(1)).cast("long")

    open0, deep0 = effect(plain)
    open1, deep1 = effect(behind)
    return parts.select(
        "*", open0.alias("open0"), F.coalesce(open1, F.lit(True)).alias("open1"),
        deep0.alias("deep0"), F.coalesce(deep1, F.lit(0).cast("long")).alias("deep1"),
    )


# --- blocks ------------------------------------------------------------------------------


def _states(open0: np.ndarray, open1: np.ndarray, begin: bool) -> np.ndarray:
    """The state before each piece and after the last one, from the state at the beginning.

    A piece either sets the state, keeps it or turns it: what holds is the last one that set it,
    turned as often as pieces since then turn it.
    """
    n = len(open0)
    turns = np.concatenate([[0], np.cumsum(open0 & ~open1)])
    sets = np.where(open0 == open1, np.arange(1, n + 1), 0)
    last = np.concatenate([[0], np.maximum.accumulate(sets)]) if n else np.zeros(1, np.int64)
    value = np.concatenate([[begin], open0])[last]
    return value ^ ((turns - turns[last]) % 2 == 1)


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[str, int, dict[str, np.ndarray], bool]]:
    """Stretches of rows of one block, in order, each with whether the block ends there."""
    held = None
    for batch in batches:
        file, block = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        i = 0
        while i < len(file):
            j = i + 1
            while j < len(file) and block[j] == block[i] and file[j] == file[i]:
                j += 1
            part = {c: batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in columns}
            if held is not None:
                yield *held, held[:2] != (file[i], block[i])
            held, i = (file[i], block[i], part), j
    if held is not None:
        yield *held, True


def _block_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: what all of its pieces do, for either state the block may begin with."""
    state, deep, first = [False, True], [0, 0], None
    for file, block, part, ends in _blocks(batches, [*EFFECTS, "begins"]):
        first = part["begins"][0] if first is None else first
        for s in (0, 1):
            inside = _states(part["open0"], part["open1"], state[s])
            deep[s] += int(np.where(inside[:-1], part["deep1"], part["deep0"]).sum())
            state[s] = bool(inside[-1])
        if ends:
            values = [file, block, *state, *deep, first]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["file", "block", *EFFECTS, "begins"])
            state, deep, first = [False, True], [0, 0], None


def block_states(effects: DataFrame) -> DataFrame:
    """``file, block, inside, depth, begins``: the state each block begins with, and the first block's first piece."""
    begins = F.when(F.col("block") == 0, F.col("text")).alias("begins")
    blocks = cut_lineage(effects.select("file", "block", *EFFECTS, begins).mapInArrow(_block_effects, f"file string, block long, {_EFFECT_DDL}, begins string"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = blocks.withColumn("turns", F.sum((F.col("open0") & ~F.col("open1")).cast("int")).over(upto))
    known = F.when(F.col("open0") == F.col("open1"), F.struct("open0", "turns"))
    last = F.last(known, ignorenulls=True).over(before)
    turns = F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    odd = (turns - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    placed = turned.withColumn("inside", F.coalesce(last["open0"], F.lit(False)) != odd)
    deep = F.when(F.col("inside"), F.col("deep1")).otherwise(F.col("deep0"))
    return placed.withColumn("depth", F.coalesce(F.sum(deep).over(before), F.lit(0))).select("file", "block", "inside", "depth", "begins")


def _cut(end: str, depth: int):
    """Records of blocks whose state is known, and parts of records that reach over a block's ends."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, open_parts, number = None, [], 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "block", "row", "part", "record"])

        for file, block, part, ends in _blocks(batches, [*EFFECTS, "text", "inside", "depth"]):
            if state is None:
                state, level = bool(part["inside"][0]), int(part["depth"][0])
                # at the outset of a file nothing is open; elsewhere a block may begin in a record
                begun, open_parts, number = block > 0 and (state or level != depth), [], 0
            inside = _states(part["open0"], part["open1"], state)
            levels = level + np.cumsum(np.where(inside[:-1], part["deep1"], part["deep0"]))
            done, at = ~inside[1:] & (levels == depth), 0
            for i in np.flatnonzero(done):
                text = end.join([*open_parts, *part["text"][at : i + 1]])
                out.append((file, block, number, "head" if begun else "whole", text))
                open_parts, begun, at, number = [], False, i + 1, number + 1
            open_parts += part["text"][at:].tolist()
            state, level = bool(inside[-1]), int(levels[-1])
            if ends:
                if open_parts:
                    out.append((file, block, number, "middle" if begun else "tail", end.join(open_parts)))
                state = None
            if len(out) > 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return cut


def whole_records(effects: DataFrame, states: DataFrame, end: str, depth: int = 0) -> DataFrame:
    """``file, block, row, record``: pieces put together, a record ending outside quotes at ``depth``.

    A record counts to the block it begins in. Pieces are never shuffled unless there are more than
    :data:`MANY_BLOCKS` blocks; only records that reach over a block's end are.
    """
    facts = cut_lineage(states.select("file", "block", "inside", "depth"))
    if facts.count() <= MANY_BLOCKS:
        placed = effects.join(F.broadcast(facts), ["file", "block"])
    else:
        placed = effects.join(facts, ["file", "block"]).sortWithinPartitions("file", "block", "row")
    cut = placed.mapInArrow(_cut(end, depth), "file string, block long, row long, part string, record string")
    cut = cut_lineage(cut)
    order = Window.partitionBy("file").orderBy("block", "row")
    parts = cut.where("part <> 'whole'").withColumn("chain", F.sum((F.col("part") == "tail").cast("int")).over(order))
    first = F.min(F.struct("block", "row")).alias("at")
    held = F.sort_array(F.collect_list(F.struct("block", "row", "record")))["record"]
    joined = parts.groupBy("file", "chain").agg(first, F.array_join(held, end).alias("record"))
    return cut.where("part = 'whole'").select("file", "block", "row", "record").unionByName(
        joined.select("file", "at.block", "at.row", "record")
    )
