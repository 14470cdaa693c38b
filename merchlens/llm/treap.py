"""Ranked search over product descriptions in K2-treaps: term-document grids with impact maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from merchlens.llm.common import in_pieces, joined_bytes, low, small_batches, stored, word_bounds

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_ROWS = 4096  # documents in one grid at most
SHARD_BYTES = 8 << 20  # and of text; a longer description has a grid of its own
BLOCK = 256  # questions that go through the grids together
SPLITS, WAVES = 4, 8  # input partitions that a task makes grids of, if there are as many tasks for each core
COPIES = 32  # of each block of questions, so that no task of a join gets all grids
STEP = 16  # inner maxima are kept in whole steps, rounded up
FIRST, THEN = 16, 256  # cells opened at a time, before and after k documents are known

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def term_list(text: Column) -> Column:
    """A text's terms in order: runs of digits, letters A-Z (lower-cased) and characters beyond ASCII."""
    return F.regexp_extract_all(low(text), F.lit(TERM), 0)


# --- one grid ----------------------------------------------------------------------------


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers moved to the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def compress_grid(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """The K2-treap of a sparse grid: depth, child masks by level from the top, inner maxima, cell values.

    A mask tells which quarters of a square hold anything; a square's maximum bounds its cells'.
    """
    depth = max(_bits(int(row.max()) + 1), _bits(int(col.max()) + 1))
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code, kind="stable")
    code, cells = code[order], value[order]
    masks, tops, high = [], [], (cells + (STEP - 1)) // STEP
    for _ in range(depth):
        parent = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first))
        high = np.maximum.reduceat(high, first)
        tops.append(high.astype(np.uint16))
        code = parent[first]
    return depth, np.concatenate(masks[::-1]).tobytes(), np.concatenate(tops[::-1]).tobytes(), cells.astype(np.uint32).tobytes()


class Grid:
    """A K2-treap opened for search. Squares are numbered by level from 1; 0 stands for none."""

    def __init__(self, depth: int, masks: bytes, tops: bytes, cells: bytes) -> None:
        self.depth = depth
        inner = np.frombuffer(masks, np.uint8)
        held = _ONES[inner]
        leaves = np.frombuffer(cells, np.uint32)
        self.mask = np.zeros(1 + len(inner) + len(leaves), np.uint8)
        self.mask[1 : len(inner) + 1] = inner
        # the squares of a level follow one another, so children are counted from the root on
        self.child = np.zeros(len(inner) + 1, np.int64)
        self.child[1:] = 2 + np.cumsum(held) - held
        self.value = np.zeros(len(self.mask), np.int64)
        self.value[1 : len(inner) + 1] = np.frombuffer(tops, np.uint16)
        self.value[1 : len(inner) + 1] *= STEP
        self.value[len(inner) + 1 :] = leaves

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` columns of the highest weighted sums over ``rows``, at least ``floor`` and above 0.

        All rows descend together: a state is a range of columns with the square that each row has
        there, and its bound the weighted sum of their maxima. The states of the highest bounds are
        opened first (earlier columns first among equals) until no bound reaches the ``k``-th sum.
        """
        nodes = np.ones((1, len(rows)), np.int64)
        level, begin = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int((weights * self.value[1]).sum())])
        columns, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(1, floor)
        while len(bound):
            many = THEN if len(sums) >= k else FIRST
            if len(bound) > many:
                order = np.lexsort((begin, -bound))
                now, later = order[:many], order[many:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            at, depth, start = nodes[now], level[now], begin[now]
            shift = self.depth - 1 - depth
            half = ((rows[None, :] >> shift[:, None]) & 1) << 1
            mask, child = self.mask[at].astype(np.int64), self.child[at]
            opened = []
            for side in (0, 1):
                quarter = half | side
                down = np.where((mask >> quarter) & 1, child + _ONES[mask & ((1 << quarter) - 1)], 0)
                opened.append((down, depth + 1, start + (side << shift), (weights * self.value[down]).sum(axis=1)))
            down, depth, start, high = (np.concatenate(x) for x in zip(*opened))
            leaf = depth == self.depth
            columns, sums = np.concatenate([columns, start[leaf & (high >= floor)]]), np.concatenate([sums, high[leaf & (high >= floor)]])
            if len(sums) > k:
                first = np.lexsort((columns, -sums))[:k]
                columns, sums = columns[first], sums[first]
            if len(sums) == k:
                floor = max(floor, int(sums.min()))
            keep = ~leaf & (high >= floor)
            rest = later[bound[later] >= floor]
            nodes = np.concatenate([nodes[rest], down[keep]])
            level, begin = np.concatenate([level[rest], depth[keep]]), np.concatenate([begin[rest], start[keep]])
            bound = np.concatenate([bound[rest], high[keep]])
        order = np.lexsort((columns, -sums))
        return columns[order], sums[order]


# --- the index ---------------------------------------------------------------------------


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, starts and ends of their terms, and each term's text."""
    raw, begins = joined_bytes(texts)
    data = _LOWER[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, np.uint8)
    start, end = word_bounds(data, _OUTSIDE)
    return data, start, end, np.searchsorted(begins, start, side="right") - 1


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches):
        _, start, _, owner = _terms(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(owner))], pa.int64()), pa.array([len(start)], pa.int64())], ["n_texts", "n_terms"])


def _grid_row(number: int, ids: pa.Array, texts: list[str | None], n_texts: int, n_terms: int) -> list[pa.Array]:
    """One row of the index: the grid of some texts, ordered by id, with its terms in order of rarity."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
    data, start, end, owner = _terms([texts[i] for i in order])
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[~_OUTSIDE[data]])).dictionary_encode()
    del data, start, end, offsets  # each as large as the texts
    term, spelling = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    held = np.bincount(owner, minlength=len(texts))
    term *= len(texts)
    term += owner
    del found, owner
    pair, tf = np.unique(term, return_counts=True)
    row, col = np.divmod(pair, len(texts))
    del term, pair
    m = 75 + 25 * held * n_texts // max(1, n_terms)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[col])
    df = np.bincount(row, minlength=len(spelling))
    common = np.argsort(-df, kind="stable")  # common terms next to each other fill their squares
    place = np.empty(len(common), np.int64)
    place[common] = np.arange(len(common))
    depth, masks, tops, cells = compress_grid(place[row], col, impact) if len(row) else (0, b"", b"", b"")
    kept = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids.take(pa.array(order)))
    words = pa.ListArray.from_arrays(pa.array([0, len(spelling)], pa.int32()), spelling.take(pa.array(common)).cast(pa.string()))
    dfs = pa.ListArray.from_arrays(pa.array([0, len(spelling)], pa.int32()), pa.array(df[common], pa.int32()))
    binary = [pa.array([x], pa.binary()) for x in (masks, tops, cells)]
    return [pa.array([number], pa.int64()), kept, words, dfs, pa.array([depth], pa.int32()), *binary]


def index_products(products: DataFrame, index: str, id: str = "id", text: str = "description") -> None:
    """Writes the search index of all descriptions to the folder ``index``.

    Each row is the grid of up to 4096 descriptions of a few input partitions, about 8 MB of text:
    its terms are rows, its documents columns in order of their ids, and a cell holds the impact
    of a term in a document. Nothing is shuffled. The counts over all descriptions that impacts
    need are stored with it.
    """
    spark = products.sparkSession
    kind, id_type = products.schema[id].dataType.simpleString(), to_arrow_type(products.schema[id].dataType)
    rows = products.select(F.col(id).alias("id"), F.col(text).alias("text"))
    whole = rows.select("text").mapInArrow(_count_terms, "n_texts long, n_terms long").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_terms").alias("n_terms"))
    with small_batches(spark):
        whole.write.mode("overwrite").parquet(f"{index}/totals")
    n_texts, n_terms = (x or 0 for x in spark.read.parquet(f"{index}/totals").head())
    names = ["grid", "ids", "terms", "df", "depth", "masks", "tops", "cells"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_grid_row(number, pa.array(ids, id_type), texts, n_texts, n_terms), names)

        for batch in in_pieces(batches):
            for one, content in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                length = len((content or "").encode("utf-8"))
                if texts and (size + length > SHARD_BYTES or len(texts) == SHARD_ROWS):
                    yield full()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(one)
                texts.append(content)
                size += length
        if texts:
            yield full()

    schema = f"grid long, ids array<{kind}>, terms array<string>, df array<int>, depth int, masks binary, tops binary, cells binary"
    # fewer files than partitions, so that fewer grids stay small, but tasks enough for all cores
    dealt = rows.coalesce(max(WAVES * spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // SPLITS)))
    with small_batches(spark):  # and readers take the grids of a file one by one
        dealt.mapInArrow(build, schema).write.mode("overwrite").option("parquet.block.row.count.limit", 1).parquet(f"{index}/grids")


# --- search ------------------------------------------------------------------------------


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches):
        for i in range(batch.num_rows):
            terms, df, asked = batch.column("terms")[i].values, batch.column("df")[i].values, batch.column("asked")[i].values
            at = pc.index_in(asked, value_set=terms)
            known = pc.is_valid(at)
            block = pa.array([batch.column("block")[i].as_py()] * pc.sum(known).as_py() if len(at) else [], pa.int32())
            if len(block):
                yield pa.RecordBatch.from_arrays([block, asked.filter(known), df.take(at.filter(known)).cast(pa.int64())], ["block", "term", "df"])


def _search_grid(best: dict[int, tuple[np.ndarray, list]], row: dict[str, pa.Scalar], k: int) -> None:
    """Takes the best of one grid into those of each question so far; nothing else of the grid stays."""
    grid = Grid(row["depth"].as_py(), *(row[c].as_buffer() for c in ("masks", "tops", "cells")))
    terms, ids, questions = row["terms"].values, row["ids"].values, row["questions"].values
    words, weights = questions.field("words"), questions.field("weights")
    at = pc.index_in(words.values, value_set=terms)  # one look-up for all questions
    places, factors = at.fill_null(-1).to_numpy(zero_copy_only=False), weights.values.to_numpy(zero_copy_only=False)
    ends = words.offsets.to_numpy()
    for j, item in enumerate(questions.field("item").to_pylist()):
        rows, factor = places[ends[j] : ends[j + 1]].astype(np.int64), factors[ends[j] : ends[j + 1]]
        rows, factor = rows[rows >= 0], factor[rows >= 0]
        if not len(rows):
            continue
        sums, held = best.get(item, (np.zeros(0, np.int64), []))
        columns, scores = grid.best(rows, factor, k, int(sums.min()) if len(sums) >= k else 0)
        if len(columns):
            best[item] = _merge(sums, held, scores, ids.take(pa.array(columns)).to_pylist(), k)


def _search(k: int, kind: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best of each question in the grids before, whose k-th bounds the search in the next
        best: dict[int, tuple[np.ndarray, list]] = {}
        for batch in in_pieces(batches):
            for i in range(batch.num_rows):
                if batch.column("depth")[i].as_py():
                    _search_grid(best, {c: batch.column(c)[i] for c in batch.schema.names}, k)
            batch = None  # not held while the next one is read
        for item, (sums, held) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(held), pa.int64()), pa.array(held, kind), pa.array(sums, pa.int64())], ["item", "id", "score"])

    return search


def _merge(sums: np.ndarray, held: list, more: np.ndarray, ids: list, k: int) -> tuple[np.ndarray, list]:
    rows = sorted([*zip(sums.tolist(), held), *zip(more.tolist(), ids)], key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:k]
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


def search_products(spark: SparkSession, index: str, questions: DataFrame, k: int = 20, id: str = "id", text: str = "description") -> DataFrame:
    """The ``k`` indexed descriptions that fit each question best.

    Questions are product records as well, or any texts with an id. A term weighs
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))), where df of the N descriptions with terms hold it.
    A description of n terms, of L in all, has m = 75 + (25 * n * N) div L, and scores the sum over the
    question's terms, repeats included, of weight * ((1000000000 * tf) div (1000 * tf + 12 * m)).

    Each grid is searched best-first for a block of questions, and a task keeps the best of all
    its grids, so that what is shuffled are ``k`` rows a question and task. Every description
    that could be among the best is scored exactly.

    Returns ``question_id, rank, id, score``: ranks from 1, the highest score first, then the smallest
    id (NULL last); descriptions of score 0 are left out. NULLs: a missing text has no terms and
    neither finds nor is found; a NULL id is an id like any other. Repeated questions are
    answered each, repeated descriptions rank each. Ids are numbers or text, other columns are
    ignored whatever their names; without questions or descriptions there are no rows.
    """
    n_texts = spark.read.parquet(f"{index}/totals").head()[0] or 0
    grids = spark.read.parquet(f"{index}/grids")
    items = stored(questions.select(F.col(id).alias("question_id"), term_list(F.col(text)).alias("terms"), F.monotonically_increasing_id().alias("item")), "questions")
    n_blocks = max(1, -(-items.count() // BLOCK))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")
    asked = items.select("item", block.alias("block"), F.explode("terms").alias("term")).groupBy("block", "item", "term").agg(F.count("*").alias("times"))
    asked = stored(asked, "asked")

    def through(columns: list[str], packed: DataFrame) -> DataFrame:
        """Each grid with each block of questions; the joined keys spread the grids over many tasks."""
        dealt = grids.select(*columns, F.pmod("grid", F.lit(COPIES)).cast("int").alias("copy"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        copies = packed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        return dealt.join(copies, ["block", "copy"]).drop("copy")

    wanted = asked.groupBy("block").agg(F.collect_set("term").alias("asked"))
    local = through(["grid", "terms", "df"], wanted).select("block", "terms", "df", "asked").mapInArrow(_look_up, "block int, term string, df long")
    df = local.groupBy("block", "term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_texts + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = asked.join(df, ["block", "term"]).select("block", "item", "term", (weight * F.col("times")).cast("long").alias("weight")).where("weight > 0")
    by_item = weighed.groupBy("block", "item").agg(F.collect_list("term").alias("words"), F.collect_list("weight").alias("weights"))
    with small_batches(spark):
        packed = stored(by_item.groupBy("block").agg(F.collect_list(F.struct("item", "words", "weights")).alias("questions")), "blocks")
    id_type = grids.schema["ids"].dataType.elementType.simpleString()
    joined = through(["grid", "ids", "terms", "depth", "masks", "tops", "cells"], packed).drop("grid", "block")
    found = joined.mapInArrow(_search(k, _arrow_type(grids)), f"item long, id {id_type}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").isNull(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    with small_batches(spark):
        return stored(ranked.join(items.select("item", "question_id"), "item").select("question_id", "rank", "id", "score"), "found")


def _arrow_type(grids: DataFrame) -> pa.DataType:
    return to_arrow_type(grids.schema["ids"].dataType.elementType)
