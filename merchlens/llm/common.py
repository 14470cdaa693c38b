"""What several operators of this package share: intermediate tables and word hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens import session

WORD = r"[^\x20\x09-\x0D]+"
_GOLD = 0x9E3779B97F4A7C15
_INVERSE = pow(_GOLD, -1, 1 << 64)


def scratch(spark: SparkSession, label: str) -> str:
    """An unused path in the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{session.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and continues from its files, which cuts lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a :func:`stored` table that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, files = session.hadoop_path(df.sparkSession, folder)
        files.delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps whose results are stored.

    Spark's cleaner drops a shuffle once nobody refers to it any more, which it learns from a
    garbage collection on the driver.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """While the steps within run, Spark ends an Arrow batch for workers once it has ``most`` bytes, so with one row of more.

    Otherwise it goes on to 64 MB, which the executor holds twice outside of its heap, both times with
    room to grow, and the worker once more. Only where batches end changes, not their rows.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


HEAVY_KEYS = 1024


def join_unique(rows: DataFrame, facts: DataFrame, on: list[str], held: str) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row per key and in ``held`` how many ``rows`` share it.

    Keys of more than a 1024th of all rows are at most 1024, whatever the data: they are
    broadcast, so that no task gets all rows of one. The others are shuffled.
    """
    facts = stored(facts, "facts")
    total = facts.agg(F.sum(held)).head()[0] or 0
    heavy = F.col(held) > total // HEAVY_KEYS + 1
    few = F.broadcast(facts.where(heavy))
    rest = rows.join(F.broadcast(facts.where(heavy).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(facts.where(~heavy), on))


def low(text: Column) -> Column:
    """Only A-Z lower-cased; a missing text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """A 128-bit digest as text, by which equal texts are recognised (missing equals empty)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_numbers(values: list[int | None]) -> pd.arrays.IntegerArray:
    """64-bit numbers beside missing ones. Columns of both would become floats, which change large ids."""
    missing = np.array([v is None for v in values], bool)
    return pd.arrays.IntegerArray(np.array([0 if v is None else v for v in values], np.int64), missing)


# --- numpy -------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes (wraps around)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _GOLD), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes: entry i covers the first i bytes."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that do not depend on where a span stands."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ``outside``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~outside[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def joined_bytes(texts: list[str | None], separator: bytes = b"\n") -> tuple[bytes, np.ndarray]:
    """All texts in one byte string, each followed by ``separator``, and where each one starts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + len(separator) for b in raw], out=starts[1:])
    return separator.join([*raw, b""]) if raw else b"", starts


def in_batches(texts: list[str | None], most: int = 1 << 20):
    """Cuts a list of texts into (from, to) pieces of about ``most`` characters, whole texts each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def in_pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into slices of about ``most`` bytes, so that a worker makes objects of so much at a time.

    Workers outlive their tasks: what Arrow does not use any more goes back after each batch.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
        batch = None
        pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()
