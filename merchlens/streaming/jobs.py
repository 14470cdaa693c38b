"""Structured Streaming versions of the import, the period buckets and the cache lookup."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from threading import Lock

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from merchlens.functions.numbers import money_sum
from merchlens.operators.enrich import cache_lookup
from merchlens.operators.merge import append_changes, dedup_last
from merchlens.sources.catalog import SEQ_COLUMN, map_columns, number_lines
from merchlens.sources.normalise import normalise_products

WEEK_START_OFFSET = "4 days"  # the epoch is a Thursday, weeks start on Monday


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query_id(batch: DataFrame) -> str:
    """The id of the streaming query that a batch belongs to. A checkpoint made anew has another."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def stream_ingest(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    sequence: str = "seq",
    key: str = "sig_hash",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    **trigger,
) -> StreamingQuery:
    """Adds the last staged row per signature of every batch to the changes in the folder ``root``.

    A batch costs what it holds, not what the table holds: read the table with ``read_merged``.
    Files are named by the query's own id, which its checkpoint keeps, and the batch: a batch that
    runs again after a failure replaces its own changes, and no other query's or checkpoint's.
    ``prepare`` turns a batch into staged rows; ``trigger`` is passed on, for example
    ``availableNow=True``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        run = query_id(batch)
        batch = prepare(batch) if prepare else batch
        append_changes(dedup_last(batch, [key], sequence).drop(sequence), root, run, batch_id)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class LastRow(StatefulProcessor):
    """Keeps each key's highest sequence number and passes on the rows that raise it."""

    def __init__(self, sequence: str, kind: str) -> None:
        self.sequence, self.kind = sequence, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", f"sequence {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max((r for r in rows if r[self.sequence] is not None), key=lambda r: r[self.sequence], default=None)
        if last is None or (self.highest.exists() and self.highest.get()[0] >= last[self.sequence]):
            return
        self.highest.update((last[self.sequence],))
        yield last

    def close(self) -> None:
        pass


def stream_latest(
    stream: DataFrame, root: str, checkpoint: str, sequence: str = "seq", key: str = "sig_hash", **trigger
) -> StreamingQuery:
    """Adds a row to the changes in ``root`` only if its sequence number is its key's highest so far.

    The highest number of each key is keyed state of the query, so that rows that come again, or
    late behind newer ones, change nothing, whichever batch they come in; :func:`stream_ingest` lets the
    later batch win. Rows without a key or number are left out. The sequence is kept as a column.
    """
    spark = stream.sparkSession
    kind = stream.schema[sequence].dataType.simpleString()
    rows = stream.where(F.col(key).isNotNull()).groupBy(key)
    latest = rows.transformWithState(LastRow(sequence, kind), outputStructType=stream.schema, outputMode="Append", timeMode="None")

    def apply(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch, root, query_id(batch), batch_id)

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # the state store that keyed state needs; a query keeps what it starts with
    try:
        return (
            latest.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)


def stream_import(
    raw: DataFrame, root: str, checkpoint: str, locale: str = "eu", source: str | None = None, **trigger
) -> StreamingQuery:
    """Raw catalogue rows to stored products: header mapping, typing, last row per signature.

    ``raw`` comes from ``sources.catalog.stream_catalog``. Mapping and typing are
    projections; only the dedup of a batch shuffles.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        return normalise_products(map_columns(number_lines(batch)), locale, source)

    return stream_ingest(raw, root, checkpoint, SEQ_COLUMN, prepare=prepare, **trigger)


def stream_trends(rows: DataFrame, time_col: str = "ts", delay: str = "1 day", weekly: bool = False) -> DataFrame:
    """Units and revenue per day, or per Monday week; rows behind the watermark are dropped."""
    if weekly:
        bucket = F.window(time_col, "7 days", "7 days", WEEK_START_OFFSET)
    else:
        bucket = F.window(time_col, "1 day")
    return (
        rows.withWatermark(time_col, delay)
        .groupBy(bucket.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("units").alias("units"),
            money_sum(F.col("revenue")).alias("revenue"),
        )
        .select(F.col("bucket.start").cast("date").alias("date"), "rows", "units", "revenue")
    )


def stream_dedup(rows: DataFrame, keys: list[str], time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """First row per key within the watermark."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def stream_enrich_lookup(rows: DataFrame, cache: DataFrame, as_of, ttl_days: int = 30) -> DataFrame:
    """Stream rows joined to the cache table, with a ``hit`` flag."""
    return cache_lookup(rows, cache, as_of, ttl_days)


class ProgressTable(StreamingQueryListener):
    """Writes a row of rows, duration and throughput per batch of the named query, from Spark's own progress."""

    def __init__(self, spark: SparkSession, name: str, folder: str) -> None:
        self.spark, self.name, self.folder = spark, name, folder
        self.written, self.lock = set(), Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.record(event.progress)

    def onQueryTerminated(self, event) -> None:
        pass

    def record(self, progress) -> None:
        """One row a query and batch: a batch that runs again replaces its row."""
        with self.lock:  # the listener's thread and who waits for the query may report at once
            batch = progress["batchId"], progress["timestamp"]
            if batch in self.written:
                return
            rows, duration = int(progress["numInputRows"]), float(progress["durationMs"]["triggerExecution"])
            figures = [(int(progress["batchId"]), rows, duration, rows * 1000.0 / max(duration, 1.0))]
            table = self.spark.createDataFrame(figures, "batch_no long, rows long, duration_ms double, throughput double")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/run={progress['id']}/batch_id={progress['batchId']}")
            self.written.add(batch)


def stream_metrics(
    stream: DataFrame, table: str, metrics_table: str, checkpoint: str, **trigger
) -> tuple[StreamingQuery, ProgressTable]:
    """Stores each batch under ``table``, and what Spark reports about it under ``metrics_table``.

    Both are keyed by the query's id and the batch, so a batch that runs again replaces what it
    wrote, and neither another stream nor a checkpoint made anew replaces anything. The rows of
    metrics are written by a listener while the query runs; :func:`finish` waits for both.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/run={query_id(batch)}/batch_id={batch_id}")

    spark = stream.sparkSession
    listener = ProgressTable(spark, f"metrics-{uuid.uuid4().hex}", metrics_table)
    spark.streams.addListener(listener)
    query = (
        stream.writeStream.foreachBatch(apply)
        .queryName(listener.name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return query, listener


def finish(query: StreamingQuery, listener: ProgressTable) -> None:
    """Waits for a query's end, and writes the rows that its listener was not told in time."""
    query.awaitTermination()
    listener.spark.streams.removeListener(listener)
    for progress in query.recentProgress:
        listener.record(progress)


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is available now into Parquet files and reads them back."""
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
