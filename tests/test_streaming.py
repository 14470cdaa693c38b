import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import rows
from merchlens.operators import merge
from merchlens.sources import catalog
from merchlens.streaming import jobs as streams

STAGED = "sig_hash string, name string, winner_score int, seq long"


def feed(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_keeps_the_last_row_over_batches(spark, tmp_path):
    source, root, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def run():
        stream = spark.readStream.schema(STAGED).parquet(source)
        streams.stream_ingest(stream, root, state).awaitTermination()
        return rows(merge.read_merged(spark, root, keep_old_if_null={"winner_score": 0}))

    feed(spark, source, [("a", "A", 5, 1), ("a", "A2", None, 2), ("b", "B", None, 3)], STAGED)
    assert run() == [("a", "A2", 0), ("b", "B", 0)]
    feed(spark, source, [("a", "A3", 9, 1)], STAGED)
    assert run() == [("a", "A3", 9), ("b", "B", 0)]
    feed(spark, source, [("b", "B2", None, 1), ("a", "A4", None, 2)], STAGED)
    assert run() == [("a", "A4", 9), ("b", "B2", 0)]
    assert run() == [("a", "A4", 9), ("b", "B2", 0)]  # nothing new


def test_raw_files_become_products(spark, tmp_path):
    source, root, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()

    def run():
        stream = catalog.stream_catalog(spark, str(source), ["Nombre", "Precio"])
        streams.stream_import(stream, root, state, source="feed").awaitTermination()
        return rows(merge.read_merged(spark, root, keep_old_if_null={"winner_score": 0}), "name", "price", "source", "winner_score")

    (source / "a.csv").write_text("Nombre,Precio\nLamp,\"1,5\"\nBox,2\nlamp,3\n")
    assert run() == [("Box", 2.0, "feed", 0), ("lamp", 3.0, "feed", 0)]  # the later line wins
    (source / "b.csv").write_text("Nombre,Precio\nBOX,9\n")
    assert run() == [("BOX", 9.0, "feed", 0), ("lamp", 3.0, "feed", 0)]


def test_late_rows_are_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, units double, revenue double"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return streams.run_to_files(streams.stream_trends(stream), out, state)

    feed(spark, source, [(datetime(2024, 1, 1, 5), 1.0, 2.0), (datetime(2024, 1, 4), 1.0, 1.0)], schema)
    assert [str(d) for d, *_ in rows(run())] == ["2024-01-01"]
    feed(spark, source, [(datetime(2024, 1, 1, 6), 9.0, 9.0), (datetime(2024, 1, 9), 1.0, 1.0)], schema)
    assert [(str(d), n, u) for d, n, u, _ in rows(run())] == [("2024-01-01", 1, 1.0), ("2024-01-04", 1, 1.0)]


def test_weeks_start_on_monday(spark, tmp_path):
    schema = "ts timestamp, units double, revenue double"
    source = str(tmp_path / "in")
    feed(spark, source, [(datetime(2024, 1, 7, 23), 1.0, 0.0), (datetime(2024, 1, 8), 1.0, 0.0), (datetime(2024, 2, 20), 1.0, 0.0)], schema)
    stream = streams.stream_trends(spark.readStream.schema(schema).parquet(source), weekly=True)
    got = rows(streams.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    assert [str(d) for d, *_ in got] == ["2024-01-01", "2024-01-08"]


def test_first_row_of_a_key_is_kept(spark, tmp_path):
    schema = "sig_hash string, ts timestamp, n long"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n in (1, 2):
        feed(spark, source, [("a", datetime(2024, 1, 1, n), n)], schema)
        stream = spark.readStream.schema(schema).parquet(source)
        got = rows(streams.run_to_files(streams.stream_dedup(stream, ["sig_hash"]), out, state), "n")
        assert got == [(1,)]


def test_metrics_and_lookup(spark, tmp_path):
    schema = "id long, sig_hash string"
    source, table, metrics, state = (str(tmp_path / n) for n in ("in", "table", "metrics", "state"))
    feed(spark, source, [(1, "a"), (2, "b")], schema)
    stream = spark.readStream.schema(schema).parquet(source)
    query, listener = streams.stream_metrics(stream, table, metrics, state)
    streams.finish(query, listener)
    listener.written.clear()
    listener.record(query.recentProgress[-1])  # a batch that is reported again
    (row,) = spark.read.parquet(metrics).collect()
    assert (row["batch_no"], row["rows"]) == (0, 2) and spark.read.parquet(table).count() == 2
    progress = query.recentProgress[0]
    assert row["duration_ms"] == progress["durationMs"]["triggerExecution"] and row["throughput"] == pytest.approx(2000 / row["duration_ms"])
    cache = spark.createDataFrame([("a", 5)], "sig_hash string, v int").withColumn("updated_at", F.lit(datetime(2024, 1, 1)))
    found = streams.stream_enrich_lookup(stream, cache, datetime(2024, 1, 2)).select("id", "hit", "v")
    got = rows(streams.run_to_files(found, str(tmp_path / "out"), str(tmp_path / "state2")))
    assert got == [(1, True, 5), (2, False, None)]


def test_a_checkpoint_made_anew_replaces_nothing(spark, tmp_path):
    root, state, table, metrics = (str(tmp_path / n) for n in ("products", "state", "rows", "metrics"))
    for n, names in enumerate((["Lamp", "Box"], ["Pen"])):
        feed(spark, str(tmp_path / f"in{n}"), [(name[0], name, None, i) for i, name in enumerate(names)], STAGED)
        stream = spark.readStream.schema(STAGED).parquet(str(tmp_path / f"in{n}"))
        streams.stream_ingest(stream, root, state).awaitTermination()
        streams.finish(*streams.stream_metrics(stream, table, metrics, f"{state}-metrics"))
        for folder in (state, f"{state}-metrics"):
            shutil.rmtree(folder)
    got = merge.read_merged(spark, root, keep_old_if_null={"winner_score": 0})
    assert sorted(r["name"] for r in got.collect()) == ["Box", "Lamp", "Pen"]
    assert spark.read.parquet(table).count() == 3 and rows(spark.read.parquet(metrics), "batch_no", "rows") == [(0, 1), (0, 2)]


def test_keyed_state_passes_on_what_is_newer(spark, tmp_path):
    source, root, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def run():
        streams.stream_latest(spark.readStream.schema(STAGED).parquet(source), root, state).awaitTermination()
        return rows(merge.read_merged(spark, root), "sig_hash", "name", "seq")

    feed(spark, source, [("a", "A1", 1, 10), ("a", "A3", 3, 30), ("b", "B", None, 5), (None, "N", 1, 1), ("c", "C", 1, None)], STAGED)
    assert run() == [("a", "A3", 30), ("b", "B", 5)]
    feed(spark, source, [("a", "A2", 2, 20), ("b", "B", None, 5), ("b", "B6", None, 6)], STAGED)  # late, repeated, newer
    assert run() == [("a", "A3", 30), ("b", "B6", 6)]
    changes = spark.read.parquet(root)
    assert changes.count() == 3 and changes.select("run").distinct().count() == 1


def test_imports_with_own_checkpoints_add_up(spark, tmp_path):
    root = str(tmp_path / "products")
    schema = "sig_hash string, name string, winner_score int, seq long"
    for n, names in enumerate((["Lamp", "Box"], ["Pen"], ["Pen"])):
        staged = spark.createDataFrame([(name[0], name, None, i) for i, name in enumerate(names)], schema)
        staged.write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n}"))
        streams.stream_ingest(stream, root, str(tmp_path / f"checkpoint{n}")).awaitTermination()
    got = merge.read_merged(spark, root, keep_old_if_null={"winner_score": 0})
    assert sorted(r["name"] for r in got.collect()) == ["Box", "Lamp", "Pen"]
