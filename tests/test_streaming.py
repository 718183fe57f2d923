"""Streams give what the same windows give over a table."""

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import timeseries
from sparkweave.streaming import consumers, windows


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    """Points of three keys over two hours in three files, the last of which moves the watermark past all others."""
    rows = [(f"k{i % 3}", f"s{i * i // 40 % 2}", float(i % 7), 1_700_000_000 + i * 60 + (600 if i > 40 and i % 3 == 0 else 0)) for i in range(120)]
    path = str(tmp_path_factory.mktemp("stream"))
    frame = spark.createDataFrame(rows, "key string, state string, value double, s long").select("key", "state", "value", F.timestamp_seconds("s").alias("ts"))
    frame.where("value >= 0").coalesce(1).write.mode("append").parquet(path)
    last = spark.createDataFrame([("end", "s", 0.0, 1_700_900_000)], frame.schema.names[:3] + ["s"]).select("key", "state", "value", F.timestamp_seconds("s").alias("ts"))
    last.coalesce(1).write.mode("append").parquet(path)
    return spark, path, frame


def run(spark, stream, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("maxFilesPerTrigger", 1).start()
    query.awaitTermination(120)
    return spark.table(name)


def source(points):
    spark, path, frame = points
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.where("key != 'end'").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_tumbling_stream(points):
    spark, _, frame = points
    got = run(spark, windows.tumbling(source(points), "10 minutes", "value", ["sum", "count"], ["key"]), "tumbling")
    same(got, timeseries.tumbling(frame, 600_000, "value", ["sum", "count"], ["key"]))


def test_sliding_stream(points):
    spark, _, frame = points
    got = run(spark, windows.sliding(source(points), "20 minutes", "5 minutes", "value", ["sum", "count"], ["key"]), "sliding")
    same(got, timeseries.sliding(frame, 1_200_000, 300_000, "value", ["sum", "count"], ["key"]))


def test_session_stream(points):
    spark, _, frame = points
    got = run(spark, windows.session(source(points), "5 minutes", "value", ["sum", "count"], ["key"]), "sessions")
    same(got, timeseries.session(frame, 300_000, "value", ["sum", "count"], ["key"]))


def test_state_stream(points):
    spark, _, frame = points
    got = run(spark, windows.state_runs(source(points), "key", "state", "value"), "runs")
    same(got, timeseries.state(frame, "state", "value", ["sum", "count"], ["key"]).select("key", "state", "bucket", "count", "sum"))


def test_consumer_takes_every_visible_message_once(spark, tmp_path):
    rows = [(i, i * 7 % 10, 0, 0 if i % 4 else 50) for i in range(100)]
    path = str(tmp_path / "messages")
    frame = spark.createDataFrame(rows, "id long, priority int, deliver_at long, expire_at long")
    for part in (frame.where("id < 50"), frame.where("id >= 50")):
        part.coalesce(1).write.mode("append").parquet(path)
    taken = []
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = consumers.consume(stream, lambda batch, n: taken.append([r.id for r in batch.collect()]), str(tmp_path / "state"), now=100)
    query.awaitTermination(60)
    assert sorted(sum(taken, [])) == [i for i in range(100) if i % 4]
    order = {r[0]: r[1] for r in rows}
    assert all([order[i] for i in batch] == sorted(order[i] for i in batch) for batch in taken)


def test_last_values_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "writes")
    spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "key string, value string, seq long").write.parquet(path)
    stream = consumers.last_values(spark.readStream.schema("key string, value string, seq long").parquet(path))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("last_values").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert dict(map(tuple, spark.table("last_values").collect())) == {"a": "3", "b": "2"}
