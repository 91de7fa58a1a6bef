"""Streams: same answer as the batch, restarts without repeats, replays."""

import pytest
from pyspark.sql import functions as F

from sheafline.functions.times import utc_instant
from sheafline.sources import eventlog as L
from sheafline.streaming import events as E

SCHEMA = "n bigint, topic string"


def land(spark, path, low, high, files=2):
    spark.range(low, high, 1, files).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("topic")
    ).write.mode("append").parquet(path)


def drain(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture()
def paths(tmp_path):
    return {k: str(tmp_path / k) for k in ("in", "log", "state", "sink", "sink_state", "tee")}


def test_pipe_resumes_with_growing_ids(spark, paths):
    """Two runs over one checkpoint; several files a run, one a batch."""
    for low, high in ((0, 50), (50, 80)):
        land(spark, paths["in"], low, high)
        stream = E.file_stream(spark, paths["in"], SCHEMA, maxFilesPerTrigger="1")
        drain(E.event_pipe(stream, paths["log"], paths["state"], ["n"]))
    rows = L.read_log(spark, paths["log"]).collect()
    assert sorted(r.id for r in rows) == list(range(1, 81))
    assert {r.payload for r in rows} == {f'{{"n":{i}}}' for i in range(80)}
    got = {r.topic: (r.inserted, r.last_event_id) for r in E.pipe_summary(spark, paths["log"]).collect()}
    batch = {r.topic: (r.inserted, r.last_event_id)
             for r in L.event_summary(L.read_log(spark, paths["log"])).collect()}
    assert got == batch and sum(n for n, _ in got.values()) == 80


def test_a_batch_run_again_replaces_itself(spark, paths):
    """Fails after the events are written and before the batch is committed."""
    land(spark, paths["in"], 0, 30, 1)
    land(spark, paths["in"], 30, 40, 1)
    calls = []

    def tee(batch, batch_id):
        calls.append(batch_id)
        batch.select("id", "n").write.mode("overwrite").parquet(f"{paths['tee']}/batch_id={batch_id}")
        if calls.count(1) == 1 and batch_id == 1:
            raise RuntimeError("lost")

    def run():
        stream = E.file_stream(spark, paths["in"], SCHEMA, maxFilesPerTrigger="1")
        return E.event_pipe(
            stream, paths["log"], paths["state"], ["n"],
            transform=lambda b: b.withColumn("sq", F.col("n") * F.col("n")), on_chunk=tee,
        )

    with pytest.raises(Exception, match="lost"):
        run().awaitTermination(120)
    drain(run())
    assert calls == [0, 1, 1]
    rows = L.read_log(spark, paths["log"]).collect()
    assert sorted(r.id for r in rows) == list(range(1, 41))
    assert '{"n":5,"sq":25}' in {r.payload for r in rows}
    assert spark.read.parquet(paths["tee"]).count() == 40


def test_stream_of_one_topic_since_an_id(spark, paths):
    land(spark, paths["in"], 0, 60)
    stream = E.file_stream(spark, paths["in"], SCHEMA)
    drain(E.event_pipe(stream, paths["log"], paths["state"], ["n"]))
    for _ in range(2):  # the second run finds nothing new
        events = E.event_stream(spark, paths["log"], "a", "n bigint", since_id=10, max_files=1)
        drain(E.deliver(events.select("id", "payload.n"), paths["sink"], paths["sink_state"]))
    got = {(r.id, r.n) for r in spark.read.parquet(paths["sink"]).collect()}
    want = L.event_read(L.read_log(spark, paths["log"]), "a", 10, None).collect()
    assert got == {(r.id, int(r.payload[5:-1])) for r in want} and len(got) == len(want)


def test_delivery_is_sorted_inside_a_batch(spark, paths):
    land(spark, paths["in"], 0, 500, 5)
    stream = E.file_stream(spark, paths["in"], SCHEMA)
    drain(E.deliver(stream, paths["sink"], paths["sink_state"], in_order=["n"]))
    files = (
        spark.read.parquet(paths["sink"])
        .select("n", F.col("_metadata.file_name").alias("f"))
        .groupBy("f")
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        .orderBy("lo")
        .collect()
    )
    assert all(a.hi < b.lo for a, b in zip(files, files[1:]))


def test_days_close_with_the_watermark(spark, paths):
    rows = [("2024-01-01 10:00:00", "x", 1.0), ("2024-01-01 11:00:00", "x", 3.0),
            ("2024-01-02 10:00:00", "y", 5.0), ("2024-01-03 00:30:00", "x", 7.0)]
    df = spark.createDataFrame(rows, "t string, kind string, v double")
    df.select(F.col("t").cast("timestamp_ntz").alias("t"), "kind", "v").write.parquet(paths["in"])
    stream = E.file_stream(spark, paths["in"], "t timestamp_ntz, kind string, v double")
    days = E.daily_refresh(stream.select(utc_instant(F.col("t")).alias("t"), "kind", "v"), "t", ["kind"], "v")
    drain(
        days.writeStream.format("parquet").option("checkpointLocation", paths["state"])
        .trigger(availableNow=True).start(paths["sink"])
    )
    got = [(str(r.day)[:10], r.kind, r.n, r.mean_value) for r in spark.read.parquet(paths["sink"]).collect()]
    assert got == [("2024-01-01", "x", 2, 2.0)]


def test_a_reader_between_write_and_commit_sees_events_once(spark, paths, monkeypatch):
    """A batch fails between its events and its head; a reader has seen the events by then."""
    land(spark, paths["in"], 0, 20, 1)
    real, fails = E.event_summary, [True]

    def summary(rows):
        if fails:
            fails.pop()
            raise RuntimeError("lost")
        return real(rows)

    monkeypatch.setattr(E, "event_summary", summary)

    def pipe():
        return E.event_pipe(E.file_stream(spark, paths["in"], SCHEMA), paths["log"], paths["state"], ["n"], topic="a")

    def read():
        events = E.event_stream(spark, paths["log"], "a", "n bigint")
        drain(E.deliver(events.select("id", "payload.n"), paths["sink"], paths["sink_state"]))

    with pytest.raises(Exception, match="lost"):
        pipe().awaitTermination(120)
    read()
    drain(pipe())
    read()
    assert sorted(r.id for r in spark.read.parquet(paths["sink"]).collect()) == list(range(1, 21))
    assert {r.topic: r.inserted for r in E.pipe_summary(spark, paths["log"]).collect()} == {"a": 20}
