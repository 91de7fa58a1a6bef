"""Streams over the given events, run until the input is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions.times import utc_instant
from sheafline.plans import fragments as Q
from sheafline.plans.registry import query
from sheafline.session import scratch_path
from sheafline.sources import eventlog as L
from sheafline.streaming import events as E

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
_WAIT = 1800


def _events(spark, sf):
    return E.file_stream(spark, sf, EVENT_SCHEMA, pathGlobFilter="events.parquet")


def _drain(started) -> None:
    if not started.awaitTermination(_WAIT):
        started.stop()
        raise TimeoutError("the stream was not drained in time")


def _piped(spark, sf, **hooks) -> str:
    """A log holding all events as ``{event_id, user_id}`` under their type."""
    log = scratch_path(spark, "pipe")
    source = _events(spark, sf).select(
        "event_id", "user_id", F.col("event_type").alias("topic")
    )
    _drain(E.event_pipe(source, log, f"{log}_state", ["event_id"], **hooks))
    return log


_PIPED = """SELECT event_id + 1 AS id, event_type AS topic,
  CAST(json_object('event_id', event_id, 'user_id', user_id{extra}) AS VARCHAR) AS payload
  FROM events"""


@query("event_pipe", _PIPED.replace("{extra}", ""))
def event_pipe(spark, sf):
    return L.read_log(spark, _piped(spark, sf)).select("id", "topic", "payload")


@query("stream_transform", _PIPED.replace("{extra}", ", 'even', user_id % 2 = 0"))
def stream_transform(spark, sf):
    """The hook adds a field before rows turn to JSON."""
    log = _piped(
        spark, sf, transform=lambda b: b.withColumn("even", F.col("user_id") % 2 == 0)
    )
    return L.read_log(spark, log).select("id", "topic", "payload")


@query(
    "stream_tee",
    """SELECT event_id + 1 AS id, event_type AS topic FROM events""",
)
def stream_tee(spark, sf):
    """The side effect writes a second copy."""
    side = scratch_path(spark, "tee")

    def tee(batch, batch_id):
        batch.select("id", "topic").write.mode("overwrite").parquet(f"{side}/batch_id={batch_id}")

    _piped(spark, sf, on_chunk=tee)
    return spark.read.schema("id bigint, topic string").parquet(side).select("id", "topic")


@query(
    "pipe_summary",
    """SELECT event_type AS topic, CAST(count(*) AS BIGINT) AS inserted,
              max(event_id) + 1 AS last_event_id FROM events GROUP BY 1""",
)
def pipe_summary(spark, sf):
    return E.pipe_summary(spark, _piped(spark, sf))


@query(
    "event_stream",
    """SELECT event_id + 1 AS id, event_id, user_id FROM events
       WHERE event_type = 'click' AND event_id + 1 > 500""",
)
def event_stream(spark, sf):
    """Piped into a log, read back as a stream of one topic, a file at a time."""
    log = _piped(spark, sf)
    sink = scratch_path(spark, "sink")
    stream = E.event_stream(
        spark, log, "click", "event_id bigint, user_id bigint", since_id=500, max_files=1
    )
    _drain(E.deliver(stream.select("id", "payload.*"), sink, f"{sink}_state"))
    rows = spark.read.schema("id bigint, event_id bigint, user_id bigint").parquet(sink)
    return rows.select("id", "event_id", "user_id")


@query(
    "stream_resume",
    f"""WITH {Q.EVENT_LOG} SELECT id, topic FROM event_log""",
)
def stream_resume(spark, sf):
    """Two runs over one checkpoint: the second takes only what came between."""
    landing, sink = scratch_path(spark, "landing"), scratch_path(spark, "resume")
    rows = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet").select(
        (F.col("event_id") + 1).alias("id"), F.col("event_type").alias("topic")
    )
    early = F.col("topic").isin("click", "view")
    for part in (rows.filter(early), rows.filter(~early)):
        part.write.mode("append").parquet(landing)
        stream = E.file_stream(spark, landing, "id bigint, topic string")
        _drain(E.deliver(stream, sink, f"{sink}_state"))
    return spark.read.schema("id bigint, topic string").parquet(sink).select("id", "topic")


@query(
    "daily_refresh",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n,
              avg(CAST(round(value * 100) AS BIGINT)) AS mean_cents
       FROM events
       WHERE date_trunc('day', ts) + INTERVAL 1 DAY
             <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)
       GROUP BY 1, 2""",
)
def daily_refresh(spark, sf):
    """Days that the watermark has closed; the last day stays open."""
    sink = scratch_path(spark, "daily")
    stream = _events(spark, sf).select(
        utc_instant(F.col("ts")).alias("ts"),
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    days = E.daily_refresh(stream, "ts", ["event_type"], "cents")
    _drain(
        days.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{sink}_state")
        .trigger(availableNow=True)
        .start(sink)
    )
    return spark.read.parquet(sink).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "event_type",
        "n",
        F.col("mean_value").alias("mean_cents"),
    )
