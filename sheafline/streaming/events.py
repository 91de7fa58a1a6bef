"""The event log as streams: writing into it, reading from it, refreshing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafline.functions.text import parse_json
from sheafline.functions.times import utc_naive
from sheafline.operators.quality import metric_partials
from sheafline.session import path_exists
from sheafline.sources import keyedtable
from sheafline.sources.eventlog import assign_ids, event_summary, to_events

STREAM_SCHEMA = (
    "id bigint, payload string, created_at timestamp, batch_id bigint, topic string"
)
HEAD_SCHEMA = "topic string, inserted bigint, last_event_id bigint, batch_id bigint"


def file_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A stream over the files of a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def event_pipe(
    stream: DataFrame,
    log: str,
    checkpoint: str,
    order: Sequence[str],
    topic: str | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    on_chunk: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Drain a stream into a log.

    Each micro-batch goes to its own ``batch_id`` folder, which counts once Spark
    has marked it as complete. A batch that is run again after a failure finds
    the mark and leaves the files alone, so a reader who has seen them sees
    them once; without the mark it overwrites what is there. Ids follow the head
    written by the batch before, so they are the same either way. ``transform`` maps the
    batch before it turns to JSON; ``on_chunk`` sees the batch as a side
    effect, at least once.
    """
    heads = log.rstrip("/") + "_heads"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, f"{heads}/batch_id={batch_id}/_SUCCESS"):
            return
        if transform is not None:
            batch = transform(batch)
        last = 0
        if batch_id > 0:
            before = spark.read.schema(HEAD_SCHEMA).parquet(f"{heads}/batch_id={batch_id - 1}")
            row = before.agg(F.max("last_event_id").alias("m")).first()
            last = int(row["m"] or 0)
        created = F.col("created_at") if "created_at" in batch.columns else F.current_timestamp()
        events = assign_ids(to_events(batch, topic), order, last)  # materialised there
        if on_chunk is not None:
            on_chunk(events, batch_id)
        rows = events.select("id", "topic", "payload", created.alias("created_at"))
        even = rows if topic is not None else rows.hint("rebalance", "topic")
        target = f"{log.rstrip('/')}/batch_id={batch_id}"
        if not path_exists(spark, f"{target}/_SUCCESS"):
            even.write.mode("overwrite").partitionBy("topic").parquet(target)
        head = event_summary(rows).unionByName(
            spark.range(1).select(  # carries the last id over an empty batch
                F.lit(None).cast("string").alias("topic"),
                F.lit(0).cast("bigint").alias("inserted"),
                F.lit(last).cast("bigint").alias("last_event_id"),
            )
        )
        head.coalesce(1).write.mode("overwrite").parquet(f"{heads}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def pipe_summary(spark: SparkSession, log: str) -> DataFrame:
    """Per topic, what ``event_pipe`` has written so far: events and last id."""
    heads = spark.read.schema(HEAD_SCHEMA).parquet(log.rstrip("/") + "_heads")
    return (
        heads.filter(F.col("topic").isNotNull())
        .groupBy("topic")
        .agg(F.sum("inserted").alias("inserted"), F.max("last_event_id").alias("last_event_id"))
    )


def event_stream(
    spark: SparkSession,
    log: str,
    topic: str,
    payload: str,
    since_id: int = 0,
    max_files: int | None = None,
) -> DataFrame:
    """New events of a topic with their payload parsed to schema ``payload``.

    The checkpoint of the query that uses it is the consumer's offset.
    ``since_id`` is for a first start without one.
    """
    options = {"maxFilesPerTrigger": str(max_files)} if max_files else {}
    rows = file_stream(spark, log, STREAM_SCHEMA, **options)
    return rows.filter((F.col("topic") == topic) & (F.col("id") > since_id)).select(
        "id", "created_at", parse_json(F.col("payload"), payload).alias("payload")
    )


def deliver(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    in_order: Sequence[str] = ("id",),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand a stream to a folder, sorted inside each micro-batch.

    A batch that is run again finds its folder complete and leaves it, so
    readers of the sink see each event once. There is no order across batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if path_exists(batch.sparkSession, f"{sink}/batch_id={batch_id}/_SUCCESS"):
            return
        rows = batch.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
        rows.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def daily_refresh(
    stream: DataFrame, ts: str, by: Sequence[str], measure: str, lateness: str = "1 hour"
) -> DataFrame:
    """Events, and mean measure, per day. In append mode a day is emitted once
    the watermark has passed its end."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day").alias("w"), *by)
        .agg(F.count("*").alias("n"), F.avg(measure).alias("mean_value"))
        .select(utc_naive(F.col("w.start")).alias("day"), *by, "n", "mean_value")
    )


def keep_metric(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    measure: str,
    by: Sequence[str] = ("area",),
    unit: str = "day",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the partial sums of a metric per period in the stored table ``path``.

    Each micro-batch adds its own sums to the periods it touches, late facts as well, however late; no
    watermark drops any. A batch that is run again is passed over.
    """
    columns = ["period", *by]

    def write(batch: DataFrame, batch_id: int) -> None:
        partials = metric_partials(batch, measure, by, unit)
        keyedtable.add_up(partials, path, columns, ["total", "n"], batch=(checkpoint, batch_id))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
