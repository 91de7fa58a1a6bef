"""The append-only event log, batch half, and consumer offsets.

A log is a parquet folder with ``id, payload, created_at`` and a folder per
topic, so a reader of one topic prunes the others and the id bound reaches the
scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sheafline.session import cut

LOG_SCHEMA = "id bigint, payload string, created_at timestamp, topic string"
PAGE = 256


def to_events(df: DataFrame, topic: str | None = None, cols: Sequence[str] = ()) -> DataFrame:
    """(topic, payload): each row as JSON. Without ``topic`` the row's own."""
    body = [c for c in (cols or df.columns) if c != "topic" or topic is not None]
    name = F.lit(topic) if topic is not None else F.col("topic")
    return df.withColumn("payload", F.to_json(F.struct(*body))).withColumn("topic", name)


def assign_ids(batch: DataFrame, order: Sequence[str], last_id: int = 0) -> DataFrame:
    """Add ``id`` = last_id + 1, +2, ... in ``order`` (which must be unique).

    Rows are range-partitioned and sorted, then fixed in reliable storage, so
    that the row counts per partition stay true; a partition's ids start after
    the counts before it. Only those counts, one row per partition, meet.
    """
    placed = (
        batch.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    fixed = cut(placed).withColumn("_p", F.shiftright("_m", 33))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_p")
        .agg(F.count("*").alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        # one row per partition of the batch, whatever the batch holds
        fixed.join(F.broadcast(offsets), "_p")
        .withColumn("id", F.lit(last_id) + F.col("_before") + within + 1)
        .drop("_m", "_p", "_before")
    )


def last_event_id(spark: SparkSession, path: str) -> int:
    """The highest id in the log, from file statistics where Spark can."""
    row = read_log(spark, path).agg(F.max("id").alias("m")).first()
    return int(row["m"] or 0)


def event_append(
    df: DataFrame, path: str, topic: str | None, order: Sequence[str], last_id: int = 0
) -> DataFrame:
    """Append rows as events; returns the summary of what was written."""
    events = assign_ids(to_events(df, topic), order, last_id)
    created = F.col("created_at") if "created_at" in df.columns else F.current_timestamp()
    rows = events.select("id", "topic", "payload", created.cast("timestamp").alias("created_at"))
    # many topics: AQE splits the large ones and packs the small ones into files
    even = rows if topic is not None else rows.hint("rebalance", "topic")
    even.write.mode("append").partitionBy("topic").parquet(path)
    return event_summary(rows)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def event_read(
    log: DataFrame, topic: str, since_id: int | Column = 0, page: int | None = PAGE
) -> DataFrame:
    """Events of a topic after ``since_id``, in id order, at most a page."""
    rows = log.filter((F.col("topic") == topic) & (F.col("id") > since_id)).select("id", "payload")
    return rows.orderBy("id") if page is None else page_limit(rows, page)


def page_limit(log: DataFrame, page: int = PAGE) -> DataFrame:
    """The first ``page`` rows by id."""
    return log.orderBy("id").limit(page)


def event_summary(log: DataFrame) -> DataFrame:
    """Per topic: events and last id."""
    return log.groupBy("topic").agg(
        F.count("*").alias("inserted"), F.max("id").alias("last_event_id")
    )


def resume_join(log: DataFrame, readers: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events each reader (``consumer``, ``topic``) has yet to see. A consumer
    without an offset starts at 0."""
    due = readers.join(offsets, "consumer", "left").select(
        "consumer", "topic", F.coalesce("last_id", F.lit(0)).alias("last_id")
    )
    # the least offset reaches the scan; a join condition would not
    least = due.agg(F.min("last_id")).scalar()
    return (
        log.filter(F.col("id") > least)
        .join(due, "topic").filter(F.col("id") > F.col("last_id")).drop("last_id")
    )


def resume(
    log: DataFrame, consumer: str, topic: str, offsets: DataFrame, page: int | None = PAGE
) -> DataFrame:
    """The same for one consumer, without a join: its offset is a scalar
    subquery, whose value reaches the scan of the log."""
    mine = offsets.filter(F.col("consumer") == consumer).agg(F.max("last_id").alias("m"))
    return event_read(log, topic, F.coalesce(mine.scalar(), F.lit(0)), page)


def ensure_offsets(offsets: DataFrame, consumers: DataFrame) -> DataFrame:
    """Offsets with the absent consumers added at 0."""
    new = consumers.select("consumer").distinct().join(offsets, "consumer", "left_anti")
    return offsets.unionByName(new.withColumn("last_id", F.lit(0).cast("bigint")))


def get_offsets(offsets: DataFrame, consumers: DataFrame) -> DataFrame:
    """Last id of each consumer asked for, 0 when unknown."""
    return consumers.select("consumer").join(offsets, "consumer", "left").select(
        "consumer", F.coalesce("last_id", F.lit(0)).alias("last_id")
    )


def set_offsets(offsets: DataFrame, updates: DataFrame) -> DataFrame:
    """Offsets after an update: unknown consumers are ignored, and an offset
    may move backwards."""
    new = updates.select("consumer", F.col("last_id").alias("_new"))
    return offsets.join(new, "consumer", "left").select(
        "consumer", F.coalesce("_new", "last_id").alias("last_id")
    )
