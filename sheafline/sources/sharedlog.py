"""An event log with several writers, read from an id on.

An append first claims a range of ids, by publishing the next file in ``claims``; if another writer was
faster it tries the one after. Then it writes its rows, and last publishes its ``commits`` file,
which holds for each data file the topic and the least and greatest id (its zone). Readers see the claims
up to the first that is not committed, so an id never appears behind one that was read already. A
claim whose writer is lost is given up with ``give_up``; its ids stay unused.

A reader from an id on opens only the files whose zones reach beyond it. ``compact`` rewrites the committed
claims' rows into few files in id order and publishes the zones of these instead; the files
before stay for readers that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafline.session import cut
from sheafline.sources import manifest as M
from sheafline.sources.eventlog import LOG_SCHEMA, assign_ids, to_events

#: Rows of a file that ``compact`` writes.
FILE_ROWS = 2_000_000


def _name(n: int) -> str:
    return f"{n:012d}"


def _claim(spark: SparkSession, log: str, rows: int) -> tuple[int, int]:
    """Number of a new claim, and the id before its first."""
    while True:
        names = M.published(spark, f"{log}/claims")
        last = M.content(spark, f"{log}/claims/{names[-1]}")["last"] if names else 0
        number = int(names[-1]) + 1 if names else 0
        if M.publish(spark, f"{log}/claims/{_name(number)}", {"last": last + rows}):
            return number, last


def _zones(spark: SparkSession, path: str) -> list[dict]:
    """File, topic, least and greatest id of each file below ``path``; few rows beside those of the files."""
    rows = spark.read.schema(LOG_SCHEMA).parquet(path).groupBy(
        F.col("_metadata.file_path").alias("file"), "topic"
    )
    found = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows"))
    return [r.asDict() for r in found.collect()]


def append(df: DataFrame, log: str, topic: str | None, order: Sequence[str]) -> tuple[int, int]:
    """Append rows as events; returns the first and last id. Rows get consecutive ids in ``order``.

    May run beside other appends to the same log. If it breaks off, ``give_up`` frees the readers.
    """
    spark = df.sparkSession
    created = F.col("created_at") if "created_at" in df.columns else F.current_timestamp()
    events = assign_ids(to_events(df, topic), order).select(
        "id", "topic", "payload", created.cast("timestamp").alias("created_at")
    )
    events = cut(events)
    rows = events.count()
    number, last = _claim(spark, log, rows)
    path = f"{log}/data/part=claim-{number}"
    placed = events.withColumn("id", F.col("id") + last)
    even = placed if topic is not None else placed.hint("rebalance", "topic")
    even.write.partitionBy("topic").parquet(path)
    zones = _zones(spark, path) if rows else []
    if not M.publish(spark, f"{log}/commits/{_name(number)}", {"files": zones}):
        raise ValueError(f"claim {number} was given up while its rows were written")
    return last + 1, last + rows


def give_up(spark: SparkSession, log: str, number: int) -> bool:
    """Commit a claim without its rows; False if it is committed already."""
    return M.publish(spark, f"{log}/commits/{_name(number)}", {"files": []})


def open_claims(spark: SparkSession, log: str) -> list[int]:
    """Claims without a commit."""
    done = set(M.published(spark, f"{log}/commits"))
    return [int(n) for n in M.published(spark, f"{log}/claims") if n not in done]


def _files(spark: SparkSession, log: str) -> tuple[list[dict], int]:
    """Zones of all files that count, and the first claim that is not committed."""
    compacted = M.published(spark, f"{log}/compactions")
    files, first = [], 0
    if compacted:
        last = M.content(spark, f"{log}/compactions/{compacted[-1]}")
        files, first = last["files"], last["until"]
    done = set(M.published(spark, f"{log}/commits"))
    while _name(first) in done:
        files = files + M.content(spark, f"{log}/commits/{_name(first)}")["files"]
        first += 1
    return files, first


def read(spark: SparkSession, log: str, topic: str | None = None, since_id: int = 0) -> DataFrame:
    """Committed events after ``since_id``, of one topic or all, from the files that can hold any."""
    files, _ = _files(spark, log)
    wanted = [f["file"] for f in files if f["high"] > since_id and topic in (None, f["topic"])]
    if not wanted:
        return spark.createDataFrame([], LOG_SCHEMA)
    rows = spark.read.schema(LOG_SCHEMA).option("basePath", f"{log}/data").parquet(*wanted)
    rows = rows.filter(F.col("id") > since_id).select("id", "payload", "created_at", "topic")
    return rows if topic is None else rows.filter(F.col("topic") == topic)


def compact(spark: SparkSession, log: str, file_rows: int = FILE_ROWS) -> bool:
    """Rewrite what is committed into files of consecutive ids; False if another compaction was faster."""
    files, until = _files(spark, log)
    number = len(M.published(spark, f"{log}/compactions"))
    if not files:
        return False
    parts = max(1, -(-sum(f["rows"] for f in files) // file_rows))
    path = f"{log}/data/part=compaction-{number}-{until}"
    ordered = read(spark, log).repartitionByRange(parts, "id").sortWithinPartitions("topic", "id")
    ordered.write.mode("overwrite").partitionBy("topic").parquet(path)
    return M.publish(spark, f"{log}/compactions/{_name(number)}", {"until": until, "files": _zones(spark, path)})
