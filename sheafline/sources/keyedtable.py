"""A stored table that is kept current by key, without rewriting what does not change.

Rows lie in buckets by the hash of their key. A version is a published file that names the folder of each
bucket. An update reads the buckets that its keys fall into, writes these anew, and publishes the
next version, which takes all other folders over from the one before; readers see either
version whole. If another writer publishes first, the update is made again on its version. What is
written before a crash belongs to no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sheafline.operators.tables import upsert_by_pk
from sheafline.session import cut
from sheafline.sources import manifest as M

BUCKETS = 256
_B = "_bucket"


def _name(n: int) -> str:
    return f"{n:012d}"


def bucket_of(pk: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*pk), F.lit(buckets)).cast("int")


def version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the current version; -1 before the first."""
    names = M.published(spark, f"{path}/versions")
    return (int(names[-1]), M.content(spark, f"{path}/versions/{names[-1]}")) if names else (-1, {})


def _read(spark: SparkSession, path: str, of: dict, buckets: Sequence[str]) -> DataFrame:
    folders = [f"{path}/data/{of['buckets'][b]}/{_B}={b}" for b in buckets if b in of["buckets"]]
    schema = StructType.fromJson(of["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now."""
    number, of = version(spark, path)
    if number < 0:
        raise ValueError(f"there is no table at {path}")
    return _read(spark, path, of, list(of["buckets"]))


def update(
    rows: DataFrame,
    path: str,
    pk: Sequence[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
) -> int:
    """Merge ``rows`` into the table and return the number of the current version.

    ``merge`` gets what the table holds in the buckets of the rows, and the rows; what it returns takes
    their place. It must depend on a key's own rows only. The first update fixes the columns
    and the number of buckets. ``batch`` (name of a source, number) makes an update count once: one that the
    table has seen, or an earlier one of the same source, is passed over.
    """
    spark, rows = rows.sparkSession, cut(rows)
    while True:
        number, of = version(spark, path)
        of = of or {"count": buckets, "buckets": {}, "schema": rows.schema.jsonValue(), "batches": {}}
        if batch is not None and of["batches"].get(batch[0], -1) >= batch[1]:
            return number
        bucket = bucket_of(pk, of["count"])
        # at most as many rows as buckets
        met = {str(r[0]) for r in rows.select(bucket).distinct().collect()}
        new = merge(_read(spark, path, of, sorted(met)), rows).select(*rows.columns)
        folder = uuid.uuid4().hex
        if met:
            new.withColumn(_B, bucket).hint("rebalance", _B).write.partitionBy(_B).parquet(f"{path}/data/{folder}")
        kept = {b: f for b, f in of["buckets"].items() if b not in met}
        made = of | {"buckets": kept | dict.fromkeys(met, folder)}
        if batch is not None:
            made["batches"] = of["batches"] | {batch[0]: batch[1]}
        if M.publish(spark, f"{path}/versions/{_name(number + 1)}", made):
            return number + 1


def upsert(
    rows: DataFrame, path: str, pk: Sequence[str], recency: Sequence[Column], buckets: int = BUCKETS
) -> int:
    """``upsert_by_pk`` into the stored table: one row per key, the first by ``recency``."""
    return update(rows, path, pk, lambda held, new: upsert_by_pk(held, new, pk, recency), buckets)


def add_up(
    rows: DataFrame,
    path: str,
    by: Sequence[str],
    sums: Sequence[str],
    buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
) -> int:
    """Add the columns ``sums`` to those the table holds for the same key ``by``."""

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in new.schema}
        both = held.unionByName(new)
        return both.groupBy(*by).agg(*(F.sum(c).cast(kinds[c]).alias(c) for c in sums))

    return update(rows.select(*by, *sums), path, by, merge, buckets, batch)
