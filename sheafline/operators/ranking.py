"""First rows per key, written so that one hot key cannot fill a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Spark trims each map partition to the first n rows per key before the
# shuffle, for n up to spark.sql.optimizer.windowGroupLimitThreshold (1000).
# What is left of a hot key is n rows per map task; from this n on, a salted
# pass folds those first.
SALT_FROM = 500
SALTS = 64


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    The map side already drops most of a hot key. For larger ``n`` the same
    rule runs first on salted keys, which leaves n x 64 rows per key; the salt
    cannot change the answer, only where the first pass runs.
    """
    if n > SALT_FROM:
        salted = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.spark_partition_id() % SALTS)
            .withColumn("_rn", F.row_number().over(salted))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def dedupe_keep_first(
    df: DataFrame, keys: Sequence[str] | str, order: Sequence[str | Column] | str
) -> DataFrame:
    """One row per key, the first in ``order``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return first_n(df, keys, cols, 1)
