"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(
    df: DataFrame, keep: Sequence[str | Column], array: Column, pos: str, value: str
) -> DataFrame:
    """One row per element with its position; empty arrays give none.

    For a plain generator Catalyst adds a size filter below it, which runs a
    costly array expression again; the outer form with a filter does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


def maybe_among(
    df: DataFrame, keys: Sequence[str], members: DataFrame, bits: int = 1 << 24
) -> DataFrame:
    """Rows of ``df`` whose ``keys`` may be among those of ``members``.

    None that is among them is lost; some others pass. The filter is a bitmap
    of ``bits`` bits however many members there are, in rows of 4 KB, so it can
    be broadcast at any scale, and rows without a match go before anything is shuffled.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    bitmap = (
        members.select(bit.alias("_bit"))
        .groupBy(F.expr("bitmap_bucket_number(_bit)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_bit))").alias("_bits"))
    )
    # eight bytes make a number, the first byte its highest one
    eight = lambda i: F.conv(F.hex(F.substring(F.col("_bits"), i * 8 + 1, F.lit(8))), 16, -10)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: eight(i).cast("bigint"))
    bitmap = bitmap.select("_bucket", numbers.alias("_numbers"))
    place = "cast(bitmap_bit_position(_bit) as int)"
    is_set = F.expr(f"getbit(get(_numbers, {place} div 64), 56 - {place} % 64 div 8 * 8 + {place} % 8) = 1")
    return (
        df.withColumn("_bit", bit)
        .withColumn("_bucket", F.expr("bitmap_bucket_number(_bit)"))
        .join(F.broadcast(bitmap), "_bucket")
        .filter(is_set)
        .select(*df.columns)
    )
