"""Exact repeats of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheafline.functions.text import normalize_text


def content_groups(df: DataFrame, text: str, order: str) -> DataFrame:
    """(content_hash, first id, copies). Only hashes and ids are shuffled, and
    the map side already folds copies together."""
    hashed = df.select(F.sha2(normalize_text(F.col(text)), 256).alias("content_hash"), order)
    return hashed.groupBy("content_hash").agg(
        F.min(order).alias(order), F.count("*").alias("copies")
    )


def dedupe_exact(df: DataFrame, text: str, order: str) -> DataFrame:
    """Rows whose normalised text was not seen at a smaller ``order`` value.

    ``order`` is unique, so the join back is on an even key however many
    copies one text has.
    """
    return df.join(content_groups(df, text, order).select(order), order, "left_semi")
