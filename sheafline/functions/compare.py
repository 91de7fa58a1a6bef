"""Comparison by operator name, held as data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COMPARATORS = ("<=", "<", ">=", ">", "==")


def compare(value: Column, op: Column, target: Column) -> Column:
    """``value op target``; an operator outside the five fails the job."""
    return (
        F.when(op == ">=", value >= target)
        .when(op == "<=", value <= target)
        .when(op == "==", value == target)
        .when(op == ">", value > target)
        .when(op == "<", value < target)
        .otherwise(
            F.raise_error(F.concat(F.lit("Unsupported op: "), F.coalesce(op, F.lit("null")))).cast(
                "boolean"
            )
        )
    )
