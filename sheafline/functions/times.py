"""Zone-less timestamps and instants, both read as UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utc_instant(naive: Column) -> Column:
    """The instant a zone-less timestamp means in UTC (watermarks need one)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp")


def utc_naive(instant: Column) -> Column:
    """The zone-less UTC timestamp of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
