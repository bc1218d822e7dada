"""Delivery deduplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deduplicate_deliveries(stream: DataFrame, id_column: str, time_column: str, delay: str = "10 minutes") -> DataFrame:
    """First row of each delivery id; ids are forgotten once the watermark is ``delay`` past them, so state stays bounded."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([id_column])
