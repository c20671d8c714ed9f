"""Descriptions of event sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EventSource:
    """A source, the event types it sends and the expected gap between two of them."""

    name: str
    event_types: Sequence[str]
    est_interval_ms: int


def source_table(spark: SparkSession, sources: Sequence[EventSource]) -> DataFrame:
    """(source, event_type, est_interval_ms), one row per type."""
    rows = [(s.name, t, s.est_interval_ms) for s in sources for t in s.event_types]
    return spark.createDataFrame(rows, "source string, event_type string, est_interval_ms long")
