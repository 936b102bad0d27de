"""Queries that run as streams over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.events import drain, read_events, windowed_counts


def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and day, counted as a stream."""
    return drain(windowed_counts(read_events(spark, f"{folder}/events.parquet")))


QUERIES = {"stream_event_counts": stream_event_counts}
SQL = {"stream_event_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL"}
