"""Streaming queries: events as a stream of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import steps as T

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events collected once each through a stream, counted by hour and type through another. (A pattern, as a stream reads no single file.)"""
    return T.run_available(spark, f"{sf_dir}/events.parque[t]", EVENT, "event_id", "event_type").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", F.col("count").alias("n"))


QUERIES = {"streamed_events": streamed_events}
ORACLE_SQL = {"streamed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"}
