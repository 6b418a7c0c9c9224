"""Streams over the events table, run to completion, and their batch results as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder, table
from ..streaming import incremental as I


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def q_windowed_events(spark: SparkSession, d: str) -> DataFrame:
    out = I.windowed_events(table(spark, d, "events"), "ts", "event_type", "value", "6 hours")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    return I.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours").select("user_id", "start", "n")


def q_stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Each event processed once through resumed micro-batches."""
    at = _folder(spark)
    double = lambda df: df.select("event_id", "event_type", F.round(F.col("value") * 2, 4).alias("twice"))
    for _ in range(2):  # the second run finds everything done
        I.resume_batches(_stream(spark, d), "event_id", f"{at}/out", f"{at}/checkpoint", double)
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type", "twice")


def q_stream_table(spark: SparkSession, d: str) -> DataFrame:
    """Streamed selection into a table, then aggregated."""
    at = _folder(spark)
    I.run_to_table(_stream(spark, d).filter("value > 10").select("event_id", "event_type", "value"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
SQL = {
    "windowed_events": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS, true)::int AS o FROM events)) GROUP BY user_id, s",
    "stream_resume": "SELECT event_id, event_type, round(value * 2, 4) AS twice FROM events",
    "stream_table": "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1",
}
