"""Structured Streaming: windowed counts with late data, per-key state, and batches that may be repeated safely."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_events(events: DataFrame, at: str, kind: str, value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, kind, n, total of event-time windows; events later than ``late`` are left out by the watermark when run
    as a stream. The same call serves batches, which see everything."""
    src = events.withWatermark(at, late) if events.isStreaming else events
    return src.groupBy(F.window(at, every), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user, start, stop, n of runs of events with less than ``gap`` between neighbours."""
    src = events.withWatermark(at, late) if events.isStreaming else events
    return src.groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into a Parquet table; a repeated call goes on where the last one ended."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def resume_batches(stream: DataFrame, key: str, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Apply ``work`` to the rows whose key isn't in ``path`` yet, batch by batch. A batch that is run again after a
    failure finds its keys written and adds nothing: each batch also writes under its own number."""

    def batch(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        fresh = df
        if there:
            done = spark.read.parquet(path).filter(F.col("batch") != number).select(key).distinct()
            fresh = df.join(done, key, "left_anti")
        work(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
