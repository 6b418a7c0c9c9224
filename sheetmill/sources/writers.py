"""Sinks: run-partitioned tables, single-file exports and a registry of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Write ``df`` partitioned by run, replacing the runs it holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a heading, for tables meant to be read by people; null is the empty string."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_clustered(df: DataFrame, path: str, lat: str, lon: str, files: int) -> None:
    """Write points sorted along a Morton curve, so that the files' minima and maxima prune box queries."""

    def spread(c: Column) -> Column:
        x = (c * 65535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    code = spread((F.col(lat) + 90) / 180).bitwiseOR(F.shiftleft(spread((F.col(lon) + 180) / 360), 1))
    df.withColumn("__m", code).repartitionByRange(files, "__m").sortWithinPartitions("__m").drop("__m").write.mode("overwrite").parquet(path)


def completed_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys already written in ``path``; none where nothing is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.parquet(path).select(F.col(key).cast("string").alias(key)).distinct()
