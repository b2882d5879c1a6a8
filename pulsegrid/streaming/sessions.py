"""Streaming forms of the engine's windows over samples that arrive (record_id, ts, mv)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_windows(samples: DataFrame, length: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """record_id, start, n, low, high, mean of each page-long window; what comes later than `late` is left out."""
    w = samples.withWatermark("ts", late).groupBy("record_id", F.window("ts", length).alias("w"))
    return w.agg(F.count("mv").alias("n"), F.min("mv").alias("low"), F.max("mv").alias("high"), F.avg("mv").alias("mean")).select("record_id", F.col("w.start").alias("start"), "n", "low", "high", "mean")


def fragments(samples: DataFrame, gap: str = "1 second", late: str = "1 minute") -> DataFrame:
    """record_id, start, end, n of the stretches between gaps in arrival."""
    s = samples.withWatermark("ts", late).groupBy("record_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select("record_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_records(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each record of an arriving result stream once."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["record_id"])


def each_batch(stream: DataFrame, stage, path: str, checkpoint: str):
    """Starts a query that puts every batch through a stage (DataFrame to DataFrame) and appends its rows to a table."""

    def run(batch, number):
        stage(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
