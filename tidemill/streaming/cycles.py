"""Polled cycles as Structured Streaming micro-batches.

Each function takes a streaming or a batch DataFrame, so the same plan can be
held against a bounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import ledger


def failed_logins(events: DataFrame, window: str = "15 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Failures of each user in sliding windows of event time; state older than the
    watermark is dropped by Spark."""
    failed = events.filter("event_type = 'error'").withWatermark("ts", late)
    counted = failed.groupBy(F.window("ts", window, slide).alias("w"), "user_id").agg(F.count("*").alias("failures"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "failures")


def sent_once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: what was sent isn't sent again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_into(path: str, keys: list[str], keep: tuple[str, ...] = ()):
    """For foreachBatch: merges a micro-batch into a table of versions under path.

    A version is written whole beside the last one and read by its number, so a
    batch that is run again overwrites its own version and nothing is half done.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = ledger.keep_last(batch, keys, F.desc("ts"), F.desc("event_id"))
        if number:
            new = ledger.upsert(spark.read.parquet(f"{path}/v{number - 1}"), new, keys, keep)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge
