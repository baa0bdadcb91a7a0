"""Streams of accesses and documents, folded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import lexical


def access_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Accesses per user and window of a stream(ts, user_id); later rows than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user, ended by a gap without accesses."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("accesses"))


def index_batches(docs: DataFrame, path: str, checkpoint: str):
    """Append the postings of every batch of a stream of documents to a table."""

    def write(batch: DataFrame, number: int) -> None:
        lexical.postings(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
