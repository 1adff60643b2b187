"""Streaming over arriving JSON records: sanitize and screen, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unicode_data as U
from ..operators import sanitize


def record_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)


def screened(records: DataFrame) -> DataFrame:
    """Stateless: how many flagged characters a record has, and its text without policy characters."""
    gone, spaced = sanitize.policy_actions()
    return records.select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(f"[{U.flagged_class()}]")), F.lit(0)).alias("n_flagged"),
        F.regexp_replace(F.regexp_replace("text", gone, ""), spaced, " ").alias("cleaned"),
        F.when(F.col("text").isNull(), "no text").alias("error"),
    )


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived and stop; the checkpoint makes a rerun resume."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
