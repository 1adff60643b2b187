"""File and record sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

EXTENSIONS = (".txt", ".md", ".py", ".js", ".ts", ".json", ".csv", ".html", ".xml", ".yaml", ".yml", ".toml")


def text_files(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = (), most_bytes: int = 2_000_000
) -> DataFrame:
    """Text files below a folder: path, text, error.

    A file over the limit, or one that is not UTF-8, is a row with an error and
    without text; the contents of files over the limit are never read.
    """
    fields = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.read.format("binaryFile").schema(fields).option("recursiveFileLookup", True).load(root)
    wanted = raw.where(scan.selected(F.col("path"), extensions, list(exclude)))
    large = wanted.where(F.col("length") > most_bytes).select(
        "path", F.lit(None).cast("string").alias("text"), F.lit("over the size limit").alias("error")
    )
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    read = wanted.where(F.col("length") <= most_bytes).select(
        "path", F.when(valid, text).alias("text"), F.when(~valid, "not valid UTF-8").alias("error")
    )
    return read.unionByName(large)


def write_texts(texts: DataFrame, folder: str, bucket: str, order: str) -> None:
    """texts(bucket, order, text) as files, one for each bucket, its texts in order with a newline behind each.

    A bucket's rows pass through one writer, so buckets should be of bounded size.
    """
    rows = texts.repartition(bucket).sortWithinPartitions(bucket, order)
    rows.select(bucket, "text").write.partitionBy(bucket).text(folder)


def json_lines(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """JSON records; a bad line keeps its neighbours and is returned with ``error``."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("error", F.when(F.col("_corrupt_record").isNotNull(), "bad record")).drop("_corrupt_record")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)
