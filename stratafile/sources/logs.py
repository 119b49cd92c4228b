"""Logs of the copy tool as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """log (the file), line and position of every line of a file or folder. Damaged UTF-8 is replaced.

    A long file is split among tasks: positions (file, where its split starts, place within) rise through each file.
    """
    lines = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.make_valid_utf8("value").alias("line"), at.alias("position")).select(F.col("position.log").alias("log"), "line", "position")
