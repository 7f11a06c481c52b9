"""Numbered lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, value)``, lines numbered from 0 in each file.

    Files are read in blocks; a line's place in its block comes with the scan, and the blocks' numbers of lines, a row a
    block, are added up.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = raw.groupBy("path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = Window.partitionBy("path").orderBy("_start")
    before = blocks.select("path", "_start", "_first", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    return raw.join(before, ["path", "_start"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line"), "value")
