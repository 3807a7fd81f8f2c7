"""Text lines with their numbers, wherever Spark cuts the files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, group: Column | None = None) -> DataFrame:
    """value, file, group (of columns ``file`` and ``block``, worked out once a block; default: the file) and line: the line's number, from 1, within its group's
    files in the order of their paths.

    Within a block of a file the scan's row ids are consecutive, so a number is the row id less the block's first, plus the lines
    of all blocks before it.  The blocks are counted in a scan of their own, which brings one row per block; the text
    isn't shuffled."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    blocks = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("group", F.col("file") if group is None else group)
    before = Window.partitionBy("group").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).select("file", "block", "group", "start")
    return raw.join(blocks, ["file", "block"]).select("value", "file", "group", (F.col("row") + F.col("start")).alias("line"))
