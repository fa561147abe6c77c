"""Captured output of tools: folders of text files of any size, a row a line, numbered within each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import checkpointed


def numbered_lines(spark: SparkSession, folder: str, pattern: str = "*", rolled: bool = False) -> DataFrame:
    """(path, line_no from 1, line) of the text files below a folder whose names match pattern.

    With rolled, the files of one folder are one capture that was rolled over, in the order of their names: its numbers go
    on from file to file. Files are read in splits, each by a task of its own, a line by the split that it begins in. A
    split's lines are counted; the sums of the counts of a file's earlier splits number its lines, so no task reads a whole
    file. Lines end with a line feed; a carriage return before it goes. An empty file has no lines, and neither has what
    follows the last line feed.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n")
    scan = reader.text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r\z", "").alias("line")
    )
    lines = checkpointed(scan)  # a line's place among those of its task is taken once
    splits = lines.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    capture = F.regexp_replace("path", "[^/]*$", "") if rolled else F.col("path")
    before = Window.partitionBy(capture).orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(placed, ["path", "start"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")
