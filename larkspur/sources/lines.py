"""Lines of text files with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, folder or pattern, in the order of their names."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(pattern) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if s.isFile() and not s.getPath().getName().startswith(("_", ".")):
                found.append(s.getPath().toString())
    return sorted(found)


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """line_no (from 1, blank lines included) and line; limit: physical lines. Of several files the lines are numbered
    through, in the order of the files' names.

    Each split's rows are numbered where they are read; the driver adds up the splits' counts, one number each.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("slot"))
    splits = sorted(raw.groupBy("file", "block").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    shifts, total = [], 0
    for s in splits:
        shifts.append((s["file"], s["block"], total + 1 - s["first"]))
        total += s["n"]
    if not shifts:
        return spark.createDataFrame([], "line_no long, line string")
    known = F.broadcast(spark.createDataFrame(shifts, "f string, b long, shift long"))  # a row for each split
    rows = raw.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select((F.col("slot") + F.col("shift")).alias("line_no"), F.col("value").alias("line"))
    return rows if limit is None else rows.where(F.col("line_no") <= limit)
