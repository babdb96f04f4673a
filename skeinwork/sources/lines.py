"""Line and record numbers over files that Spark splits, and JSON lines with errors that name file and line.

A large file is read in blocks by several tasks. The first pass counts the lines of each block; sums over a file's blocks say
where each begins, so a line's number is known in whatever task it is read, and no file needs a task of its own. The two
passes read the same files and split them alike; files must not change in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import readers

MODES = ("skip", "report", "fail")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, text): every line, also empty ones, with its number from 1; compressed files are one block."""
    # the row's place in its task goes up along a block, whose rows lie together
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__row"), F.col("value").alias("text"))
    blocks = rows.groupBy("file", "block").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("block")) - F.col("__n")
    starts = blocks.select("file", "block", (before - F.col("__first") + 1).alias("__shift"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("__row") + F.col("__shift")).alias("line"), "text")


def json_lines(spark: SparkSession, paths: str | list[str], mode: str = "report") -> DataFrame:
    """JSON lines, blank ones left out. `skip`: (file, line, record) of the objects, whatever is no JSON being left out. `report`: also
    error, which is null for sound rows. `fail`: as skip, but the first line that is no JSON is an error that names file and line.
    Values that are no objects are left out in every mode."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    text = F.regexp_replace(F.trim("text"), "^﻿", "")
    rows = numbered_lines(spark, paths).withColumn("record", text).where(F.col("record") != "")
    parsed = rows.withColumn("__v", F.try_parse_json("record"))
    object_ = F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT"))
    bad = F.col("__v").isNull()
    if mode == "fail":
        first = parsed.where(bad).orderBy("file", "line").select("file", "line").limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['file']}, line {first[0]['line']}: no JSON")
    if mode == "report":
        return parsed.where(bad | object_).select("file", "line", F.when(~bad, F.col("record")).alias("record"), F.when(bad, "no JSON").alias("error"))
    return parsed.where(~bad & object_).select("file", "line", "record")


def page_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, index, record, count, next): the records of pages that lie in a file each, with their place on the page."""
    pages = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    return readers.page_records(pages)
