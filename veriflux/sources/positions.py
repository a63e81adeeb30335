"""Rows of files by their places: dense numbers that no partitioning changes, and tables paired row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch


def positioned(rows: DataFrame, name: str = "position", start: int = 0) -> DataFrame:
    """The rows of a file scan, numbered from `start` in the order of their files' paths and of their places there.

    rows must come straight from a reader, before any row is dropped. A task
    numbers the rows of each block it reads as they come; blocks have counts, and
    counts add up to offsets, first within each file, then over one row for each
    file. So there is no sort of rows, and no task numbers more than its blocks.
    """
    seen = rows.select("*", F.col("_metadata.file_path").alias("path__"), F.col("_metadata.file_block_start").alias("block__")).withColumn("seq__", F.monotonically_increasing_id())
    seen = Scratch(rows.sparkSession, "positions").save(seen, "seen")  # numbers of one reading, whatever later plans look like
    blocks = seen.groupBy("path__", "block__").agg(F.count("*").alias("n__"), F.min("seq__").alias("low__"))
    in_file = W.partitionBy("path__").orderBy("block__").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before__", F.coalesce(F.sum("n__").over(in_file), F.lit(0)))
    files = blocks.groupBy("path__").agg(F.sum("n__").alias("n__"))
    earlier = W.orderBy(F.split("path__", "/")).rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    files = files.select("path__", F.coalesce(F.sum("n__").over(earlier), F.lit(0)).alias("files__"))
    offsets = blocks.join(files, "path__").select("path__", "block__", (F.col("files__") + F.col("before__") - F.col("low__") + start).alias("offset__"))
    return seen.join(offsets, ["path__", "block__"]).select(*rows.columns, (F.col("seq__") + F.col("offset__")).alias(name))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th row of one file scan beside the n-th of another, with `position`; scans of different length are an error."""
    a, b = positioned(left), positioned(right)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be paired with {m}")
    return a.join(b, "position")
