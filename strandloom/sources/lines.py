"""Text lines with their number in the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks


def numbered(df: DataFrame, name: str = "ord") -> DataFrame:
    """Placed lines (or what filters leave of them) with a dense record number: files by path, lines in order.

    A task may scan parts of several files in any order, so rows are counted
    for each file part (which one task scans from front to back) and the few
    counts summed up; no row moves.  Frames that are not from files are numbered
    by their partitions.  Both passes have to meet the same rows, which holds
    for files that do not change.
    """
    part = ["_file", "_block"] if "_file" in df.columns else ["_part"]
    rows = df.withColumn("_m", F.monotonically_increasing_id())
    if part == ["_part"]:
        rows = rows.withColumn("_part", F.shiftright("_m", 33))
    counts = rows.groupBy(*part).agg(F.count("*").alias("_n"), F.min("_m").alias("_low"))
    order = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)  # one row a file part
    base = counts.select(*part, "_low", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), part).withColumn(name, F.col("_base") + F.col("_m") - F.col("_low")).drop("_m", "_low", "_base", *part)


def text(spark: SparkSession, path: str | list[str], separator: str | None = None, placed: bool = False, split: int = blocks.SPLIT) -> DataFrame:
    """Lines (or records that end in `separator`) without carriage returns: value.  Compressed files are read as such.

    With `placed` also the file and where the scanned part of it begins, for
    numbered().  Block-gzip files are split, other compressed ones are not.
    """
    paths = [path] if isinstance(path, str) else list(path)
    blocked = [p for p in paths if blocks.is_blocked(spark, p)]
    if blocked:
        plain = [p for p in paths if p not in blocked]
        where = ["_file", "_block"] if placed else []
        rows = [blocks.read_blocked(spark, p, separator or "\n", split).select(F.regexp_replace("value", "\r", "").alias("value"), *where) for p in blocked]
        return reduce(DataFrame.unionByName, rows + ([text(spark, plain, separator, placed)] if plain else []))
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")] if placed else []
    return reader.text(path).select(F.regexp_replace("value", "\r", "").alias("value"), *where)
