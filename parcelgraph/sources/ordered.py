"""Files read in pieces by many tasks, with the pieces' order and sums over what lies before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pieces(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """crate_id (the file's path), size, block, n, piece: the lines of text files, or what lies between ``separator``; large files are read by a task a block."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("crate_id"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("piece"))


def with_sums_before(rows: DataFrame, order: tuple[str, ...] = ("n",), **values: Column) -> DataFrame:
    """Adds to each row the sums of ``values`` over all rows of its file before it.

    Blocks are summed up first, and numbered by what precedes them; no task sees
    more than a block, and none but a row for each block of a file.
    """
    home = ["crate_id", "block"]
    sums = rows.groupBy(*home).agg(*(F.sum(v).alias(f"_{k}") for k, v in values.items()))
    blocks = Window.partitionBy("crate_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*home, *(F.coalesce(F.sum(f"_{k}").over(blocks), F.lit(0)).alias(f"_{k}") for k in values))
    inside = Window.partitionBy(*home).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(before, home).withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    return found.drop(*(f"_{k}" for k in values))
