"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parcelgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Whether VARIANT columns are written a column for each of their keys.  Documents are read as wholes, and putting them together again takes several times as long as reading them.
_SHREDDING = "spark.sql.variant.writeShredding.enabled"


def written_path(df: DataFrame, compression: str = "snappy") -> str:
    """Writes the rows to a new folder, VARIANT columns as wholes."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    before = spark.conf.get(_SHREDDING, None)
    spark.conf.set(_SHREDDING, "false")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_SHREDDING) if before is None else spark.conf.set(_SHREDDING, before)
    return path


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder, which cuts the lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, compression))


def tasks(spark: SparkSession) -> int:
    """How many tasks take part in steps that take far longer than their rows' bytes let Spark expect."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks, for such steps."""
    return df.repartition(tasks(df.sparkSession))


def grown(df: DataFrame) -> DataFrame:
    """A side of a join whose rows grow with the packages, so that it is shuffled and sorted.

    Spark expects far fewer bytes of it than there are: files are compressed, and a list's
    rows count as one.  By that it would gather them on the driver to broadcast them.
    """
    return df.hint("merge")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has at most ``rows`` rows, by a count; a shuffled join otherwise."""
    return F.broadcast(df) if df.count() <= rows else df
