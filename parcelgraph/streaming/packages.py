"""Package documents as a stream: each new file's entities, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelgraph.plans.tables import Packages
from parcelgraph.sources.packages import parse


def watch(spark: SparkSession, folder: str, handle: Callable[[Packages], None], checkpoint: str) -> StreamingQuery:
    """Parses the files that appear in ``folder``, a micro-batch at a time, and hands their tables to ``handle``.

    Files seen are kept in ``checkpoint``, so a restarted query goes on where it was.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    texts = files.select(F.col("_metadata.file_path").alias("crate_id"), F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))

    def batch(rows: DataFrame, _: int) -> None:
        handle(parse(rows))

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
