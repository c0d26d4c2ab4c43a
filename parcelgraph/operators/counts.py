"""Group-by-count queries over values at every depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_value_counts(properties: DataFrame, field: str) -> DataFrame:
    """id, value, n: how often each value of ``field`` stands in an object; id is the nearest enclosing object's."""
    members = properties.filter(~F.col("path").endswith("]"))
    return members.filter(F.col("key") == field).groupBy(F.col("owner").alias("id"), F.col("json").alias("value")).agg(F.count("*").alias("n"))


def value_search_counts(properties: DataFrame, value: str) -> DataFrame:
    """id, value, n: where text equal to ``value`` stands.

    A member of an object counts for its object and once more under ``N/A``; an
    array's element counts under ``N/A`` only.
    """
    nowhere = F.lit("N/A")
    equal = properties.filter(F.col("s") == value)
    members = equal.filter(~F.col("path").endswith("]")).select(F.explode(F.array("owner", nowhere)).alias("id"))
    items = equal.filter(F.col("path").endswith("]")).select(nowhere.alias("id"))
    texts = properties.filter(F.col("tag") == "strings").select(F.explode("items").alias("item")).filter(F.col("item") == value).select(nowhere.alias("id"))
    found = members.unionByName(items).unionByName(texts)
    return found.groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(value).alias("value"), "n")
