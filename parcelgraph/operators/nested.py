"""Packages that lie in packages: found, fetched and parsed, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.operators.lookup import subpackage_location, subpackages
from parcelgraph.plans.storage import written
from parcelgraph.plans.tables import Packages
from parcelgraph.sources.packages import parse
from parcelgraph.sources.remote import Transport, resolve_all


def locations(packages: Packages) -> DataFrame:
    """crate_id, id, location of the packages right below."""
    return subpackage_location(subpackages(packages.entities, packages.properties), packages.properties)


def fetch_level(packages: Packages, transport: Transport, root: str | None = None, seen: DataFrame | None = None) -> tuple[Packages, DataFrame]:
    """The packages right below, and url, found, reason of every place that was asked: each once, and none of ``seen`` (url).  Places without a package are passed over, and say why."""
    urls = locations(packages).select(F.col("location").alias("url")).distinct()
    if seen is not None:
        urls = urls.join(seen.select("url"), "url", "left_anti")
    texts = written(resolve_all(urls.repartition("url"), transport, root))
    return parse(texts.filter("text IS NOT NULL")), texts.select(F.col("crate_id").alias("url"), F.col("text").isNotNull().alias("found"), "reason")


def fetch_nested(packages: Packages, transport: Transport, root: str | None = None) -> tuple[Packages, DataFrame]:
    """All packages below, at every depth, and url, found, reason, depth of every place that was asked.

    A place is asked once, however many packages name it, so cycles end.
    """
    level, depth, all_levels, asked = packages, 0, [], None
    while True:
        depth += 1
        level, now = fetch_level(level, transport, root, asked)
        now = written(now.withColumn("depth", F.lit(depth)))
        asked = now if asked is None else asked.unionByName(now)
        if now.isEmpty():
            break
        all_levels.append(level)
    if not all_levels:
        all_levels = [level]
    union = lambda name: reduce(DataFrame.unionByName, (getattr(x, name) for x in all_levels))
    return Packages(*(union(n) for n in ("crates", "context_items", "entities", "properties", "rejects"))), asked
