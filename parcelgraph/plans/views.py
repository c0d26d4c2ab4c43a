"""Packages over the relational test tables.

Each row of a dimension is an entity of one package, ``shop``; each order is also
a package of its own whose parts are its line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.plans.tables import PROPERTIES

SHOP = "shop"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"#{kind}-"), F.col(key).cast("string"))


#: Per table: its name for ids, its key, the type of its entities, its text and number columns, and its links (property, kind, column).
SHAPES = {
    "region": ("region", "r_regionkey", "Place", ["r_name"], [], []),
    "nation": ("nation", "n_nationkey", "Place", ["n_name"], [], [("containedInPlace", "region", "n_regionkey")]),
    "customer": ("customer", "c_custkey", "Person", ["c_name", "c_mktsegment"], ["c_acctbal"], [("nationality", "nation", "c_nationkey")]),
    "orders": ("order", "o_orderkey", "Order", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], [("customer", "customer", "o_custkey")]),
}


def entities(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """crate_id, pos, id, kind, types, types_is_array; positions are the tables' keys."""
    out = None
    for name in names:
        kind, key, type_, *_ = SHAPES[name]
        rows = table(spark, sf_dir, name).select(F.lit(SHOP).alias("crate_id"), F.col(key).cast("int").alias("pos"), entity_id(kind, key).alias("id"), F.lit("contextual").alias("kind"), F.array(F.lit(type_)).alias("types"), F.lit(False).alias("types_is_array"))
        out = rows if out is None else out.unionByName(rows)
    return out


def properties(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The property table of the same entities: a row per column and link."""
    fields = [f.strip().split(" ", 1) for f in PROPERTIES.split(",")]
    out = None
    for name in names:
        kind, key, _, texts, numbers, links = SHAPES[name]

        def value(tag: str, name: str, **given: Column) -> Column:
            row = {"key": F.lit(name), "path": F.lit(name), "depth": F.lit(0), "origin": F.lit("dynamic"), "tag": F.lit(tag)} | given
            return F.struct(*(row.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields if f not in ("crate_id", "pos", "id", "owner")))

        values = [value("string", c, s=F.col(c), json=F.concat(F.lit('"'), F.col(c), F.lit('"'))) for c in texts]
        values += [value("float", c, d=F.col(c), json=F.col(c).cast("string")) for c in numbers]
        values += [value("id", p, ids=F.array(entity_id(k, c)), json=F.concat(F.lit('{"@id":"'), entity_id(k, c), F.lit('"}'))) for p, k, c in links]
        rows = table(spark, sf_dir, name).select(F.lit(SHOP).alias("crate_id"), F.col(key).cast("int").alias("pos"), entity_id(kind, key).alias("id"), F.explode(F.array(*values)).alias("v"))
        rows = rows.select("crate_id", "pos", "id", "v.*").withColumn("owner", F.col("id")).select(*(f for f, _ in fields))
        out = rows if out is None else out.unionByName(rows)
    return out


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crate_id (an order), src ``./``, key ``hasPart``, dst (a line item)."""
    line = F.concat(entity_id("line", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select(entity_id("order", "l_orderkey").alias("crate_id"), F.lit("./").alias("src"), F.lit("hasPart").alias("key"), line.alias("dst"), F.lit("dynamic").alias("origin"))


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crate_id, pos, id, kind, doc: each event's JSON as the dynamic values of one entity."""
    return table(spark, sf_dir, "events").select(F.lit("events").alias("crate_id"), F.col("event_id").cast("int").alias("pos"), entity_id("event", "event_id").alias("id"), F.lit("contextual").alias("kind"), F.try_parse_json("props").alias("doc"))
