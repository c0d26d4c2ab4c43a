"""Flattening to an entity-attribute-value table: uuid, id, key, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.functions.values import number_text
from parcelgraph.operators.lookup import urn_uuid


def eav_frame(crates: DataFrame, context_items: DataFrame, entities: DataFrame, properties: DataFrame, fix_about: bool = False) -> DataFrame:
    """uuid, id, key, value of every package whose base is a urn:uuid.

    A row per context term or reference, entity, type, link, scalar and element of
    a flat list; booleans only where they were read from RDF.  Nested values, nulls and JSON booleans give none.  A descriptor's
    ``about`` stands under ``conformsTo`` unless ``fix_about``.  Tables that have
    their package's ``base`` need no join with the packages.
    """
    tables = (context_items, entities, properties)
    carried = ["base"] if all("base" in t.columns for t in tables) else []
    if carried:
        context_items, entities, properties = (t.filter(urn_uuid(F.col("base")).isNotNull()) for t in tables)
    text = lambda c: c.cast("string")
    context = context_items.select("crate_id", F.lit("@context").alias("id"), F.coalesce("key", F.lit("ro-crate")).alias("key"), F.col("value"), *carried)
    graph = entities.select("crate_id", F.lit("@graph").alias("id"), F.lit("@id").alias("key"), F.col("id").alias("value"), *carried)
    types = entities.select("crate_id", "id", F.lit("@type").alias("key"), F.explode("types").alias("value"), *carried)
    top = properties.filter((F.col("depth") == 0) & F.col("origin").isin("fixed", "dynamic"))
    key = F.col("key") if fix_about else F.when((F.col("origin") == "fixed") & (F.col("key") == "about"), "conformsTo").otherwise(F.col("key"))
    values = (
        F.when(F.col("tag") == "string", F.array("s")).when(F.col("tag") == "int", F.array(text(F.col("i")))).when(F.col("tag") == "float", F.array(number_text(F.col("d"))))
        .when(F.col("tag") == "bool", F.array("json")).when(F.col("tag").isin("id", "ids"), F.col("ids")).when(F.col("tag").isin("strings", "ints", "floats"), F.col("items"))
    )
    rows = top.select("crate_id", "id", key.alias("key"), F.explode(values).alias("value"), *carried)
    every = context.unionByName(graph).unionByName(types).unionByName(rows)
    if carried:
        return every.select(urn_uuid(F.col("base")).alias("uuid"), "id", "key", "value")
    named = crates.select("crate_id", urn_uuid(F.col("base")).alias("uuid")).filter("uuid IS NOT NULL")
    return every.join(named, "crate_id").select("uuid", "id", "key", "value")
