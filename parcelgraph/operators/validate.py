"""Validation: unknown keys and links to nowhere."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.functions.links import is_not_url
from parcelgraph.operators.lookup import context_names, edges
from parcelgraph.plans.storage import grown


class NotValid(ValueError):
    """A package that doesn't pass validation."""


def vocabulary(spark: SparkSession, contexts: dict[str, str]) -> DataFrame:
    """version, term, iri from the vocabularies' JSON-LD files, {version: path}."""
    rows = []
    for version, path in contexts.items():
        with open(path, encoding="utf-8") as f:
            terms = json.load(f)["@context"]
        rows += [(version, k, v if isinstance(v, str) else v.get("@id")) for k, v in terms.items()]
    return spark.createDataFrame(rows, "version string, term string, iri string")


def dangling_ids(entities: DataFrame, edges_: DataFrame) -> DataFrame:
    """crate_id, dst: local links to ids that the package doesn't have."""
    local = edges_.filter(is_not_url(F.col("dst"))).select("crate_id", "dst").distinct()
    return local.join(grown(entities.select("crate_id", F.col("id").alias("dst"))), ["crate_id", "dst"], "left_anti")


def unknown_keys(crates: DataFrame, properties: DataFrame, context_items: DataFrame, terms: DataFrame) -> DataFrame:
    """crate_id, key: dynamic keys, nested ones too, that neither the version's vocabulary nor the package's own context has."""
    keys = properties.filter(F.col("origin").isin("dynamic", "nested")).select("crate_id", "key").distinct()
    keys = keys.join(grown(crates.select("crate_id", "schema_version")), "crate_id")
    known = terms.select(F.col("version").alias("schema_version"), F.col("term").alias("key")).distinct()
    own = context_names(context_items).withColumnRenamed("name", "key")
    return keys.join(known, ["schema_version", "key"], "left_anti").join(grown(own), ["crate_id", "key"], "left_anti").select("crate_id", "key")


def validation_report(crates: DataFrame, entities: DataFrame, properties: DataFrame, context_items: DataFrame, terms: DataFrame) -> DataFrame:
    """crate_id, status (valid, invalid; error: no version), invalid_keys, invalid_ids, invalid_types (always empty)."""
    listed = lambda df, c, name: df.groupBy("crate_id").agg(F.sort_array(F.collect_set(c)).alias(name))
    keys = listed(unknown_keys(crates, properties, context_items, terms), "key", "invalid_keys")
    ids = listed(dangling_ids(entities, edges(properties)), "dst", "invalid_ids")
    none = F.array().cast("array<string>")
    out = crates.select("crate_id", "schema_version").join(grown(keys), "crate_id", "left").join(grown(ids), "crate_id", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("invalid_keys", "invalid_ids")})
    status = F.when(F.col("schema_version").isNull(), "error").when((F.size("invalid_keys") == 0) & (F.size("invalid_ids") == 0), "valid").otherwise("invalid")
    return out.select("crate_id", status.alias("status"), "invalid_keys", "invalid_ids", none.alias("invalid_types"))


def enforce(report: DataFrame, level: int) -> DataFrame:
    """Level 0 doesn't look at the report, 1 returns it, any other raises if a package isn't valid."""
    if level not in (0, 1):
        bad = report.filter("status != 'valid'").limit(1).collect()
        if bad:
            raise NotValid(f"{bad[0]['crate_id']}: keys {bad[0]['invalid_keys']}, ids {bad[0]['invalid_ids']}")
    return report
