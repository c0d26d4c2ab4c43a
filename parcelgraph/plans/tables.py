"""The tables that hold packages, all keyed by ``crate_id``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

CRATES = "crate_id string, source string, schema_version string, base string"
CONTEXT_ITEMS = "crate_id string, pos int, kind string, key string, value string"
ENTITIES = "crate_id string, pos int, id string, kind string, types array<string>, types_is_array boolean"
PROPERTIES = "crate_id string, pos int, id string, key string, path string, depth int, origin string, owner string, tag string, s string, i bigint, d double, ids array<string>, items array<string>, json string"
EDGES = "crate_id string, src string, key string, dst string, origin string"
TRIPLES = "crate_id string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string"


@dataclass(frozen=True)
class Packages:
    """Packages as DataFrames; every operation gives a new one."""

    crates: DataFrame
    context_items: DataFrame
    entities: DataFrame
    properties: DataFrame | None
    rejects: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> Packages:
        return replace(self, **tables)
