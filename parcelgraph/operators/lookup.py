"""Projection, filter and lookup."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The required properties that can be asked for, by kind (a root's datePublished cannot).
PROJECTABLE = {"descriptor": ("@type", "conformsTo", "about"), "root": ("@type", "name", "description", "license"), "data": ("@type",), "contextual": ("@type",)}
PACKAGE_PROFILE = "https://w3id.org/ro/crate"
METADATA_NAMES = ("ro-crate-metadata.json", "./")


def first_entity(entities: DataFrame, id_: str) -> DataFrame:
    """Of each package the first entity with this id."""
    found = entities.filter(F.col("id") == id_)
    return found.groupBy("crate_id").agg(F.min_by(F.struct(*[c for c in entities.columns if c != "crate_id"]), "pos").alias("e")).select("crate_id", "e.*")


def entity_index(entities: DataFrame, id_: str) -> DataFrame:
    """crate_id, pos of the first entity with this id."""
    return entities.filter(F.col("id") == id_).groupBy("crate_id").agg(F.min("pos").alias("pos"))


def all_ids(entities: DataFrame) -> DataFrame:
    """crate_id, pos, id in order, duplicates kept."""
    return entities.select("crate_id", "pos", "id").orderBy("crate_id", "pos")


def property_keys(properties: DataFrame) -> DataFrame:
    """key: all dynamic keys, also inside objects, once each and in order; required ones are left out."""
    return properties.filter(F.col("origin").isin("dynamic", "nested")).select("key").distinct().orderBy("key")


def entity_property_keys(properties: DataFrame) -> DataFrame:
    """crate_id, pos, id, key: every dynamic key of every entity, also inside objects, as often as it stands there."""
    return properties.filter(F.col("origin").isin("dynamic", "nested")).select("crate_id", "pos", "id", "key")


def _asked_for(entities: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    kinds = [k for k, names in PROJECTABLE.items() if key in names]
    named = properties if "kind" in properties.columns else properties.join(entities.select("crate_id", "pos", "kind"), ["crate_id", "pos"])
    fixed = named.filter((F.col("key") == key) & F.col("origin").isin("fixed", "identity") & (F.col("depth") == 0) & F.col("kind").isin(*kinds or [""]))
    # An entity whose kind has the property as a fixed one never falls back to its dynamic ones.
    dynamic = named.filter((F.col("key") == key) & F.col("origin").isin("dynamic", "nested") & ~F.col("kind").isin(*kinds or [""]))
    return fixed.unionByName(dynamic)


def property_values(entities: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """crate_id, pos, id, tag, json: at most one value of the property per entity, the first by depth-first path.  Properties that have their entity's ``kind`` need no join."""
    found = _asked_for(entities, properties, key)
    return found.groupBy("crate_id", "pos", "id").agg(F.min_by(F.struct("tag", "json"), F.struct("path", "depth")).alias("v")).select("crate_id", "pos", "id", "v.*")


def _plain_tag(value: object) -> str:
    """The tag of a list or object."""
    if isinstance(value, dict):
        return "id" if list(value) == ["@id"] and isinstance(value["@id"], str) else "object"
    kinds = {type(x) for x in value}
    if kinds <= {str}:
        return "strings"
    if kinds <= {int}:
        return "ints"
    return "floats" if kinds <= {int, float} else "array"


def parse_needle(text: str) -> tuple[str, str]:
    """Tag and JSON of a value given as text.

    JSON text is tried first, then the input in quotes, so that anything without
    quotes or backslashes is a string: ``42`` is ``"42"``.  What is left are lists
    and objects with quotes in them, and text that isn't JSON at all.
    """
    for candidate in (text, f'"{text}"'):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, str):
            return "string", json.dumps(value, ensure_ascii=False)
    try:
        value = json.loads(text)
    except ValueError:
        return "string", json.dumps(text, ensure_ascii=False)
    return _plain_tag(value), json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def needle_text(tag: str, text: str) -> str:
    """What a property's ``s`` (of texts) or ``json`` is if it equals a needle."""
    return json.loads(text) if tag == "string" else text


def entities_with_value(properties: DataFrame, needle: str) -> DataFrame:
    """crate_id, pos, id, key: entities with a dynamic value equal to the needle, with the first such key (innermost in nested objects)."""
    tag, text = parse_needle(needle)
    found = properties.filter(F.col("origin").isin("dynamic", "nested") & (F.col("tag") == tag))
    found = found.filter(F.col("s" if tag == "string" else "json") == needle_text(tag, text))
    return found.groupBy("crate_id", "pos", "id").agg(F.min_by("key", "path").alias("key"))


def has_value(properties: DataFrame, needle: str) -> DataFrame:
    """crate_id, id of entities with a top-level dynamic value equal to the needle."""
    return entities_with_value(properties.filter("depth = 0"), needle).select("crate_id", "id").distinct()


def edges(properties: DataFrame) -> DataFrame:
    """crate_id, src, key, dst, origin: links of descriptors (about, conformsTo), roots (license, also as text) and dynamic values at any depth."""
    top, link = F.col("key"), F.col("tag").isin("id", "ids")
    fixed = (F.col("origin") == "fixed") & top.isin("about", "conformsTo", "license")
    # The elements of a list of links are in the list's own row; members of mixed lists have rows of their own.
    rest = F.col("origin").isin("dynamic", "nested", "item", "element") & link
    target = F.when(link, F.col("ids")).when(fixed & (top == "license") & (F.col("tag") == "string"), F.array("s"))
    return properties.filter(fixed | rest).select("crate_id", F.col("id").alias("src"), "key", F.explode(target).alias("dst"), "origin")


def linked_ids(edges_: DataFrame) -> DataFrame:
    """crate_id, src, dst without repetition."""
    return edges_.select("crate_id", "src", "dst").distinct()


def subpackages(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """crate_id, pos, id of data entities that are packages themselves: a top-level conformsTo that is a single link to the package profile, or a mixed list with such a link; lists of links don't count."""
    conforms = properties.filter((F.col("key") == "conformsTo") & (F.col("depth") == 0) & (F.col("origin") == "dynamic"))
    single = conforms.filter(F.col("tag") == "id").filter(F.try_element_at("ids", F.lit(1)).contains(PACKAGE_PROFILE))
    mixed = conforms.filter((F.col("tag") == "array") & F.col("json").contains(f'"@id":"{PACKAGE_PROFILE}'))
    data = entities.filter((F.col("kind") == "data") & ~F.col("id").isin(*METADATA_NAMES))
    return data.join(single.unionByName(mixed).select("crate_id", "pos").distinct(), ["crate_id", "pos"], "left_semi").select("crate_id", "pos", "id")


def subpackage_location(packages_: DataFrame, properties: DataFrame) -> DataFrame:
    """crate_id, id, location: subjectOf, else distribution, else the id itself."""
    def link(key: str) -> DataFrame:
        return properties.filter((F.col("key") == key) & (F.col("depth") == 0) & (F.col("tag") == "id")).select("crate_id", "pos", F.element_at("ids", 1).alias(key))

    found = packages_.join(link("subjectOf"), ["crate_id", "pos"], "left").join(link("distribution"), ["crate_id", "pos"], "left")
    return found.select("crate_id", "id", F.coalesce("subjectOf", "distribution", "id").alias("location"))


def context_names(items: DataFrame) -> DataFrame:
    """crate_id, name: keys of embedded contexts, and references as they are."""
    return items.select("crate_id", F.coalesce("key", "value").alias("name"))


def all_context(items: DataFrame) -> DataFrame:
    """crate_id, pos, value: references as they are, and of embedded contexts the values; their keys where a package has no reference at all."""
    lone = items.groupBy("crate_id").agg((F.count_if(F.col("kind") == "reference") == 0).alias("lone"))
    return items.join(lone, "crate_id").select("crate_id", "pos", F.when(F.col("lone"), F.coalesce("key", "value")).otherwise(F.col("value")).alias("value"))


def holds_id(ids: Column, id_: Column) -> Column:
    """Whether a link or list of links leads to an id."""
    return F.coalesce(F.array_contains(ids, id_), F.lit(False))


def context_value(items: DataFrame, key: str) -> DataFrame:
    """crate_id, value: of the first embedded context that has the key."""
    return items.filter((F.col("kind") == "embedded") & (F.col("key") == key)).groupBy("crate_id").agg(F.min_by("value", "pos").alias("value"))


def urn_uuid(base: Column) -> Column:
    """A base without ``urn:uuid:``; null for other schemes."""
    return F.when(base.startswith("urn:uuid:"), F.substring(base, len("urn:uuid:") + 1, 1 << 20))

