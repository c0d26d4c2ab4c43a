"""The value model of packages: every JSON value has a tag.

Tags: string, strings, id, ids, int, float, ints, floats, null, null_bool, array, object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in package metadata.
DESCRIPTOR_ID = "ro-crate-metadata.json"
ROOT_ID = "./"
DATA_TYPES = ("File", "Dataset")


def tag_sql(v: str, shape: str | None = None) -> str:
    """The tag of the VARIANT expression ``v``, as SQL; ``shape`` is its schema where a column has it."""
    t, items = shape or f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'array<variant>')"
    no_null = lambda kind: f"forall(try_variant_get({v}, '$', 'array<{kind}>'), e -> e IS NOT NULL)"
    lone_ids = f"forall(try_variant_get({v}, '$', 'array<struct<`@id`:string>>'), e -> e.`@id` IS NOT NULL)"
    only_ids = f"forall({items}, e -> schema_of_variant(e) LIKE 'OBJECT<%' AND map_contains_key(try_variant_get(e, '$', 'map<string,variant>'), '@id') AND forall(map_values(try_variant_get(e, '$', 'map<string,variant>')), f -> schema_of_variant(f) = 'STRING'))"
    # One look at the schema tells most values, where a filter on the tag works it out anew for each condition.
    common = f"element_at(map('STRING', 'string', 'VOID', 'null', 'BOOLEAN', 'null_bool', 'BIGINT', 'int', 'DECIMAL', 'float', 'DOUBLE', 'float', 'FLOAT', 'float', 'OBJECT<`@id`: STRING>', 'id'), substring_index({t}, '(', 1))"
    # The schema of a list is that of all its members: with @id alone each has no other key, and lacks this one only if it is null or empty.
    return f"""coalesce({common}, CASE
        WHEN {t} LIKE 'OBJECT<%' THEN 'object'
        WHEN {t} = 'ARRAY<OBJECT<`@id`: STRING>>' AND {lone_ids} THEN 'ids'
        WHEN {t} = 'ARRAY<STRING>' AND {no_null('string')} THEN 'strings'
        WHEN {t} = 'ARRAY<VOID>' AND size({items}) = 0 THEN 'strings'
        WHEN {t} = 'ARRAY<BIGINT>' AND {no_null('bigint')} THEN 'ints'
        WHEN ({t} LIKE 'ARRAY<DECIMAL%' OR {t} = 'ARRAY<DOUBLE>') AND {no_null('double')} THEN 'floats'
        WHEN {t} LIKE 'ARRAY<OBJECT<%' AND {only_ids} THEN 'ids'
        ELSE 'array' END)"""


def number_text(x: Column) -> Column:
    """A double in full digits and without a trailing ``.0``: ``1``, ``2.5``, ``1000000000000000000000``."""
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.call_function("format_number", x, F.lit("0." + "#" * 340)))


def json_text_sql(shape: str, text: str) -> str:
    """Compact JSON of a VARIANT with this schema and ``to_json`` text; whole decimals keep their ``.0`` (integers of up to 18 digits have another type, longer ones are decimals without it)."""
    whole = f"{shape} LIKE 'DECIMAL(%' AND NOT contains({text}, '.') AND (NOT {shape} LIKE '%,0)' OR int(substring_index(substr({shape}, 9), ',', 1)) <= 18)"
    return f"CASE WHEN {whole} THEN concat({text}, '.0') ELSE {text} END"


def kind(id_: Column, types: Column) -> Column:
    """descriptor, root, data or contextual."""
    data = F.coalesce(F.arrays_overlap(F.filter(types, lambda x: x.isNotNull()), F.array(*map(F.lit, DATA_TYPES))), F.lit(False))
    return F.when(id_ == DESCRIPTOR_ID, "descriptor").when(id_ == ROOT_ID, "root").when(~id_.startswith("#") & data, "data").otherwise("contextual")


def schema_version(texts: Column) -> Column:
    """The version that an ordered array of context texts names first: 1.1 or 1.2."""
    first = F.filter(texts, lambda x: x.contains("ro/crate/1.1") | x.contains("ro/crate/1.2"))
    return F.when(F.try_element_at(first, F.lit(1)).contains("ro/crate/1.1"), "1.1").when(F.size(first) > 0, "1.2")
