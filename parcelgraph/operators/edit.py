"""Edits of packages.  Tables don't change; every edit gives new ones, for all packages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.functions.links import is_not_url
from parcelgraph.plans.storage import grown


def upsert(entities: DataFrame, new: DataFrame, same_kind: bool = False) -> DataFrame:
    """Replaces the first entity with each new one's id, or appends it at its package's end.

    ``new`` has the columns of ``entities`` but ``pos``; with ``same_kind`` an entity
    of another kind isn't replaced and the new one is dropped.
    """
    first = entities.groupBy("crate_id", "id").agg(F.min("pos").alias("first"), F.min_by("kind", "pos").alias("old_kind"))
    last = entities.groupBy("crate_id").agg(F.max("pos").alias("last"))
    placed = new.join(first, ["crate_id", "id"], "left").join(last, "crate_id", "left")
    if same_kind:
        placed = placed.filter("old_kind IS NULL OR old_kind = kind")
    nth = F.row_number().over(Window.partitionBy("crate_id", F.col("first").isNull()).orderBy("id"))  # rows of one edit
    placed = placed.withColumn("pos", F.coalesce("first", F.coalesce("last", F.lit(-1)) + nth).cast("int")).select(*entities.columns)
    kept = entities.join(placed.select("crate_id", "pos"), ["crate_id", "pos"], "left_anti")
    return kept.unionByName(placed)


def remove(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """All entities but those with an id in ``gone`` (crate_id, id)."""
    return entities.join(gone.select("crate_id", "id"), ["crate_id", "id"], "left_anti")


def remove_links(properties: DataFrame, gone: DataFrame) -> DataFrame:
    """Top-level dynamic values without the ids in ``gone`` (crate_id, id).

    A text or single link that equals one goes with its key; lists of links lose
    their members and may become empty.  Nested values, required properties and
    links of links stay.
    """
    key = ["crate_id", "pos", "path"]
    top = (F.col("depth") == 0) & (F.col("origin") == "dynamic") & F.col("tag").isin("string", "id", "ids")
    named = properties.filter(top).select(*key, F.explode(F.when(F.col("tag") == "string", F.array("s")).otherwise(F.col("ids"))).alias("id"))
    hit = named.join(gone.select("crate_id", "id").distinct(), ["crate_id", "id"], "left_semi").groupBy(*key).agg(F.collect_set("id").alias("hit"))  # no more than one property names
    rows = properties.join(hit, key, "left").filter(F.col("hit").isNull() | (F.col("tag") == "ids"))
    return rows.withColumn("ids", F.when(F.col("hit").isNull(), F.col("ids")).otherwise(F.filter("ids", lambda x: ~F.array_contains("hit", x)))).select(*properties.columns)


def rename(entities: DataFrame, properties: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames entities and top-level dynamic links by ``names`` (crate_id, old, new); required properties and nested links stay.

    Each package has names of its own.  Many renames are one join, not a scan each.
    """
    names = names.select(F.col("crate_id").alias("of"), F.col("old").alias("old_id"), F.col("new").alias("new_id")).dropDuplicates(["of", "old_id"])
    same = lambda c: (F.col("crate_id") == F.col("of")) & (F.col(c) == F.col("old_id"))
    renamed = entities.join(names, same("id"), "left").withColumn("id", F.coalesce("new_id", "id")).select(*entities.columns)
    rows = properties.join(names, same("id"), "left").withColumn("id", F.coalesce("new_id", "id")).select(*properties.columns)
    linked = (F.col("depth") == 0) & (F.col("origin") == "dynamic") & F.col("tag").isin("id", "ids")
    key = ["crate_id", "pos", "path"]
    targets = rows.filter(linked).select(*key, F.explode(F.array_distinct("ids")).alias("target")).join(names, same("target"))
    targets = targets.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("target", "new_id"))).alias("moved"))  # only properties that name a renamed one
    ids = F.when(F.col("moved").isNull(), F.col("ids")).otherwise(F.transform("ids", lambda x: F.coalesce(F.try_element_at("moved", x), x)))
    rows = rows.join(targets, key, "left").withColumn("ids", ids).select(*properties.columns)
    return renamed, rows


def set_property(entities: DataFrame, properties: DataFrame, new: DataFrame) -> DataFrame:
    """Sets top-level properties of the first entity with each id: ``new`` has the columns of ``properties`` but ``pos``, a row per key."""
    first = entities.groupBy("crate_id", "id").agg(F.min("pos").cast("int").alias("pos"))
    return _replaced(properties, new.join(grown(first), ["crate_id", "id"]).select(*properties.columns))


def _replaced(properties: DataFrame, placed: DataFrame) -> DataFrame:
    """Properties with top-level ones in the place of all that their entities have of the same key."""
    old = placed.select("crate_id", "pos", F.col("key").alias("root"))
    root = F.regexp_extract("path", r"^([^/\[]+)", 1)
    return properties.withColumn("root", root).join(grown(old), ["crate_id", "pos", "root"], "left_anti").select(*properties.columns).unionByName(placed)


def remove_property(entities: DataFrame, properties: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes the dynamic ``key`` of the first entity with each id of ``gone`` (crate_id, id, key), with all below it."""
    first = entities.groupBy("crate_id", "id").agg(F.min("pos").alias("pos"))
    gone = gone.join(grown(first), ["crate_id", "id"]).select("crate_id", "pos", F.col("key").alias("root"))
    rows = properties.withColumn("root", F.when(F.col("origin").isin("fixed", "identity"), F.lit(None).cast("string")).otherwise(F.regexp_extract("path", r"^([^/\[]+)", 1)))
    return rows.join(grown(gone), ["crate_id", "pos", "root"], "left_anti").select(*properties.columns)


def add_type(types: Column, is_array: Column, name: str) -> tuple[Column, Column]:
    """Types with one more, and whether they are a list on the wire."""
    return F.concat(types, F.array(F.lit(name))), F.lit(True)


def remove_type(types: Column, name: str) -> Column:
    """Types without the first ``name``; null, an error, if it is absent or the only one."""
    at = F.array_position(types, name).cast("int")
    rest = F.concat(F.slice(types, 1, F.greatest(at - 1, F.lit(0))), F.slice(types, at + 1, F.size(types)))
    return F.when((at > 0) & (F.size(types) > 1), rest)


def add_part(parts: Column, is_list: Column, id_: Column) -> Column:
    """``hasPart`` with one more link: appended to a list that lacks it; anything else is replaced by a list of this one."""
    return F.when(is_list, F.when(F.array_contains(parts, id_), parts).otherwise(F.concat(parts, F.array(id_)))).otherwise(F.array(id_))


def add_parts(entities: DataFrame, properties: DataFrame, new: DataFrame) -> DataFrame:
    """Gives the root with the id of ``new`` (crate_id, id, part) more parts, in the order of their ids; ids of other entities change nothing.

    Parts of one root are added as one after another would be: a list grows by those
    that it lacks, and anything else is replaced by a list of them.  A root's parts
    are one value of one row.
    """
    roots = entities.filter("kind = 'root'").groupBy("crate_id", "id").agg(F.min("pos").cast("int").alias("pos"))
    new = new.join(roots, ["crate_id", "id"]).groupBy("crate_id", "pos", "id").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    old = properties.filter("depth = 0 AND key = 'hasPart'").select("crate_id", "pos", F.when(F.col("tag") == "ids", F.col("ids")).alias("listed"))
    ids = F.coalesce(F.concat("listed", F.array_except("parts", "listed")), "parts")
    found = new.join(old, ["crate_id", "pos"], "left").withColumn("ids", ids)
    given = {"key": F.lit("hasPart"), "path": F.lit("hasPart"), "depth": F.lit(0), "origin": F.lit("dynamic"), "owner": F.col("id"), "tag": F.lit("ids"), "json": F.lit(None).cast("string")}
    kinds = dict(properties.dtypes)
    rows = found.select(*(given[c].alias(c) if c in given else (F.col(c) if c in ("crate_id", "pos", "id", "ids") else F.lit(None).cast(kinds[c]).alias(c)) for c in properties.columns))
    return _replaced(properties, rows)


def add_part_to_root(entities: DataFrame, properties: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds the id of ``ids`` (crate_id, id) to the parts of the root that has this very id: a root can only become a part of itself this way."""
    return add_parts(entities, properties, ids.select("crate_id", "id", F.col("id").alias("part")))


def add_context(items: DataFrame, new: DataFrame) -> DataFrame:
    """Appends context items (crate_id, kind, key, value) behind each package's last.

    References get a place each, in the order of their texts; the embedded terms of
    one call are one item, behind them.
    """
    last = items.groupBy("crate_id").agg(F.max("pos").alias("last"))
    nth = F.dense_rank().over(Window.partitionBy("crate_id").orderBy(F.when(F.col("kind") == "reference", F.col("value")).asc_nulls_last()))  # a call's items of one package
    placed = new.withColumn("nth", nth).join(last, "crate_id", "left").withColumn("pos", (F.coalesce("last", F.lit(-1)) + F.col("nth")).cast("int")).select(*items.columns)
    return items.unionByName(placed)


def remove_context(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes items equal in kind, key and value; ``gone`` has crate_id, kind, key, value."""
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("crate_id", "kind", "key", "value")]
    return items.alias("i").join(gone.alias("g"), same, "left_anti")


def replace_context(items: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Removes and appends; the new items stand at the end."""
    return add_context(remove_context(items, gone), new)


def add_urn_uuid(items: DataFrame, uuids: DataFrame) -> DataFrame:
    """Gives every embedded context of a package without a urn base an ``@base`` of ``urn:uuid:`` and the package's ``uuid``; a lone reference gets an embedded context, others none."""
    has_urn = items.filter((F.col("key") == "@base") & F.col("value").startswith("urn:uuid:")).select("crate_id").distinct()
    open_ = items.join(has_urn, "crate_id", "left_anti")
    shape = open_.groupBy("crate_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "embedded").alias("embedded"), F.max("pos").alias("last"))
    base = F.concat(F.lit("urn:uuid:"), F.col("uuid"))
    maps = open_.filter("kind = 'embedded'").select("crate_id", "pos").distinct()
    lone = shape.filter("n = 1 AND embedded = 0").select("crate_id", (F.col("last") + 1).cast("int").alias("pos"))
    new = maps.unionByName(lone).join(uuids, "crate_id").select("crate_id", "pos", F.lit("embedded").alias("kind"), F.lit("@base").alias("key"), base.alias("value"))
    return items.join(new.select("crate_id", "pos", "key"), ["crate_id", "pos", "key"], "left_anti").select(*items.columns).unionByName(new)


def object_store_id(id_: Column, root: str) -> Column:
    """An id with the store's root in front, unless it is a URL."""
    return F.when(is_not_url(id_), F.concat(F.lit(root), id_)).otherwise(id_)


def to_object_store(entities: DataFrame, properties: DataFrame, root: str, rewrite_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prefixes every entity's id; links stay as they are unless ``rewrite_links``."""
    moved = entities.withColumn("id", object_store_id(F.col("id"), root))
    rows = properties.withColumn("id", object_store_id(F.col("id"), root))
    if rewrite_links:
        rows = rows.withColumn("ids", F.transform("ids", lambda x: object_store_id(x, root)))
    return moved, rows
