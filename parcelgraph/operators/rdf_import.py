"""Packages from RDF triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.functions.values import DESCRIPTOR_ID, ROOT_ID
from parcelgraph.operators.rdf import RDF_TYPE, compact, import_kind, out_references, roots, typed_literal, without_vocabulary
from parcelgraph.operators.reach import reachable
from parcelgraph.plans.storage import grown, written
from parcelgraph.plans.tables import Packages
from parcelgraph.sources.packages import COMPRESSION, REQUIRED

#: Fixed value: the profile that an imported descriptor conforms to.
CONTEXT_IRI = "https://w3id.org/ro/crate/1.2/context"

#: Parts of a package for numbering its entities.
PARTS = 512


def _relative(id_: Column) -> Column:
    """``./`` in front of bare paths."""
    bare = ~id_.contains(":") & ~id_.rlike(r"^(#|\.|/|_:)") & (id_ != "")
    return F.when(bare, F.concat(F.lit("./"), id_)).otherwise(id_)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, from 0 in each package: ranks in two levels, parts of a package by hash and then ids in a part, so that no task numbers a whole package."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    sums = rows.groupBy("crate_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("crate_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("crate_id", "part").orderBy("id")) - 1
    return rows.withColumn("inner", inner).join(sums.select("crate_id", "part", before.alias("before")), ["crate_id", "part"]).withColumn("pos", (F.col("before") + F.col("inner")).cast("int")).drop("part", "inner", "before")


def import_packages(triples: DataFrame, terms: DataFrame, base: str | None = None) -> Packages:
    """Packages of the entities that links reach from each graph's metadata and root.

    Ids become relative to ``base``, by default the folder of the metadata's IRI;
    properties and types get the vocabulary's names.  An entity without a type is a
    ``Thing``; a root lacks no required property (they are empty texts), and a
    descriptor always conforms to one profile.  Entities that nothing reaches but
    links to terms of the vocabulary, and graphs without a root, are left out.
    """
    triples = written(triples, COMPRESSION)
    found = written(roots(triples))
    starts = found.select("crate_id", F.explode(F.array("metadata", "root")).alias("id"))
    kept = triples.join(grown(reachable(starts, without_vocabulary(out_references(triples), terms)).select("crate_id", F.col("id").alias("s"))), ["crate_id", "s"], "left_semi")
    home = found.withColumn("base", F.coalesce(F.lit(base), F.regexp_extract("metadata", r"^(.*/)", 1))).select("crate_id", "base", "metadata", "root")
    iris = kept.select("crate_id", F.explode(F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))).alias("iri")).filter("iri IS NOT NULL").distinct()
    named = written(compact(iris.join(home.select("crate_id", "base"), "crate_id").withColumns({"version": F.lit("1.2"), "vocab": F.lit(None).cast("string")}), terms).select("crate_id", "iri", "name"))

    def name(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(grown(named.select("crate_id", F.col("iri").alias(column), F.col("name").alias(out))), ["crate_id", column], "left").withColumn(out, F.coalesce(out, column))

    rows = name(name(name(kept, "s", "s_name"), "p", "key"), "o", "o_name").join(home, "crate_id")
    id_ = F.when(F.col("s") == F.col("metadata"), DESCRIPTOR_ID).when(F.col("s") == F.col("root"), ROOT_ID).otherwise(_relative(F.col("s_name")))
    target = F.when(F.col("o") == F.col("root"), ROOT_ID).when(F.col("o") == F.col("metadata"), DESCRIPTOR_ID).otherwise(_relative(F.col("o_name")))
    rows = written(rows.withColumns({"id": id_, "target": target}).select("crate_id", "id", "key", "p", "o", "o_kind", "o_name", "target", "datatype"), COMPRESSION)
    types = rows.groupBy("crate_id", "id").agg(F.sort_array(F.collect_set(F.when(F.col("p") == RDF_TYPE, F.col("o_name")))).alias("types"))
    types = types.withColumn("types", F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit("Thing"))))
    kind = F.when(F.col("id") == DESCRIPTOR_ID, "descriptor").when(F.col("id") == ROOT_ID, "root").otherwise(import_kind(F.col("id"), F.col("types")))
    types = _numbered(types)
    entities = types.select("crate_id", "pos", "id", kind.alias("kind"), "types", (F.size("types") > 1).alias("types_is_array"))
    entities = written(entities)

    values = rows.filter(F.col("p") != RDF_TYPE).withColumn("v", typed_literal(F.col("o"), F.col("datatype")))
    node = F.col("o_kind") != "literal"
    tag = F.when(node, "id").otherwise(F.col("v.tag"))
    text = F.when(node, F.col("target")).when(F.col("v.tag") == "string", F.col("v.s")).when(F.col("v.tag") == "bool", F.col("v.b").cast("string")).otherwise(F.col("o"))
    grouped = values.groupBy("crate_id", "id", "key").agg(F.sort_array(F.collect_list(F.struct(tag.alias("tag"), text.alias("text"), F.col("v.i").alias("i"), F.col("v.d").alias("d")))).alias("all"))
    one, tags = F.element_at("all", 1), F.array_distinct(F.transform("all", lambda x: x["tag"]))
    plural = {"id": "ids", "string": "strings", "int": "ints", "float": "floats"}
    lone = F.size("all") == 1
    whole = F.when(lone, one["tag"]).when(F.size(tags) > 1, "array").otherwise(F.coalesce(*(F.when(F.element_at(tags, 1) == k, v) for k, v in plural.items()), F.lit("array")))
    texts = F.transform("all", lambda x: x["text"])
    quoted = lambda x: F.when(x["tag"] == "id", F.concat(F.lit('{"@id":'), F.to_json(F.array(x["text"])).substr(F.lit(2), F.length(F.to_json(F.array(x["text"]))) - 2), F.lit("}"))).when(x["tag"] == "string", F.to_json(F.array(x["text"])).substr(F.lit(2), F.length(F.to_json(F.array(x["text"]))) - 2)).otherwise(x["text"])
    fixed = F.coalesce(*(F.when(F.col("kind") == k, F.col("key").isin(*names)) for k, names in REQUIRED.items() if names), F.lit(False))
    properties = grouped.join(entities.select("crate_id", "id", "pos", "kind"), ["crate_id", "id"]).select(
        "crate_id", "pos", "id", "key", F.col("key").alias("path"), F.lit(0).alias("depth"), F.when(fixed, "fixed").otherwise("dynamic").alias("origin"), F.col("id").alias("owner"), whole.alias("tag"),
        F.when(lone & (one["tag"] == "string"), one["text"]).alias("s"), F.when(lone, one["i"]).alias("i"), F.when(lone, one["d"]).alias("d"),
        F.when(whole.isin("id", "ids"), texts).alias("ids"), F.when(whole.isin("strings", "ints", "floats"), texts).alias("items"),
        F.when(lone, quoted(one)).otherwise(F.concat(F.lit("["), F.concat_ws(",", F.transform("all", quoted)), F.lit("]"))).alias("json"),
    )
    # The members of mixed lists are rows too, as they are for packages read from JSON.
    mixed = grouped.withColumn("whole", whole).filter("whole = 'array'").join(entities.select("crate_id", "id", "pos"), ["crate_id", "id"]).select("crate_id", "pos", "id", "key", F.posexplode("all").alias("nth", "x"))
    x = F.col("x")
    items = mixed.select(
        "crate_id", "pos", "id", "key", F.concat("key", F.lit("["), F.col("nth").cast("string"), F.lit("]")).alias("path"), F.lit(1).alias("depth"), F.lit("item").alias("origin"), F.col("id").alias("owner"), x["tag"].alias("tag"),
        F.when(x["tag"] == "string", x["text"]).alias("s"), x["i"].alias("i"), x["d"].alias("d"), F.when(x["tag"] == "id", F.array(x["text"])).alias("ids"), F.lit(None).cast("array<string>").alias("items"), quoted(x).alias("json"),
    )
    # A descriptor's profile is always the same, and one that says nothing is about the root.
    properties = properties.filter(~((F.col("id") == DESCRIPTOR_ID) & (F.col("key") == "conformsTo")))
    due = entities.filter("kind = 'descriptor'").select("crate_id", "pos", "id", F.explode(F.array(F.struct(F.lit("conformsTo").alias("key"), F.lit(CONTEXT_IRI).alias("to")), F.struct(F.lit("about").alias("key"), F.lit(ROOT_ID).alias("to")))).alias("d")).select("crate_id", "pos", "id", "d.*")
    due = due.join(properties.select("crate_id", "pos", "key"), ["crate_id", "pos", "key"], "left_anti")
    linked = {"ids": F.array("to"), "json": F.concat(F.lit('{"@id":"'), F.col("to"), F.lit('"}')), **{c: F.lit(None).cast(t) for c, t in (("s", "string"), ("i", "bigint"), ("d", "double"), ("items", "array<string>"))}}
    due = due.withColumns({"path": F.col("key"), "depth": F.lit(0), "origin": F.lit("fixed"), "owner": F.col("id"), "tag": F.lit("id"), **linked}).select(*properties.columns)
    missing = entities.filter("kind = 'root'").select("crate_id", "pos", "id", F.explode(F.array(*map(F.lit, REQUIRED["root"]))).alias("key")).join(properties.select("crate_id", "pos", "key"), ["crate_id", "pos", "key"], "left_anti")
    empty = {c: F.lit(None).cast(t) for c, t in (("i", "bigint"), ("d", "double"), ("ids", "array<string>"), ("items", "array<string>"))}
    missing = missing.withColumns({"path": F.col("key"), "depth": F.lit(0), "origin": F.lit("fixed"), "owner": F.col("id"), "tag": F.lit("string"), "s": F.lit(""), "json": F.lit('""'), **empty}).select(*properties.columns)
    crates = home.select("crate_id", F.lit("rdf").alias("source"), F.lit("1.2").alias("schema_version"), "base")
    context = home.select("crate_id", F.lit(1).alias("pos"), F.lit("reference").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(CONTEXT_IRI).alias("value"))
    return Packages(crates, context, entities, written(properties.unionByName(missing).unionByName(due).unionByName(items)))
