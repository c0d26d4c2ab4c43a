"""How documents become tables: one pass, one table, nothing joined."""

import os
import re

from parcelgraph.operators import lookup
from parcelgraph.plans.storage import written, written_path
from parcelgraph.sources.packages import parse

HEAD = '{"@context":"https://w3id.org/ro/crate/1.2/context","@graph":[{"@id":"ro-crate-metadata.json","@type":"CreativeWork","conformsTo":{"@id":"https://w3id.org/ro/crate/1.2"},"about":{"@id":"./"}},{"@id":"./","@type":"Dataset","name":"n","description":"","datePublished":"","license":"CC0"'


def texts(spark, **docs):
    return spark.createDataFrame([(k, "s", v) for k, v in docs.items()], "crate_id string, source string, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_properties_of_kept_packages_need_no_join(spark):
    p = parse(texts(spark, good=HEAD + ',"x":"F"}]}', bad=HEAD + "}"), properties="top")
    assert not any(word in plan(p.properties) + plan(p.entities) + plan(p.crates) for word in ("Join", "Exchange"))
    assert [r["crate_id"] for r in lookup.has_value(p.properties, "F").collect()] == ["good"]
    assert [tuple(r) for r in p.rejects.collect()] == [("bad", "not JSON")]


def test_variants_are_written_as_wholes(spark):
    path = written_path(spark.sql("SELECT parse_json('{\"a\":{\"b\":1}}') AS v"))
    import pyarrow.parquet as pq

    part = next(f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".parquet"))
    names = {c.path for c in pq.ParquetFile(f"{path.removeprefix('file://')}/{part}").schema}
    assert names == {"v.value", "v.metadata"}
    assert spark.conf.get("spark.sql.variant.writeShredding.enabled") == "true"


def test_lists_alone(spark):
    p = parse(texts(spark, a=HEAD + ',"m":[1,{"@id":"#x"},["y",2]],"o":{"p":[1,"z"]},"t":["u",null]}]}'), properties="lists")
    got = {(r["path"], r["origin"], r["tag"]) for r in p.properties.filter("depth > 0").collect()}
    assert got == {("m[0]", "item", "int"), ("m[1]", "item", "id"), ("m[2]", "item", "array"), ("m[2][0]", "item", "string"), ("m[2][1]", "item", "int"), ("t[0]", "item", "string"), ("t[1]", "item", "null")}


def test_deep_values_beyond_the_levels_of_one_plan(spark):
    p = parse(texts(spark, a=HEAD + ',"a":{"b":{"c":{"d":{"e":{"f":{"g":"deep"}}}}}}}]}'))
    assert [r["path"] for r in written(p.properties.filter("s = 'deep'")).collect()] == ["a/b/c/d/e/f/g"]


def test_tags_of_odd_lists(spark):
    odd = '"a":[{"@id":"x"},{}],"b":[{"@id":"x"},null],"c":[{"@id":"null"},{"@id":"{}"}],"d":[null],"e":[],"f":["null"],"g":[{"@id":"x","n":"y"}],"h":{"@id":1},"i":[1,null],"j":[1.5,2]'
    p = parse(texts(spark, a=HEAD + "," + odd + "}]}"), properties="top")
    got = {r["key"]: r["tag"] for r in p.properties.filter("origin = 'dynamic' AND length(key) = 1").collect()}
    assert got == {"a": "array", "b": "array", "c": "ids", "d": "array", "e": "strings", "f": "strings", "g": "ids", "h": "object", "i": "array", "j": "floats"}


def test_archives_of_packages_that_span_batches(spark, tmp_path):
    """Packages' members come in several batches, and each has one archive, which tasks read by its path."""
    from parcelgraph.sources import sinks
    from parcelgraph.sources.packages import read_listed

    docs = texts(spark, **{f"p-{i}": HEAD + "}]}" for i in range(7)}).select("crate_id", "text")
    file = tmp_path / "x"
    file.write_text("x")
    plan_ = spark.createDataFrame([(f"p-{i}", str(file), f"f{j}") for i in range(7) for j in range(5)], "crate_id string, path string, entry string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = written(sinks.write_zips(docs, plan_, f"file://{tmp_path}/out"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["crate_id"], r["n_entries"]) for r in made.collect()) == [(f"p-{i}", 6) for i in range(7)]
    back = parse(read_listed(made, zipped=True), properties=False)
    assert back.crates.count() == 7 and back.entities.count() == 14


def test_common_names_and_literals_are_no_one_tasks(spark, monkeypatch):
    """Rows without a name and those of the most used names are dealt to all tasks; each gets its IRI all the same."""
    from pyspark.sql import functions as F

    from parcelgraph.operators import rdf

    monkeypatch.setattr(rdf, "COMMON_USES", 100)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    rows = spark.range(2000).select(F.lit("x").alias("ctx"), F.col("id").cast("string").alias("s"), F.col("id").cast("string").alias("o"), F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 4 == 1, F.concat(F.lit("n"), "id")).alias("name"))
    uses = rows.filter("name IS NOT NULL").groupBy("ctx", "name").agg(F.count("*").alias("uses"))
    names = written(uses.withColumn("iri", F.concat(F.lit("i:"), "name")))
    found = rdf.with_names(rows, names, "name", "iri").withColumn("task", F.spark_partition_id()).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert len(found) == 2000 and all(r["iri"] == (f"i:{r['name']}" if r["name"] else None) for r in found)
    tasks = [r["task"] for r in found]
    assert max(map(tasks.count, set(tasks))) < 1000


def test_schema_of_a_value_is_worked_out_once(spark):
    """Filters on tags take the schema as it is, and don't work it out anew for each condition."""
    p = parse(texts(spark, a=HEAD + ',"x":{"@id":"y"}}]}'), properties="top")
    assert len(set(re.findall(r"[^\n]*schemaofvariant\(value#", plan(p.properties.filter("tag = 'id' OR tag = 'ids'").select("key")).lower()))) == 1


def test_levels_that_are_not_there_write_no_table(spark, monkeypatch):
    from parcelgraph.sources import packages

    made = []
    docs = packages.parse_documents(texts(spark, a=HEAD + ',"o":{"p":{"q":1}}}]}'))
    monkeypatch.setattr(packages, "written", lambda df, *a: made.append(df) or written(df, *a))
    found = packages.tables(docs, ("path",)).properties
    assert not made and {"o", "o/p", "o/p/q"} <= {r["path"] for r in found.collect()}


def test_without_links_nothing_is_below_them(spark):
    text = HEAD + ',"l":{"@id":"#a"},"m":[{"@id":"#b"},{"@id":"#c"}],"o":{"p":1,"q":{"@id":"#d"}},"t":["u",{"@id":"#e"}]}]}'
    every, some = (parse(texts(spark, a=text), properties=("path",), links=links).properties for links in (True, False))
    of = lambda df: sorted((r["path"], r["origin"], r["tag"]) for r in df.collect())
    assert of(some) == of(every.filter("origin != 'link'")) and every.filter("origin = 'link'").count() > 0


def test_frames_of_tables_with_bases_need_no_join(spark):
    from parcelgraph.operators import frame

    based = HEAD.replace('"https://w3id.org/ro/crate/1.2/context"', '["https://w3id.org/ro/crate/1.2/context",{"@base":"urn:uuid:u-1"}]') + "}]}"
    p, q = (parse(texts(spark, a=based, b=HEAD + "}]}"), properties="top", extra=e) for e in (("base",), ()))
    made, joined = (frame.eav_frame(x.crates, x.context_items, x.entities, x.properties) for x in (p, q))
    assert "Join" not in plan(made) and "Join" in plan(joined)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, joined.collect())) != []


def test_parts_are_placed_without_a_look_at_other_entities(spark):
    from parcelgraph.operators import edit

    p = parse(texts(spark, a=HEAD + ',"hasPart":[{"@id":"x"}]}]}'), properties="top")
    new = spark.createDataFrame([("a", "./", "y"), ("a", "#no", "z")], "crate_id string, id string, part string")
    found = edit.add_parts(p.entities, p.properties, new)
    assert [(r["id"], r["ids"]) for r in found.filter("key = 'hasPart'").collect()] == [("./", ["x", "y"])]
    assert plan(found).count("explode(entities") == 2  # the roots, once for each of the two sides


def test_values_of_a_property_need_no_join_with_entities(spark):
    text = HEAD + '},{"@id":"f","@type":"File","name":"n2","o":{"name":"inner"}}]}'
    with_kind = parse(texts(spark, a=text), properties=("path", "json"), links=False, extra=("kind",))
    plain = parse(texts(spark, a=text))
    found = lookup.property_values(with_kind.entities, with_kind.properties, "name")
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lookup.property_values(plain.entities, plain.properties, "name").collect()))
