"""Joins of tables that grow with the packages: none of their sides is gathered on the driver."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from parcelgraph.operators import edit, rdf, rdf_import, validate
from parcelgraph.sources import packages as sources
from parcelgraph.sources import sinks

PROFILE = "https://w3id.org/ro/crate"


def document(n: int) -> str:
    graph = [
        {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "conformsTo": {"@id": f"{PROFILE}/1.2"}, "about": {"@id": "./"}},
        {"@id": "./", "@type": "Dataset", "name": f"n{n}", "description": "", "datePublished": "2024", "license": "CC0", "hasPart": [{"@id": "a.csv"}, {"@id": "lost.csv"}]},
        {"@id": "a.csv", "@type": "File", "status": "P", "detail": {"level": n}},
    ]
    return json.dumps({"@context": [f"{PROFILE}/1.2/context", {"own": f"http://own.example/{n}"}], "@graph": graph})


@pytest.fixture(scope="module")
def read(spark):
    return sources.parse(sources.from_texts(spark, {f"c-{n}": document(n) for n in range(3)}))


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_documents_are_put_together_by_shuffle(read):
    docs = sinks.documents(read, indent=None)
    assert broadcasts(docs) == 0
    assert {r["crate_id"]: json.loads(r["text"])["@graph"][1]["name"] for r in docs.collect()} == {f"c-{n}": f"n{n}" for n in range(3)}


def test_indented_documents_are_put_together_by_shuffle(read):
    docs = sinks.documents(read)
    assert broadcasts(docs) == 0
    assert all(r["text"] == json.dumps(json.loads(r["text"]), indent=2) + "\n" for r in docs.collect())


def test_validation_broadcasts_the_vocabulary_alone(read, spark):
    terms = spark.createDataFrame([("1.2", k, f"http://schema.org/{k}") for k in ("hasPart", "status")], "version string, term string, iri string")
    report = validate.validation_report(read.crates, read.entities, read.properties, read.context_items, terms)
    assert broadcasts(report) <= 1
    assert {(r["crate_id"], r["status"], ",".join(r["invalid_keys"]), ",".join(r["invalid_ids"])) for r in report.collect()} == {(f"c-{n}", "invalid", "detail,level", "CC0,lost.csv") for n in range(3)}


def test_remote_packages_meet_their_names_by_shuffle(spark, tmp_path):
    from parcelgraph import package_queries

    spark.range(14).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    found = package_queries.remote_packages(spark, str(tmp_path))
    assert broadcasts(found) == 0
    assert sorted(r["name"] for r in found.filter("name IS NOT NULL").collect()) == sorted(str(n) for n in range(14) if n % 7 != 6)


def test_removed_properties_meet_theirs_by_shuffle(read):
    gone = read.properties.filter("key = 'status'").select("crate_id", "id", F.lit("detail").alias("key"))
    rows = edit.remove_property(read.entities, read.properties, gone)
    assert broadcasts(rows) == 0
    assert rows.filter("id = 'a.csv' AND depth = 0 AND origin = 'dynamic'").select("key").distinct().collect() == [("status",)]


def test_set_properties_meet_theirs_by_shuffle(read):
    new = read.properties.filter("key = 'status'").withColumns({"s": F.lit("open"), "json": F.lit('"open"')}).drop("pos")
    rows = edit.set_property(read.entities, read.properties, new)
    assert broadcasts(rows) == 0
    assert [r["s"] for r in rows.filter("key = 'status'").collect()] == ["open"] * 3


def test_zipped_documents_are_read_back(read, spark, tmp_path):
    docs = sinks.documents(read)
    none = spark.createDataFrame([], "crate_id string, path string, entry string")
    assert broadcasts(docs) == 0
    files = sinks.write_zips(docs, none, f"file://{tmp_path}").localCheckpoint()
    back = sources.parse(sources.read_listed(files, zipped=True), properties=False)
    assert back.entities.count() == 9


VOCABULARY = [("1.2", k, f"http://schema.org/{k}") for k in ("CreativeWork", "Dataset", "File", "about", "conformsTo", "datePublished", "hasPart", "license", "name", "status")] + [("1.2", "schema", "http://schema.org/")]


def exported(read, spark):
    terms = spark.createDataFrame(VOCABULARY, "version string, term string, iri string")
    return rdf.export_triples(read.crates, read.entities, read.properties, terms, "http://home.example/", context_items=read.context_items), terms


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_triples_are_shuffled_to_packages_and_subjects_alone(read, spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many packages
    try:
        triples, _ = exported(read, spark)
        assert exchanges(triples) <= 5  # raw triples, packages and contexts, IRIs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = set(triples.collect())
    monkeypatch.setattr(rdf, "BROADCAST_TERMS", -1)
    assert found and found == set(exported(read, spark)[0].collect())


def test_turtle_finds_subjects_together(read, spark):
    triples, _ = exported(read, spark)
    assert exchanges(rdf.turtle(triples)) == exchanges(triples)


def test_dangling_references_make_triples_once(read, spark):
    triples, terms = exported(read, spark)
    dangling = rdf.dangling_references(triples, terms)
    assert exchanges(dangling) <= 3
    assert {r["dst"] for r in dangling.collect()} == {"http://home.example/lost.csv", f"{PROFILE}/1.2"}


def test_imported_rows_keep_no_names_twice(read, spark, monkeypatch):
    kept, plain = [], rdf_import.written
    monkeypatch.setattr(rdf_import, "written", lambda df, *way: kept.append(df.columns) or plain(df, *way))
    triples, terms = exported(read, spark)
    found = rdf_import.import_packages(triples, terms)
    assert not [c for c in kept if "s_name" in c or "metadata" in c and "target" in c]
    assert {(r["id"], r["kind"]) for r in found.entities.collect()} >= {("ro-crate-metadata.json", "descriptor"), ("./", "root"), ("./a.csv", "data")}
