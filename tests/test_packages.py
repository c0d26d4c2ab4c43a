"""Operators on small packages."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelgraph.functions.links import expand_home, guess_location, is_not_url, with_base
from parcelgraph.functions.values import number_text
from parcelgraph.operators import counts, edit, frame, lookup, nested, rdf, rdf_import, reach, validate
from parcelgraph.package import NotReadable, Package
from parcelgraph.sources import packages as sources
from parcelgraph.sources import contexts, remote, sinks

CONTEXT = "https://w3id.org/ro/crate/1.1/context"


def document(*entities, context=CONTEXT, **root):
    graph = [
        {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}, "about": {"@id": "./"}},
        {"@id": "./", "@type": "Dataset", "name": "n", "description": "d", "datePublished": "2024", "license": {"@id": "#lic"}, **root},
        {"@id": "#lic", "@type": "CreativeWork", "name": "free"},
        *entities,
    ]
    return json.dumps({"@context": context, "@graph": graph})


VALUES = {
    "text": "x", "none": None, "yes": True, "whole": 3, "part": 2.5, "one": 1.0, "big": 18446744073709551615, "empty": [], "texts": ["a", "b"], "holes": ["a", None], "numbers": [1, 2], "mixed_numbers": [1, 2.5],
    "link": {"@id": "#lic"}, "links": [{"@id": "#lic"}, {"@id": "#ghost", "name": "dropped"}], "object": {"inner": "deep", "more": {"@id": "#far", "k": "v"}}, "nothing": {}, "mix": [1, "a", {"@id": "#lic"}], "flags": [True],
}
TAGS = {"text": "string", "none": "null", "yes": "null_bool", "whole": "int", "part": "float", "one": "float", "big": "float", "empty": "strings", "texts": "strings", "holes": "array", "numbers": "ints", "mixed_numbers": "floats", "link": "id", "links": "ids", "object": "object", "nothing": "object", "mix": "array", "flags": "array"}


@pytest.fixture(scope="module")
def valued(spark):
    return sources.parse(sources.from_texts(spark, {"c": document({"@id": "#e", "@type": ["Thing", "File"], **VALUES})}))


def test_tags(valued):
    got = {r["key"]: r["tag"] for r in valued.properties.filter("id = '#e' AND depth = 0 AND origin = 'dynamic'").collect()}
    assert got == TAGS


def test_kinds_and_rejects(spark):
    bad = {"text": "not JSON", "list": json.dumps({"@context": {"a": "b"}, "@graph": []}), "no_type": document({"@id": "#x"}), "no_license": document().replace('"license"', '"licence"'), "ok": document({"@id": "data.csv", "@type": "File"}).replace('"n"', "None")}
    got = sources.parse(sources.from_texts(spark, bad))
    assert {r["crate_id"] for r in got.rejects.collect()} == {"text", "list", "no_type", "no_license", "ok"}  # a null name is missing
    fine = sources.parse(sources.from_texts(spark, {"a": document({"@id": "data.csv", "@type": "File"}, {"@id": "#f", "@type": "File"}, {"@id": "p", "@type": "Person", "x": 1}).replace('"x": 1', '"x": None')}))
    assert fine.rejects.count() == 0
    assert [r["kind"] for r in fine.entities.orderBy("pos").collect()] == ["descriptor", "root", "contextual", "data", "contextual", "contextual"]
    assert fine.crates.first()["schema_version"] == "1.1"


def test_links_and_dangling(valued):
    got = {(r["src"], r["dst"]) for r in lookup.edges(valued.properties).collect()}
    assert got == {("ro-crate-metadata.json", "https://w3id.org/ro/crate/1.1"), ("ro-crate-metadata.json", "./"), ("./", "#lic"), ("#e", "#lic"), ("#e", "#ghost")}
    assert [r["dst"] for r in validate.dangling_ids(valued.entities, lookup.edges(valued.properties)).collect()] == ["#ghost"]


def test_validation(spark):
    terms = spark.createDataFrame([("1.1", "name", "http://schema.org/name")], "version string, term string, iri string")
    package = Package.read_object(spark, document({"@id": "#e", "@type": "Thing", "nonschemakey": 1, "name": "x", "own": 1}, context=[CONTEXT, {"own": "http://o/own"}]))
    row = package.validate(terms).first()
    assert (row["status"], row["invalid_keys"], row["invalid_ids"], row["invalid_types"]) == ("invalid", ["nonschemakey"], [], [])
    assert validate.enforce(package.validate(terms), 1).count() == 1
    with pytest.raises(validate.NotValid):
        validate.enforce(package.validate(terms), 2)


def test_counts_and_search(valued):
    assert {(r["id"], r["value"], r["n"]) for r in counts.field_value_counts(valued.properties, "name").collect()} == {("./", '"n"', 1), ("#lic", '"free"', 1), ("#ghost", '"dropped"', 1)}
    assert {(r["id"], r["n"]) for r in counts.value_search_counts(valued.properties, "a").collect()} == {("N/A", 3)}
    assert {(r["id"], r["n"]) for r in counts.value_search_counts(valued.properties, "v").collect()} == {("#far", 1), ("N/A", 1)}
    assert [(r["id"], r["key"]) for r in lookup.entities_with_value(valued.properties, "deep").collect()] == [("#e", "inner")]
    assert lookup.entities_with_value(valued.properties, "3").count() == 0  # bare text is a string
    assert "inner" in {r["key"] for r in lookup.property_keys(valued.properties).collect()}
    got = {r["id"]: r["json"] for r in lookup.property_values(valued.entities, valued.properties, "name").collect()}
    assert got == {"./": '"n"', "#lic": '"free"'}
    assert lookup.property_values(valued.entities, valued.properties, "datePublished").count() == 0


def test_frame(spark):
    package = Package.read_object(spark, document({"@id": "#e", "@type": ["A", "B"], "n": 1.0, "f": 2.5, "l": ["x", "y"], "b": True, "o": {"x": 1}}, context=[CONTEXT, {"t": "http://t"}])).add_urn_uuid("0189-x")
    rows = Counter((r["id"], r["key"], r["value"]) for r in package.frame().collect())
    assert rows[("ro-crate-metadata.json", "conformsTo", "./")] == 1  # about
    assert {k[1:] for k in rows if k[0] == "#e"} == {("@type", "A"), ("@type", "B"), ("n", "1"), ("f", "2.5"), ("l", "x"), ("l", "y")}
    assert rows[("@context", "@base", "urn:uuid:0189-x")] == rows[("@context", "t", "http://t")] == rows[("@context", "ro-crate", CONTEXT)] == 1
    assert {r["uuid"] for r in package.frame().collect()} == {"0189-x"}


def test_edits(spark):
    package = Package.read_object(spark, document({"@id": "a.csv", "@type": "File", "author": {"@id": "#lic"}, "see": [{"@id": "#lic"}, {"@id": "./"}], "same": "#lic"}))
    renamed = package.replace_id("#lic", "#license")
    assert renamed.get_entity("a.csv") == {"id": "a.csv", "type": "File", "author": {"@id": "#license"}, "same": "#lic", "see": [{"@id": "#license"}, {"@id": "./"}]}
    assert renamed.get_entity("./")["license"] == {"@id": "#lic"}  # required links stay
    gone = package.delete_entity("#lic", recursive=True)
    assert gone.get_entity("#lic") is None and gone.get_entity("a.csv") == {"id": "a.csv", "type": "File", "see": [{"@id": "./"}]}
    more = package.update({"id": "b.csv", "type": ["File", "X"], "n": {"a": [1]}, "none": None}).update({"id": "a.csv", "type": "File", "name": "new"})
    assert more.get_entity("b.csv") == {"id": "b.csv", "type": ["File", "X"], "n": {"a": [1]}, "none": "None"}
    assert more.get_entity("a.csv") == {"id": "a.csv", "type": "File", "name": "new"}
    assert [e["id"] for e in more.to_list()] == ["ro-crate-metadata.json", "./", "#lic", "a.csv", "b.csv"]
    stored = package.prefix_ids("s3://b/")
    assert stored.get_entity("s3://b/a.csv")["author"] == {"@id": "#lic"}
    t = package.tables
    key = spark.createDataFrame([("object", "a.csv", "author")], "crate_id string, id string, key string")
    assert edit.remove_property(t.entities, t.properties, key).filter("id = 'a.csv' AND key = 'author'").count() == 0


def test_context_edits(spark):
    t = Package.read_object(spark, document(context=[CONTEXT, {"t": "http://t"}])).tables
    one = spark.createDataFrame([("object", "reference", None, "http://more")], "crate_id string, kind string, key string, value string")
    gone = spark.createDataFrame([("object", "embedded", "t", "http://t")], "crate_id string, kind string, key string, value string")
    assert [r["value"] for r in edit.replace_context(t.context_items, gone, one).orderBy("pos").collect()] == [CONTEXT, "http://more"]
    assert lookup.context_value(t.context_items, "t").first()["value"] == "http://t"
    assert {r["name"] for r in lookup.context_names(t.context_items).collect()} == {CONTEXT, "t"}


def test_documents_round_trip(spark, tmp_path):
    text = document({"@id": "#e", "@type": ["Thing"], **{k: v for k, v in VALUES.items() if k not in ("one", "big", "links")}}, context=[CONTEXT, {"b": "http://b", "a": 'q"'}])
    package = Package.read_object(spark, text)
    assert json.loads(package.text()) == json.loads(text)
    docs = sinks.documents(package.tables).withColumn("path", F.lit("sub/meta.json"))
    sinks.write_documents(docs, str(tmp_path)).collect()
    assert Package.read(spark, f"{tmp_path}/sub/meta.json").get_entity("#lic")["name"] == "free"


def test_archives(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    for name in ("in/a.txt", "in/d/b.txt", "out.txt"):
        (tmp_path / name).write_text(name)
    files = spark.createDataFrame([("object", f"{tmp_path}/in", f"{tmp_path}/{n}") for n in ("in/a.txt", "in/d/b.txt", "out.txt")], "crate_id string, root string, path string")
    plan = sinks.archive_plan(files)
    assert {r["entry"] for r in plan.collect()} == {"a.txt", "d/b.txt", "external/out.txt"}
    written = sinks.write_zips(sinks.documents(Package.read_object(spark, document()).tables), plan, str(tmp_path)).first()
    assert written["n_entries"] == 4 and Package.read_zip(spark, written["path"]).get_entity("./")["name"] == "n"
    with pytest.raises(NotReadable):
        Package.read_object(spark, "{")


def test_locations(spark):
    """The parts of the URL standard in turn: special schemes with hosts of every kind, schemes without a host, then what has no scheme or a bad host."""
    hosts = ["library.test", "user@library.test", "[2001:db8::7]", "192.0.2.9:8080", "library.test?year=1", "library.test#top"]
    urls = [f"{scheme}://{host}" for scheme in ("https", "ws", "FTP") for host in hosts] + ["gopher://library.test/0", "tag:library.test,2020:shelf", "news:misc.test", "x-shelf:7", "gs://shelf/7"]
    paths = ["", "shelf", "shelf/7.csv", "#shelf", "?year=1", "_:shelf", "7up:left", "/var/shelf", "./shelf", "../shelf", "~/shelf", "file:/var/shelf", "E:/shelf", "E:\\shelf", "\\\\server\\shelf", "https://", "https://two words.test", "https://a|b.test", "ws://[2001:zz]/"]
    got = {r["s"]: r["v"] for r in spark.createDataFrame([(x,) for x in urls + paths], "s string").select("s", is_not_url(F.col("s")).alias("v")).collect()}
    assert got == {**dict.fromkeys(urls, False), **dict.fromkeys(paths, True)}
    deep = "x/" * 30
    cases = [
        ("http://h/a/b", "c", "http://h/a/c"), ("http://h/a/", "./c", "http://h/a/c"), ("http://h/a/b/", "../c", "http://h/a/c"), ("http://h/a/", "/c", "http://h/c"), ("http://h/a/#x", "#y", "http://h/a#y"), ("s3://b/k/", "d/e", "s3://b/k/d/e"),
        ("http://h", "c", "http://h/c"), ("http://h/a/b/", ".", "http://h/a/b/"), ("http://h/a/b/", "..", "http://h/a/"), (f"http://h/{deep}", "../" * 29 + "y", "http://h/x/y"), ("http://h/a/", "../../c", None), ("http://h/a/b", "../../c", "http://h/c"), ("urn:uuid:1", "c", "urn:uuid:1c"),
    ]
    got = spark.createDataFrame(cases, "b string, r string, e string").select(with_base(F.col("b"), F.col("r")).alias("v"), "e").collect()
    assert [r["v"] for r in got] == [r["e"] for r in got]
    cases = [("http://h/a/", "http://h/a/ro-crate-metadata.json"), ("http://h/a/x.json", "http://h/a/ro-crate-metadata.json"), ("http://h/a/b", "http://h/a/ro-crate-metadata.json"), ("http://h/a-b.c-d", "http://h/a-b.c-d/ro-crate-metadata.json"), ("http://h/a/x.y.z", "http://h/a/x.y.z/ro-crate-metadata.json")]
    assert all(r["v"] == r["e"] for r in spark.createDataFrame(cases, "u string, e string").select(guess_location(F.col("u")).alias("v"), "e").collect())
    assert [remote.guessed(u) for u, _ in cases] == [e for _, e in cases]
    assert [r[0] for r in spark.createDataFrame([("~",), ("~/a",), ("a~",)], "p string").select(expand_home(F.col("p"), "/home/me/")).collect()] == ["/home/me", "/home/me/a", "a~"]


def test_numbers(spark):
    cases = [(1.0, "1"), (2.5, "2.5"), (1e21, "1" + "0" * 21), (0.1, "0.1"), (-3.0, "-3")]
    assert [r[0] for r in spark.createDataFrame(cases, "d double, s string").select(number_text(F.col("d"))).collect()] == [s for _, s in cases]


TERMS = {"name": "http://schema.org/name", "description": "http://schema.org/description", "datePublished": "http://schema.org/datePublished", "license": "http://schema.org/license", "about": "http://schema.org/about", "conformsTo": "http://purl.org/dc/terms/conformsTo", "CreativeWork": "http://schema.org/CreativeWork", "Dataset": "http://schema.org/Dataset", "File": "http://schema.org/MediaObject", "MediaObject": "http://schema.org/MediaObject", "hasPart": "http://schema.org/hasPart", "size": "http://schema.org/size", "isPartOf": "http://schema.org/isPartOf"}


def test_rdf_round_trip(spark):
    terms = spark.createDataFrame([(v, k, i) for v in ("1.1", "1.2") for k, i in TERMS.items()], "version string, term string, iri string")
    package = Package.read_object(spark, document({"@id": "data.csv", "@type": "File", "size": 3, "isPartOf": {"@id": "./"}, "name": 'q"\n'}, {"@id": "lost.csv", "@type": "File"}, hasPart=[{"@id": "data.csv"}, {"@id": "_:b"}]))
    with pytest.raises(Exception, match="relative IRI"):
        package.triples(terms).collect()
    triples = package.triples(terms, base="http://h/c/")
    types = [r for r in triples.collect() if r["p"] == rdf.RDF_TYPE]
    assert len(types) == 5
    again = rdf.parse_ntriples(rdf.ntriples(triples))
    assert set(map(tuple, again.select(*triples.columns).collect())) == set(map(tuple, triples.collect()))
    back = Package(rdf_import.import_packages(again, terms), "object")
    assert back.get_entity("./data.csv") == {"id": "./data.csv", "type": "File", "isPartOf": {"@id": "./"}, "name": 'q"\n', "size": 3}
    assert back.get_entity("./")["hasPart"] in ([{"@id": "./data.csv"}, {"@id": "_:b"}], [{"@id": "_:b"}, {"@id": "./data.csv"}])
    assert back.get_entity("./lost.csv") is None and back.get_entity("#lic")["name"] == "free"
    assert back.get_entity("ro-crate-metadata.json")["about"] == {"@id": "./"}


def test_minimal_package_has_three_type_triples(spark):
    terms = spark.createDataFrame([("1.1", k, i) for k, i in TERMS.items()], "version string, term string, iri string")
    got = Package.read_object(spark, document()).triples(terms, base="http://h/").collect()
    assert sum(r["p"] == rdf.RDF_TYPE for r in got) == 3


def test_cycles_end(spark):
    edges = spark.createDataFrame([("c", "a", "k", "b"), ("c", "b", "k", "a"), ("c", "b", "k", "d")], "crate_id string, src string, key string, dst string")
    start = spark.createDataFrame([("c", "a")], "crate_id string, id string")
    assert sorted(r["id"] for r in reach.reachable(start, edges).collect()) == ["a", "b", "d"]
    children = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "parent string, child string")
    got = Counter((r["package"], r["depth"]) for r in reach.nested_packages(spark.createDataFrame([("a",)], "package string"), children).collect())
    assert got == {("a", 0): 1, ("b", 1): 1, ("c", 1): 1, ("d", 2): 2}


def test_packages_nested_more_than_a_hundred_deep(spark):
    children = spark.createDataFrame([(str(i), str(i + 1)) for i in range(103)], "parent string, child string").coalesce(1)
    got = reach.nested_packages(spark.createDataFrame([("0",)], "package string").coalesce(1), children)
    assert sorted(r["depth"] for r in got.collect()) == list(range(104))


def test_subpackages_and_remote(spark):
    t = Package.read_object(spark, document({"@id": "sub/", "@type": "Dataset", "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}, "subjectOf": {"@id": "sub/meta.json"}}, {"@id": "other/", "@type": "Dataset", "conformsTo": [{"@id": "https://w3id.org/ro/crate/1.1"}]})).tables
    found = lookup.subpackages(t.entities, t.properties)
    assert [(r["id"], r["location"]) for r in lookup.subpackage_location(found, t.properties).collect()] == [("sub/", "sub/meta.json")]
    body, zipped = document().encode(), sinks.zip_bytes(document(), {"x": b"1"})
    sites = {"http://direct": remote.Response(200, [], body), "http://sign": remote.Response(200, [("Link", '<http://direct>; rel="describedBy"')], b""), "http://zip": remote.Response(200, [("Content-Type", "application/zip")], zipped), "http://h/ro-crate-metadata.json": remote.Response(200, [], body)}
    transport = lambda url, headers: sites.get(url, remote.Response(404, [], b""))
    assert all(remote.resolve(u, transport) == document() for u in ("http://direct", "http://sign", "http://zip", "http://h/"))
    assert remote.resolve("http://nowhere", transport) is None


def test_bagit_checksums():
    import hashlib

    def bag(digest):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("bagit.txt", "x")
            z.writestr("data/ro-crate-metadata.json", "{}")
            z.writestr("manifest-sha512.txt", f"{digest}  data/ro-crate-metadata.json\n")
        return zipfile.ZipFile(out)

    assert remote.bagit_metadata(bag(hashlib.sha512(b"{}").hexdigest())) == "{}"
    assert remote.bagit_metadata(bag("0" * 128)) is None


def test_broken_archives_are_rejected(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no archive")
    (tmp_path / "b.zip").write_bytes(sinks.zip_bytes("", {"x": b"1"}).replace(b"PK", b"KP", 1))
    (tmp_path / "c.zip").write_bytes(sinks.zip_bytes(document(), {"x": b"1"}))
    got = sources.parse(sources.read_zips(spark, str(tmp_path)))
    assert got.crates.count() == 1 and {r["reason"] for r in got.rejects.collect()} == {"not JSON"}


def test_archives_with_names_that_only_differ_in_slashes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("x")
    docs = spark.createDataFrame([("a/b", document()), ("a_b", document())], "crate_id string, text string")
    files = sinks.listed_files(spark, spark.createDataFrame([("a/b", f"{tmp_path}/in"), ("a_b", f"{tmp_path}/in")], "crate_id string, root string"))
    got = sinks.write_zips(docs, sinks.archive_plan(files), f"{tmp_path}/out").collect()
    assert len({r["path"] for r in got}) == 2 and {r["n_entries"] for r in got} == {2}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a%2Fb.zip", "a_b.zip"]
    assert sources.parse(sources.read_zips(spark, f"{tmp_path}/out")).crates.count() == 2


def test_archive_of_a_folder_renames_ids(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/b.txt").write_text("b")
    package = Package.read_object(spark, document({"@id": "d/b.txt", "@type": "File"}, {"@id": "#e", "@type": "Thing", "of": {"@id": "d/b.txt"}}))
    path = package.archive(f"{tmp_path}/in", f"{tmp_path}/out", flatten=True).first()["path"]
    back = Package.read_zip(spark, path)
    assert back.get_entity("b.txt")["type"] == "File" and back.get_entity("#e")["of"] == {"@id": "b.txt"}
    assert sinks.parquet_bytes(package.add_urn_uuid("u").frame()) > 0


def test_renames_and_removals_stay_in_their_package(spark):
    both = sources.parse(sources.from_texts(spark, {k: document({"@id": "#e", "@type": "Thing", "of": {"@id": "#lic"}, "more": [{"@id": "#lic"}, {"@id": "#e"}, {"@id": "#e"}]}) for k in ("one", "two")}))
    names = spark.createDataFrame([("one", "#lic", "#new")], "crate_id string, old string, new string")
    entities, properties = edit.rename(both.entities, both.properties, names)
    assert {(r["crate_id"], r["id"]) for r in entities.filter("id IN ('#lic', '#new')").collect()} == {("one", "#new"), ("two", "#lic")}
    assert {(r["crate_id"], *r["ids"]) for r in properties.filter("key IN ('of', 'more') AND depth = 0").collect()} == {("one", "#new"), ("two", "#lic"), ("one", "#new", "#e", "#e"), ("two", "#lic", "#e", "#e")}
    gone = spark.createDataFrame([("two", "#lic")], "crate_id string, id string")
    left = edit.remove_links(both.properties, gone).filter("key IN ('of', 'more') AND depth = 0")
    assert {(r["crate_id"], r["key"], *r["ids"]) for r in left.collect()} == {("one", "of", "#lic"), ("one", "more", "#lic", "#e", "#e"), ("two", "more", "#e", "#e")}


def test_added_context_items_have_places_of_their_own(spark):
    t = Package.read_object(spark, document()).tables
    new = spark.createDataFrame([("object", "reference", None, "http://b"), ("object", "reference", None, "http://a"), ("object", "embedded", "k", "http://k"), ("object", "embedded", "l", "http://l")], "crate_id string, kind string, key string, value string")
    items = edit.add_context(t.context_items, new)
    assert [(r["pos"], r["key"], r["value"]) for r in items.orderBy("pos", "key").collect()] == [(0, None, CONTEXT), (1, None, "http://a"), (2, None, "http://b"), (3, "k", "http://k"), (3, "l", "http://l")]
    assert json.loads(Package(t.with_tables(context_items=items), "object").text())["@context"] == [CONTEXT, "http://a", "http://b", {"k": "http://k", "l": "http://l"}]


def test_parts_of_the_root(spark):
    t = Package.read_object(spark, document({"@id": "a.csv", "@type": "File"}, hasPart=[{"@id": "a.csv"}])).tables
    new = spark.createDataFrame([("object", "./", "b.csv")], "crate_id string, id string, part string")
    assert edit.add_parts(t.entities, t.properties, new).filter("key = 'hasPart'").first()["ids"] == ["a.csv", "b.csv"]
    for id_, parts in (("./", ["a.csv", "./"]), ("a.csv", ["a.csv"])):
        ids = spark.createDataFrame([("object", id_)], "crate_id string, id string")
        assert edit.add_part_to_root(t.entities, t.properties, ids).filter("key = 'hasPart' AND depth = 0").first()["ids"] == parts


def test_escapes_of_ntriples(spark):
    texts = ["C:\\new\\table", "a\\\\b\\", '"q"', "tab\there", "line\nend", "\\u0041 stays", "é 日 😀", ""]
    rows = [("c", f"http://s/{i}", "iri", "http://p", t, "literal", None, None) for i, t in enumerate(texts)]
    triples = spark.createDataFrame(rows, "crate_id string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string")
    assert [r["o"] for r in rdf.parse_ntriples(rdf.ntriples(triples)).orderBy("s").collect()] == texts
    line = r'<http://s/\u00E9> <http://p> "\u0041\U0001F600\b\f\'\\u0041\\\n"@en <http://g> . # end'
    got = rdf.parse_ntriples(spark.createDataFrame([("c", line)], "crate_id string, line string")).first()
    assert (got["s"], got["o"], got["lang"], got["datatype"]) == ("http://s/é", "A😀\b\f'\\u0041\\\n", "en", None)


def test_malformed_lines(spark):
    lines = spark.createDataFrame([("c", "garbage"), ("c", "# only a comment"), ("c", ""), ("c", "<http://s> <http://p> _:b ."), ("c", '<http://s> <http://p> "open .')], "crate_id string, line string")
    with pytest.raises(Exception, match="not a triple"):
        rdf.parse_ntriples(lines).collect()
    with pytest.raises(Exception, match="not a triple"):
        rdf.parse_ntriples(lines).select("s").collect()
    assert {r["line"] for r in rdf.malformed_lines(lines).collect()} == {"garbage", '<http://s> <http://p> "open .'}
    assert [(r["s"], r["o"], r["o_kind"]) for r in rdf.parse_ntriples(lines, strict=False).collect()] == [("http://s", "_:b", "blank")]


@pytest.mark.parametrize("line", [r'<http://s> <http://p> "x\qy" .', "<http://s s> <http://p> <http://o> .", "<http://s> <http://p> <http://o{}> .", r'<http://s> <http://p> "\u12" .', '<http://s> <http://p> "x"@1 .'])
def test_escapes_and_iris_that_are_none(spark, line):
    lines = spark.createDataFrame([("c", line)], "crate_id string, line string")
    assert rdf.malformed_lines(lines).count() == 1 and rdf.parse_ntriples(lines, strict=False).count() == 0


def test_blank_nodes_of_packages_stay_apart_in_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(c, "_:b", "blank", "http://p", o, k, None, None) for c in ("one", "two") for o, k in ((c, "literal"), ("_:b", "blank"))], "crate_id string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string")
    sinks.write_lines(rdf.ntriples(rdf.scoped_blanks(rows)), str(tmp_path / "all"))
    back = rdf.parse_ntriples(spark.read.text(str(tmp_path / "all")).select(F.lit("file").alias("crate_id"), F.col("value").alias("line"))).collect()
    assert len(back) == 4 and len({r["s"] for r in back}) == 2
    assert all(r["s"] == r["o"] for r in back if r["o_kind"] == "blank")


def test_booleans_and_mixed_lists_survive_rdf(spark):
    terms = spark.createDataFrame([("1.2", k, i) for k, i in TERMS.items()], "version string, term string, iri string")
    name = "http://h/c/ro-crate-metadata.json"
    lines = [f"<{name}> <http://schema.org/about> <http://h/c/> .", f"<http://h/c/> <{rdf.RDF_TYPE}> <http://schema.org/Dataset> ."]
    lines += [f'<http://h/c/> <http://schema.org/name> "{v}"^^<{rdf.XSD}boolean> .' for v in ("1",)] + [f'<http://h/c/> <http://x/mix> {v} .' for v in ('"text"', f'"2"^^<{rdf.XSD}integer>', f'"false"^^<{rdf.XSD}boolean>', "<http://h/c/>")]
    triples = rdf.parse_ntriples(spark.createDataFrame([("c", x) for x in lines], "crate_id string, line string"))
    t = rdf_import.import_packages(triples, terms)
    found = {(r["p"], r["o"], r["datatype"]) for r in rdf.export_triples(t.crates, t.entities, t.properties, terms, strict=False).filter("s = 'http://h/c/'").collect()}
    assert ("http://schema.org/name", "true", f"{rdf.XSD}boolean") in found
    assert {x[1:] for x in found if x[0] == "http://x/mix"} == {("text", None), ("2", f"{rdf.XSD}integer"), ("false", f"{rdf.XSD}boolean"), ("http://h/c/", None)}
    urn = t.crates.withColumn("base", F.lit("urn:uuid:0-0"))
    rows = {(r["key"], r["value"]) for r in frame.eav_frame(urn, t.context_items, t.entities, t.properties).filter("id = './'").collect()}
    assert ("name", "true") in rows


def test_members_of_mixed_lists_are_triples(spark, valued):
    terms = spark.createDataFrame([("1.1", k, i) for k, i in TERMS.items()], "version string, term string, iri string")
    rows = rdf.raw_triples(valued.entities, valued.properties).filter("s = '#e'").collect()
    assert {r["o"] for r in rows if r["p"] == "mix"} == {"1", "a", "#lic"}
    assert {r["o"] for r in rows if r["p"] == "holes"} == {"a"}
    assert not {r["p"] for r in rows} & {"flags", "yes", "none", "object", "inner", "deep"}
    assert terms.count() > 0


def test_unknown_contexts_are_told(spark):
    terms = spark.createDataFrame([("1.1", k, i) for k, i in TERMS.items()], "version string, term string, iri string")
    lost = Package.read_object(spark, document(context=[CONTEXT, "http://nowhere/ctx"]))
    with pytest.raises(Exception, match="unknown context: http://nowhere/ctx"):
        lost.triples(terms, base="http://h/").collect()
    assert lost.triples(terms, base="http://h/", strict=False).count() > 0
    known = spark.createDataFrame([("http://nowhere/ctx", "t", "http://t")], "url string, term string, iri string")
    assert lost.triples(terms, base="http://h/", contexts=known).count() > 0
    t = Package.read_object(spark, document({"@id": "#e", "@type": "Dataset", "isPartOf": {"@id": "two words"}}, context=[CONTEXT, "http://nowhere/ctx"])).tables
    got = {(r["name"], r["reason"]) for r in rdf.name_errors(t.crates, t.entities, t.properties, terms, "http://h/", t.context_items).collect()}
    assert got == {("http://nowhere/ctx", "unknown context"), ("two words", "not an IRI: http://h/two words")}


def test_places_that_raise_are_rows(spark):
    def transport(url, headers):
        if "broken" in url:
            raise OSError("no route")
        return remote.Response(200, [], document().encode()) if "good" in url else remote.Response(404, [], b"")

    urls = spark.createDataFrame([("http://good/x",), ("http://broken/x",), ("http://gone/x",)], "url string")
    got = {r["crate_id"]: (r["text"] is not None, r["reason"]) for r in remote.resolve_all(urls, transport, tries=2).collect()}
    assert got == {"http://good/x": (True, None), "http://broken/x": (False, "OSError: no route"), "http://gone/x": (False, "not found")}

    def fetch(url):
        if "broken" in url:
            raise ValueError("bad")

    assert {(r["crate_id"], r["reason"]) for r in sources.fetch_texts(urls, fetch).collect()} == {("http://good/x", "not found"), ("http://broken/x", "ValueError: bad"), ("http://gone/x", "not found")}


def test_two_parts_at_once(spark):
    t = Package.read_object(spark, document(hasPart=[{"@id": "a"}])).tables
    new = spark.createDataFrame([(t.crates.first()["crate_id"], "./", p) for p in ("c", "b", "a", "b")], "crate_id string, id string, part string")
    rows = edit.add_parts(t.entities, t.properties, new).filter("key = 'hasPart' AND depth = 0").collect()
    assert [r["ids"] for r in rows] == [["a", "b", "c"]]


def test_own_contexts(spark):
    terms = spark.createDataFrame([("1.1", k, i) for k, i in TERMS.items()], "version string, term string, iri string")
    own = {"name": "http://own/name", "ex": "http://ex/ns#", "@vocab": "http://vocab/", "@base": "http://base/c/"}
    package = Package.read_object(spark, document({"@id": "#e", "@type": "ex:Kind", "ex:p": 1, "plain": {"@id": "../up"}, "far": {"@id": "x"}}, context=[CONTEXT, "http://more/ctx", own]))
    known = contexts.Contexts({"http://more/ctx": json.dumps({"@context": ["http://next/ctx", {"far": {"@id": "http://far/p"}, "bad": 3}]}), "http://next/ctx": json.dumps({"far": "http://lost", "near": "http://near"})})
    assert known.terms("http://more/ctx") == {"far": "http://far/p", "near": "http://near"}
    with pytest.raises(contexts.MissingContext):
        known.terms("http://elsewhere")
    t = package.tables
    got = {(r["s"], r["p"], r["o"]) for r in rdf.export_triples(t.crates, t.entities, t.properties, terms, context_items=t.context_items, contexts=known.table(spark, ["http://more/ctx"])).collect()}
    e = "http://base/c#e"
    assert {x for x in got if x[0] == e} == {(e, rdf.RDF_TYPE, "http://ex/ns#Kind"), (e, "http://ex/ns#p", "1"), (e, "http://vocab/plain", "http://base/up"), (e, "http://far/p", "http://vocab/x")}
    assert ("http://base/c/", "http://own/name", "n") in got
    above = Package.read_object(spark, document({"@id": "#e", "@type": "Dataset", "isPartOf": {"@id": "../../up"}}, context=[CONTEXT, {"@base": "http://base/c/"}]))
    with pytest.raises(Exception, match="leads above"):
        above.triples(terms, strict=False).collect()
    bad = Package.read_object(spark, document({"@id": "#e", "@type": "Dataset", "isPartOf": {"@id": "two words"}}))
    with pytest.raises(Exception, match="not an IRI"):
        bad.triples(terms, base="http://h/").collect()
    assert bad.triples(terms, base="http://h/", strict=False).count() > 0


def test_dangling_references_and_turtle(spark):
    terms = spark.createDataFrame([("1.2", "schema", "http://schema.org/"), ("1.2", "name", "http://schema.org/name")], "version string, term string, iri string")
    rows = [("c", "http://s", "iri", "http://p", o, kind, None, None) for o, kind in (("http://s", "iri"), ("http://gone", "iri"), ("http://schema.org/Thing", "iri"), ("text", "literal"), ("_:b", "blank"))]
    rows.append(("c", "http://s", "iri", rdf.RDF_TYPE, "http://schema.org/Thing", "iri", None, None))
    triples = spark.createDataFrame(rows, "crate_id string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string")
    assert {r["dst"] for r in rdf.dangling_references(triples, terms).collect()} == {"http://gone", "_:b"}
    assert rdf.turtle(triples).first()["text"] == '<http://s> a <http://schema.org/Thing> ;\n    <http://p> "text", <http://gone>, <http://s>, <http://schema.org/Thing>, _:b .'


def test_nested_packages_are_fetched_once(spark, tmp_path):
    profile = {"@id": "https://w3id.org/ro/crate/1.1"}
    below = lambda *at: document(*({"@id": x, "@type": "Dataset", "conformsTo": profile} for x in at))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/ro-crate-metadata.json").write_text(below("http://a/"))
    sites = {"http://a/": below("http://b/", "sub/"), "http://b/": below("http://a/", "http://lost/")}
    transport = lambda url, headers: remote.Response(200, [], sites[url].encode()) if url in sites else remote.Response(404, [], b"")  # noqa: E731, ARG005
    found, asked = nested.fetch_nested(Package.read_object(spark, below("sub/")).tables, transport, str(tmp_path))
    assert sorted(r["crate_id"] for r in found.crates.collect()) == ["http://a/", "http://b/", "sub/"]
    assert {(r["url"], r["depth"], r["found"]) for r in asked.collect()} == {("sub/", 1, True), ("http://a/", 2, True), ("http://b/", 3, True), ("http://lost/", 4, False)}


def test_content_negotiation(spark):
    def transport(url, headers):
        if headers.get("Accept") == remote.ZIP_TYPE:
            return remote.Response(200, [("content-type", "application/zip")], sinks.zip_bytes(document(), {}))
        return remote.Response(406 if headers else 404, [], b"")

    assert remote.resolve("http://h/x", transport) == document()


def test_needles():
    assert [lookup.parse_needle(x) for x in ("42", "true", '"q"', '["a","b"]', "[1, 2]", '{"@id": "x"}', '{"b": "x", "a": 1}', 'say "hi"')] == [
        ("string", '"42"'), ("string", '"true"'), ("string", '"q"'), ("strings", '["a","b"]'), ("string", '"[1, 2]"'), ("id", '{"@id":"x"}'), ("object", '{"a":1,"b":"x"}'), ("string", '"say \\"hi\\""'),
    ]


def test_package_face(spark, tmp_path):
    terms = spark.createDataFrame([("1.1", "name", "http://schema.org/name")], "version string, term string, iri string")
    package = Package.read_object(spark, document(context=[CONTEXT, {"t": "http://t"}]))
    assert package.contexts() == [CONTEXT, "http://t"] and package.context_value("t") == "http://t" and package.urn_uuid() is None
    assert package.add_urn_uuid("7").urn_uuid() == "7"
    linked = package.set_links("#lic", "see", ["./", "#lic"]).set_links("#lic", "one", ["./"], single=True)
    assert linked.get_entity("#lic") == {"id": "#lic", "type": "CreativeWork", "name": "free", "one": {"@id": "./"}, "see": [{"@id": "./"}, {"@id": "#lic"}]}
    assert "see" not in linked.remove_field("#lic", "see").get_entity("#lic")
    assert [e["id"] for e in package.append("a", "File").append("a", "File").to_list()][-2:] == ["a", "a"]
    assert Package.report(spark, terms, text="{")["error_type"] == "JsonError"
    assert Package.report(spark, terms, path=f"{tmp_path}/none.json")["error_type"] == "IoError"
    assert Package.report(spark, terms, text=document(context="http://other"))["error_type"] == "SchemaError"
    assert Package.report(spark, terms, text=document()) == {"is_valid": True, "invalid_keys": [], "invalid_ids": [], "invalid_types": [], "error_type": None, "error_message": None}


def test_command_line(spark, tmp_path, capsys):
    from parcelgraph.__main__ import main

    at, out = f"{tmp_path}/m.json", f"{tmp_path}/out.json"
    (tmp_path / "m.json").write_text(document())
    main(["add-id-vec-values", at, "#lic", "see", "./,#x", out])
    assert {"@id": "#x"} in json.loads(open(out).read())["@graph"][2]["see"]
    main(["remove-field", out, "#lic", "see", out])
    assert "see" not in json.loads(open(out).read())["@graph"][2]
    main(["add-multiple", at, "#lic", out, "--set", "n", "int", " 7 ", "--set", "ok", "bool", "true", "--set", "n", "float", "1e3", "--set", "who", "ids", "#a, #b"])
    entity = json.loads(open(out).read())["@graph"][2]
    assert (entity["n"], entity["ok"], entity["who"]) == (1000.0, True, [{"@id": "#a"}, {"@id": "#b"}])
    with pytest.raises(ValueError, match="no value"):
        main(["add-multiple", at, "#lic", out, "--set", "n", "int", "seven"])
    log = tmp_path / "log.json"
    log.write_text("\n".join(json.dumps(e) for e in [{"seq": 1, "verb": "rename", "id": "#lic", "new_id": "#free"}, {"seq": 2, "verb": "set", "id": "#free", "key": "name", "tag": "string", "s": "other", "json": '"other"'}, {"seq": 3, "verb": "put", "id": "#new", "kind": "contextual", "types": ["Thing"]}]))
    main(["edit", at, str(log), out])
    graph = json.loads(open(out).read())["@graph"]
    assert graph[2]["@id"] == "#free" and graph[2]["name"] == "other" and graph[-1] == {"@id": "#new", "@type": "Thing"}
    main(["init", out, "--reference", "http://c.example/", "--term", "t", "http://t.example/"])
    assert json.loads(open(out).read())["@context"][1:] == ["http://c.example/", {"t": "http://t.example/"}]
    capsys.readouterr()
    main(["fields", at, "name"])
    assert len(capsys.readouterr().out.splitlines()) == 3


def test_zeros_keep_their_sign(spark):
    text = document({"@id": "#e", "@type": "Thing", "x": -0.0, "y": -0.05, "z": [-0.0, 1.5], "t": 'it is -0.0, \\":-0.0', "w": -0.25, "deep": {"v": -0.0}}).replace('"w": -0.25', '"w":-0.000')
    got = sources.parse(sources.from_texts(spark, {"c": text}))
    rows = {r.path: r for r in got.properties.filter("id = '#e'").collect()}
    assert {k: (rows[k].tag, str(rows[k].d), rows[k].json) for k in ("x", "y", "w", "deep/v")} == {"x": ("float", "-0.0", "-0.0"), "y": ("float", "-0.05", "-0.05"), "w": ("float", "-0.0", "-0.0"), "deep/v": ("float", "-0.0", "-0.0")}
    assert (rows["z"].tag, rows["z"].json) == ("floats", "[-0.0,1.5]") and rows["t"].s == 'it is -0.0, \\":-0.0'
    written = json.loads(sinks.documents(got, None).first().text)
    assert [str(e["x"]) for e in written["@graph"] if e["@id"] == "#e"] == ["-0.0"]


def test_packages_without_properties(spark):
    """What doesn't need properties is the same without them, and they are not read."""
    texts = sources.from_texts(spark, {"a": document({"@id": "#e", "@type": ["Thing", "File"], **VALUES}), "b": "{", "d": document({"@id": "x.csv"}), "e": "{}", "f": '{"@context":{},"@graph":[]}'})
    whole, bare = sources.parse(texts), sources.parse(texts, properties=False)
    rows = lambda df: sorted(map(str, df.collect()))
    for name in ("crates", "context_items", "entities", "rejects"):
        assert rows(getattr(whole, name)) == rows(getattr(bare, name)), name
    assert bare.properties is None and whole.properties.count() > 0


def test_some_columns_and_the_top_level(spark):
    """Tables of some columns, and of the top level alone, are what the whole table says there."""
    texts = sources.from_texts(spark, {"a": document({"@id": "#e", "@type": ["Thing", "File"], **VALUES, "deep": {"@id": "#in", "list": [1, {"x": [{"@id": "y"}, {"z": 2.0}]}]}})})
    whole = sources.parse(texts).properties
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(sources.parse(texts, "top").properties) == rows(whole.filter("depth = 0"))
    for columns in (("ids",), ("path", "json"), ("owner", "s")):
        some = sources.parse(texts, columns).properties
        assert set(some.columns) == {"crate_id", "pos", "id", "key", "depth", "origin", "tag", *columns} and rows(some) == rows(whole.select(*some.columns)), columns
