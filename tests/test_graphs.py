"""Readers that spread one document over tasks, contexts that refer to contexts, long chains of links."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from parcelgraph.operators import reach
from parcelgraph.sources import contexts, large, packages, sinks, turtle
from parcelgraph.sources.ordered import read_pieces

PROFILE = "https://w3id.org/ro/crate/1.2"


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def entity(i, r):
    text = r.choice(["} { ][", '"@graph": [', 'a \\" b', "\\", "é日", "x" * 300, '{"@graph":['])
    return {"@id": f"#e{i}", "@type": "Thing" if i % 3 else ["Thing", "File"], "name": text, "more": {"@graph": [{"a": "}"}], "deep": {"x": [1, {"y": ["]"]}]}}, "n": i, "e": {}, "l": []}


def document(n, context=f"{PROFILE}/context", context_last=False, indent=None):
    r = random.Random(n)
    graph = [{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "conformsTo": {"@id": PROFILE}, "about": {"@id": "./"}}, {"@id": "./", "@type": "Dataset", "name": "n", "description": "d", "datePublished": "2024", "license": {"@id": "#l"}}]
    graph += [entity(i, r) for i in range(n)]
    return json.dumps({"@graph": graph, "@context": context} if context_last else {"@context": context, "@graph": graph}, indent=indent, ensure_ascii=bool(indent))


def test_documents_in_pieces_are_as_whole_ones(spark, tmp_path, small_blocks):
    extended = [f"{PROFILE}/context", {"t": "http://t", "@base": "http://b/}"}]
    files = {
        "plain": document(20), "last": document(12, context_last=True, indent=2), "only_fixed": document(0), "extended": document(8, extended, indent=1), "extended_last": document(5, extended, True) + "\n\n", "empty": '{"@context":"x","@graph":[ ]}',
        "none": document(5).replace('"n": 3', '"n": None'), "cut": document(5)[:-1], "cut_early": document(5)[:-40], "commas": document(5).replace('"n": 3', '"n": 3,,'), "text": "nonsense", "no_graph": json.dumps({"@context": "x"}), "no_comma": document(5).replace('}, {"@id": "#e2"', '} {"@id": "#e2"'),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert read_pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 10
    got, want = large.read_large(spark, str(tmp_path)), packages.parse(packages.from_texts(spark, files))
    name = F.regexp_extract("crate_id", r"([^/]+)\.json$", 1).alias("crate_id")
    for table in ("rejects", "crates", "context_items", "entities", "properties"):
        columns = [c for c in getattr(want, table).columns if c not in ("crate_id", "source", "reason")]
        rows = lambda df, crate: sorted(map(repr, df.select(crate, *columns).collect()))  # noqa: B023, E731
        assert rows(getattr(got, table), name) == rows(getattr(want, table), "crate_id"), table


TURTLE = r'''@prefix ex: <http://ex/> . # a comment . with "quotes" and \'\'\'
@base <http://base/dir/> .
PREFIX s: <http://schema.org/>
ex:a a s:Thing , ex:Kind ;
  s:name "short" , "lang"@en-GB, "typed"^^ex:t , 'single \'q\'' ;;
  s:text """long
text with " and "" and . ; [ ]
# not a comment
end""" , \'\'\'other """
long\'\'\' ;
  ex:n 1, -2.5 , 3e4, .5, true, false .
<#frag> ex:p <rel/path>, <../up>, <../../../root>, <?q=/a/../b>, <//host/x>, <> .
[] ex:q [ ex:r [ ex:deep "x" ] ; ex:r2 1 ] .
ex:l ex:items ( 1 ( ex:in ) () ) .
_:lab ex:p _:lab2 . _:lab2 ex:p ex:a.b.c .
@prefix ex: <http://other/> .
ex:z ex:esc\-aped\~x ex:%41b , "é\n" .
@base <sub/> .
<x> <y> <z>.'''.replace("\\'\\'\\'", "'''")
XSD, RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
EXPECTED = [
    ("http://ex/a", f"{RDF}type", "http://schema.org/Thing", None, None), ("http://ex/a", f"{RDF}type", "http://ex/Kind", None, None), ("http://ex/a", "http://schema.org/name", "short", None, None), ("http://ex/a", "http://schema.org/name", "lang", None, "en-GB"),
    ("http://ex/a", "http://schema.org/name", "typed", "http://ex/t", None), ("http://ex/a", "http://schema.org/name", "single 'q'", None, None), ("http://ex/a", "http://schema.org/text", 'long\ntext with " and "" and . ; [ ]\n# not a comment\nend', None, None),
    ("http://ex/a", "http://schema.org/text", 'other """\nlong', None, None), *(("http://ex/a", "http://ex/n", v, XSD + t, None) for v, t in (("1", "integer"), ("-2.5", "decimal"), ("3e4", "double"), (".5", "decimal"), ("true", "boolean"), ("false", "boolean"))),
    *(("http://base/dir/#frag", "http://ex/p", o, None, None) for o in ("http://base/dir/rel/path", "http://base/up", "http://base/root", "http://base/dir/?q=/a/../b", "http://host/x", "http://base/dir/")),
    ("_", "http://ex/q", "_", None, None), ("_", "http://ex/r", "_", None, None), ("_", "http://ex/deep", "x", None, None), ("_", "http://ex/r2", "1", f"{XSD}integer", None), ("http://ex/l", "http://ex/items", "_", None, None),
    ("_", f"{RDF}first", "1", f"{XSD}integer", None), ("_", f"{RDF}rest", "_", None, None), ("_", f"{RDF}first", "_", None, None), ("_", f"{RDF}rest", "_", None, None), ("_", f"{RDF}first", f"{RDF}nil", None, None), ("_", f"{RDF}rest", f"{RDF}nil", None, None), ("_", f"{RDF}first", "http://ex/in", None, None), ("_", f"{RDF}rest", f"{RDF}nil", None, None),
    ("_", "http://ex/p", "_", None, None), ("_", "http://ex/p", "http://ex/a.b.c", None, None), ("http://other/z", "http://other/esc-aped~x", "http://other/%41b", None, None), ("http://other/z", "http://other/esc-aped~x", "é\n", None, None), ("http://base/dir/sub/x", "http://base/dir/sub/y", "http://base/dir/sub/z", None, None),
]


def test_turtle_over_many_blocks(spark, tmp_path, small_blocks):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.ttl").write_text("@prefix ex: <http://b/> .\nex:a ex:b '''\n" + "line ; \"\"\" .\n" * 400 + "''' .\nex:a ex:c ex:d .")
    found = turtle.read_turtle(spark, str(tmp_path))
    bare = lambda kind, x: F.when(F.col(kind) == "blank", "_").otherwise(F.col(x)).alias(x)
    rows = found.select(F.col("crate_id").endswith("a.ttl").alias("first"), bare("s_kind", "s"), "p", bare("o_kind", "o"), "datatype", "lang").collect()
    assert sorted((tuple(r)[1:] for r in rows if r["first"]), key=repr) == sorted(EXPECTED, key=repr)
    assert {tuple(r)[1:4] for r in rows if not r["first"]} == {("http://b/a", "http://b/b", "\n" + 'line ; """ .\n' * 400), ("http://b/a", "http://b/c", "http://b/d")}


def test_statements_that_are_no_turtle(spark):
    cases = {
        "ex:a nope:b ex:c .": "unknown prefix: nope:b", "ex:a ex:b [ ex:c .": "brackets don't match", "ex:a ex:b ( ex:c ] .": "brackets don't match", "ex:a ex:b ex:c ex:d .": "no comma between objects", "ex:a ex:b , ex:c .": "a comma without an object", "ex:a ex:b ex:c, .": "a comma without an object",
        'ex:a "x" ex:c .': "a verb that is no IRI", '"x" ex:b ex:c .': "a subject that is a text", "ex:a ex:b .": "a verb without an object", "ex:a .": "a subject alone", "ex:a ex:b % .": "not Turtle: %", "ex:a ex:b ex:c ; .": None, "[ ex:b 1 ] .": None, "": None,
    }
    rows = [(text, 0, i, line) for text in cases for i, line in enumerate(["@prefix ex: <http://ex/> .", text])]
    lines = spark.createDataFrame(rows, "crate_id string, block long, n long, piece string")
    got = {r["crate_id"]: r["reason"] for r in turtle.malformed_statements(lines).collect()}
    assert got == {k: v for k, v in cases.items() if v}
    assert {r["crate_id"] for r in turtle.parse_turtle(lines, strict=False).collect()} == {"ex:a ex:b ex:c ; .", "[ ex:b 1 ] ."}
    with pytest.raises(Exception, match="unknown prefix"):
        turtle.parse_turtle(lines.filter("crate_id = 'ex:a nope:b ex:c .'")).collect()


def test_contexts_that_refer_to_contexts(spark):
    documents = {
        "a": {"@context": ["b", {"x": "a-x", "only": {"@id": "a-only"}, "@vocab": "v", "bad": 3}, "c"]}, "b": {"x": "b-x", "y": "b-y", "z": "b-z"}, "c": ["d", {"y": "c-y"}, "a", "gone"], "d": {"@context": {"z": "d-z", "y": "d-y"}}, "text": "c", "twice": [{"t": "1"}, {"t": "2"}],
    }
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()] + [("broken", "{")], "url string, text string")
    roots = spark.createDataFrame([("a",), ("text",), ("twice",), (f"{PROFILE}/context",), ("broken",), ("lost",)], "url string")
    terms, missing = contexts.close_contexts(roots, table)
    found: dict = {}
    for r in terms.collect():
        found.setdefault(r["url"], {})[r["term"]] = r["iri"]
    known = contexts.Contexts({k: json.dumps(v) for k, v in documents.items()} | {"gone": "{}"})
    assert found == {u: known.terms(u) for u in ("a", "text", "twice")}
    assert found["a"] == {"x": "a-x", "only": "a-only", "y": "c-y", "z": "d-z"} and found["twice"] == {"t": "2"}
    assert {tuple(r) for r in missing.collect()} == {("a", "gone"), ("text", "gone"), ("lost", "lost")}


def brute_reach(starts, edges):
    found, waiting = set(starts), list(starts)
    while waiting:
        at = waiting.pop()
        for s, d in edges:
            if s == at and d not in found:
                found.add(d)
                waiting.append(d)
    return found


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(reach, "written", lambda df, real=reach.written: rounds.append(1) or real(df))
    edges = [(str(i), str(i + 1)) for i in range(1000)] + [("x", "y"), ("y", "x"), ("500", "branch")]
    df = spark.createDataFrame([("c", s, d) for s, d in edges], "crate_id string, src string, dst string").coalesce(1)
    got = reach.reachable(spark.createDataFrame([("c", "0")], "crate_id string, id string"), df)
    assert {r["id"] for r in got.collect()} == {str(i) for i in range(1001)} | {"branch"} and got.count() == 1002
    assert len(rounds) <= 25


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(reach, "PLAIN_HOPS", 0)
    r = random.Random(seed)
    edges = [(str(i), str(i + 1)) for i in range(20)] + [(str(r.randrange(60)), str(r.randrange(60))) for _ in range(50)]
    df = spark.createDataFrame([("c", s, d) for s, d in edges] + [("other", "0", "9")], "crate_id string, src string, dst string").coalesce(1)
    got = [x["id"] for x in reach.reachable(spark.createDataFrame([("c", "0"), ("c", "30")], "crate_id string, id string"), df).collect()]
    assert sorted(got) == sorted(brute_reach(["0", "30"], edges))


def test_an_archive_of_many_files_is_compressed_by_many_tasks(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    contents = {f"deep/{i}.txt": random.Random(i).randbytes(50) * i for i in range(60)} | {"é 日.bin": b"x" * 3_000_000, "empty": b""}
    for name, content in contents.items():
        (source / name).write_bytes(content)
    files = sinks.listed_files(spark, spark.createDataFrame([("c", str(source))], "crate_id string, root string"))
    docs = spark.createDataFrame([("c", document(0)), ("alone", document(1))], "crate_id string, text string")
    packed = sinks._packed(sinks.archive_plan(files).select("crate_id", "entry", "path", F.lit(None).cast("string").alias("text")))
    assert packed.select("part").distinct().count() > 3
    rows = {r["crate_id"]: r for r in sinks.write_zips(docs, sinks.archive_plan(files), str(tmp_path / "out")).collect()}
    assert rows["c"]["n_entries"] == 63 and rows["alone"]["n_entries"] == 1
    with zipfile.ZipFile(rows["c"]["path"]) as z:
        assert z.testzip() is None and z.namelist()[0] == packages.METADATA_FILE
        assert {n: z.read(n) for n in z.namelist()[1:]} == contents
        assert z.read(packages.METADATA_FILE).decode() == document(0)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["alone.zip", "c.zip"]
