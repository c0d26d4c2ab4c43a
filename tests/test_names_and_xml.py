"""Names that stand for IRIs, and RDF/XML."""

from __future__ import annotations

import random
import re
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from parcelgraph.operators import rdf
from parcelgraph.plans.tables import TRIPLES
from parcelgraph.sources import sinks

NS = [f"http://{h}/{p}" for h in ("a", "b") for p in ("", "x/", "x/y#", "x/y/", "x/y/z/")]


def plain_name(iri, vocabulary, own):
    """The longest namespace of the terms that are not hidden, own ones first on a tie."""
    known = [(False, t, i) for t, i in vocabulary.items() if t not in own] + [(True, t, i) for t, i in own.items()]
    exact = [((not mine, t not in rdf.PREFERRED_TERMS, t), t) for mine, t, i in known if i == iri]
    if exact:
        return min(exact)[1]
    spaces = [((len(i), mine, t), t, i) for mine, t, i in known if i[-1] in "/#" and iri.startswith(i) and len(iri) > len(i)]
    if spaces:
        _, term, ns = max(spaces)
        return f"{term}:{iri[len(ns):]}"
    return iri


def test_names_take_the_longest_namespace_that_is_not_hidden(spark):
    r = random.Random(5)
    vocabulary = {"v1": NS[0], "v2": NS[3], "p1": NS[2], "contentUrl": NS[5] + "url", "url": NS[5] + "url", "long": NS[4]}
    contexts = {f"c{i}": {r.choice(["p1", "p2", "p3", "v2", "url"]): r.choice(NS + [NS[5] + "url", NS[1] + "t"]) for _ in range(3)} for i in range(25)} | {"none": {}}
    iris = {ns + rest for ns in NS for rest in ("", "t", "url", "q/r", "q#r/", "é/日", "/")} | {"urn:x", "", "/", "no"}
    rows = [("1.2", c, "http://base.example/", None, iri, k) for c in contexts for k, iri in enumerate(sorted(iris))]
    df = spark.createDataFrame(rows, "version string, ctx string, base string, vocab string, iri string, extra int")
    terms = spark.createDataFrame([("1.2", *x) for x in vocabulary.items()], "version string, term string, iri string")
    own = spark.createDataFrame([(c, *x) for c, named in contexts.items() for x in named.items()], "ctx string, term string, iri string")
    found = rdf.compact(df, terms, own)
    assert found.columns == [*df.columns, "name"]
    got = {(x["ctx"], x["iri"]): x["name"] for x in found.collect()}
    assert got == {(c, iri): plain_name(iri, vocabulary, named) for c, named in contexts.items() for iri in iris}
    again = rdf.expand(found.filter("iri LIKE 'http%'").withColumn("was", F.col("iri")).drop("iri"), terms, own=own)
    assert again.filter("iri <> was").isEmpty()
    lone = {x["iri"]: x["name"] for x in rdf.compact(df.filter("ctx = 'none'").drop("ctx"), terms).collect()}
    assert lone == {iri: plain_name(iri, vocabulary, {}) for iri in iris}
    beyond = {(x["ctx"], x["iri"]): x["name"] for x in _without_broadcast(lambda: rdf.compact(df, terms, own).collect())}
    assert beyond == got
    assert rdf.compact(df.filter("false"), terms, own).isEmpty()


def _without_broadcast(run):
    old, rdf.BROADCAST_TERMS = rdf.BROADCAST_TERMS, 0
    try:
        return run()
    finally:
        rdf.BROADCAST_TERMS = old


def read_xml(path):
    """Triples of documents that have an element for each subject."""
    q, found = f"{{{rdf.RDF}}}", set()
    for node in ElementTree.fromstring(Path(path).read_bytes()):
        s = node.get(f"{q}about") or "_:" + node.get(f"{q}nodeID")[1:]
        for e in node:
            p = re.sub(r"[{}]", "", e.tag)
            if e.get(f"{q}resource") is not None:
                found.add((s, p, e.get(f"{q}resource"), "iri", None, None))
            elif e.get(f"{q}nodeID"):
                found.add((s, p, "_:" + e.get(f"{q}nodeID")[1:], "blank", None, None))
            else:
                found.add((s, p, e.text or "", "literal", e.get(f"{q}datatype"), e.get("{http://www.w3.org/XML/1998/namespace}lang")))
    return found


def triple(s, p, o, kind="literal", datatype=None, lang=None):
    return ("c", s, "blank" if s.startswith("_:") else "iri", p, o, kind, datatype, lang)


def test_rdfxml_says_what_triples_say(spark, tmp_path):
    texts = ["", " a ", "<&>\"'", "two\nlines\r\n\ttab", "é日𝄞", "]]>", "&amp;"]
    rows = [triple(f"http://s/{i}?a=1&b=2", f"http://p.example/{v}", t) for i, t in enumerate(texts) for v in ("name", "x#é-1", "9lives", "a/b.c")]
    rows += [triple("_:1", "urn:n:p", "_:x.y", "blank"), triple("_:x.y", rdf.RDF_TYPE, "http://t/?q=\"'&", "iri"), triple("_:1", "http://p/n", "5", datatype=f"{rdf.XSD}integer"), triple("_:1", "http://p/n", "5", lang="en-GB"), triple("_:1", "http://p/n", "5")]
    df = spark.createDataFrame(rows * 2, TRIPLES).repartition(3)
    done = sinks.write_rdfxml(rdf.rdfxml(df), str(tmp_path / "out")).collect()
    assert sum(r["blocks"] for r in done) == len({r[1] for r in rows})
    assert sorted(r["path"] for r in done) == sorted(map(str, (tmp_path / "out").glob("part-*"))) and not [x for x in (tmp_path / "out").iterdir() if x.suffix != ".rdf"]
    assert set().union(*(read_xml(r["path"]) for r in done)) == {(r[1], r[3], r[4], r[5], r[6], r[7]) for r in rows}


def test_what_rdfxml_cannot_say(spark, tmp_path):
    bad = [triple("s:1", "http://p/1", "x"), triple("s:2", "name", "x"), triple("s:3", f"{rdf.RDF}li", "x"), triple("s:4", "http://p/ok", "a\x01"), triple("s:5", "http://p/", "x")]
    df = spark.createDataFrame([*bad, triple("s:6", "http://p/ok", "x")], TRIPLES)
    found = {r["s"]: r["reason"] for r in rdf.rdfxml_errors(df).collect()}
    assert found == {"s:1": "no XML name ends http://p/1", "s:2": "no XML name ends name", "s:3": f"syntax, no property: {rdf.RDF}li", "s:4": "a character that XML lacks", "s:5": "no XML name ends http://p/"}
    assert [r["s"] for r in rdf.rdfxml(df, strict=False).collect()] == ["s:6"]
    with pytest.raises(Exception, match="XML|syntax"):
        rdf.rdfxml(df).collect()
    assert sinks.write_rdfxml(rdf.rdfxml(df.filter("false")), str(tmp_path / "none")).isEmpty()
