"""Queries that write package documents and graphs made from the test tables to files, and read the files back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.operators import edit, frame, rdf, rdf_import
from parcelgraph.plans.storage import new_folder, written
from parcelgraph.plans.views import table
from parcelgraph.registration import query
from parcelgraph.session import ship_package
from parcelgraph.sources import remote, sinks
from parcelgraph.sources.contexts import close_contexts
from parcelgraph.sources.large import read_large
from parcelgraph.sources.packages import METADATA_FILE
from parcelgraph.sources.turtle import malformed_statements, read_turtle

_PROFILE = "https://w3id.org/ro/crate"


def _joined(text: Column, *order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("text")))), lambda x: x["text"]), ",")


def _nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crate_id, path, text: a package for each nation with its customers as entities, whose texts hold brackets, quotes and keys."""
    entity = F.expr(r"""'{"@id":"#c-' || c_custkey || '","@type":' || CASE WHEN c_custkey % 2 = 0 THEN '"Person"' ELSE '["Person","Thing"]' END || ',"name":"' || c_name || ' } \\\" { [","note":"\\\\","balance":' || CAST(c_acctbal AS STRING)
        || ',"place":{"@id":"#n"},"more":{"@graph":[{"key":"}"}],"segment":{"name":"' || c_mktsegment || '"}},"none":{},"list":[1,{"x":"]"}]}'""")
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(_joined(entity, "c_custkey").alias("entities"))  # a nation's
    context = F.expr(f"""CASE WHEN c_nationkey % 2 = 0 THEN '"{_PROFILE}/1.1/context"' ELSE '["{_PROFILE}/1.2/context", {{"own":"http://own.example/}}"}}]' END""")
    head = f'{{"@id":"{METADATA_FILE}","@type":"CreativeWork","conformsTo":{{"@id":"{_PROFILE}/1.2"}},"about":{{"@id":"./"}}}},{{"@id":"./","@type":"Dataset","name":"n","description":"","datePublished":"","license":"CC0"}}'
    graph = F.concat(F.lit('"@graph" : [\n'), F.lit(head), F.lit(","), "entities", F.lit("]"))
    context = F.concat(F.lit('"@context": '), context)
    text = F.concat(F.lit("{"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(graph, F.lit(", "), context)).otherwise(F.concat(context, F.lit(",\n"), graph)), F.lit("}\n"))
    name = F.concat(F.lit("n-"), F.col("c_nationkey").cast("string"))
    return customers.select(name.alias("crate_id"), F.concat(name, F.lit(".json")).alias("path"), text.alias("text"))


def _nation() -> Column:
    """A package's name, from its file's."""
    return F.regexp_extract("crate_id", r"([^/]+)\.\w+$", 1).alias("crate_id")


def _read_nations(spark: SparkSession, sf_dir: str):
    ship_package(spark)
    folder = new_folder(spark)
    sinks.write_documents(_nation_documents(spark, sf_dir), folder).count()
    return read_large(spark, folder)


@query("SELECT 'n-' || c_nationkey AS crate_id, CAST(1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS pos, '#c-' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Person' ELSE 'Person,Thing' END AS types FROM customer")
def large_package_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of documents that are read in pieces: their places and types."""
    found = _read_nations(spark, sf_dir).entities.filter("kind = 'contextual'")
    return found.select(_nation(), "pos", "id", F.array_join("types", ",").alias("types"))


@query("""SELECT 'n-' || c_nationkey AS crate_id, '#c-' || c_custkey AS id, key, s, CASE WHEN key = 'balance' THEN c_acctbal END AS d FROM (SELECT *, unnest(['name', 'note', 'more/segment/name', 'balance', 'more/@graph[0]/key']) AS key FROM customer)
    CROSS JOIN LATERAL (SELECT CASE key WHEN 'name' THEN c_name || ' } " { [' WHEN 'note' THEN chr(92) WHEN 'more/segment/name' THEN c_mktsegment WHEN 'more/@graph[0]/key' THEN '}' END AS s)""")
def large_package_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of such entities, nested ones too."""
    found = _read_nations(spark, sf_dir).properties.filter("id LIKE '#c-%' AND path IN ('name', 'note', 'more/segment/name', 'balance', 'more/@graph[0]/key')")
    return found.select(_nation(), "id", F.col("path").alias("key"), "s", F.coalesce("d", F.col("i").cast("double")).alias("d"))


@query(f"SELECT 'n-' || c_nationkey AS crate_id, CASE WHEN c_nationkey % 2 = 0 THEN '1.1' ELSE '1.2' END AS schema_version, CASE WHEN c_nationkey % 2 = 0 THEN '{_PROFILE}/1.1/context' ELSE '{_PROFILE}/1.2/context,http://own.example/' || chr(125) END AS context FROM (SELECT DISTINCT c_nationkey FROM customer)")
def large_package_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such documents hold beside their graphs, before or behind them."""
    p = _read_nations(spark, sf_dir)
    items = p.context_items.groupBy("crate_id").agg(_joined(F.col("value"), "pos").alias("context"))
    return p.crates.join(items, "crate_id").select(_nation(), "schema_version", "context")


def _turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crate_id, path, text: a Turtle document for each nation, with a prefix that changes half-way, a base, long texts, lists and blank nodes."""
    block = F.expr(r''''c:' || c_custkey || ' a s:Person' || CASE WHEN c_custkey % 2 = 0 THEN ', s:Thing' ELSE '' END || ' ; # ' || c_name || ' . "' || chr(10)
        || '  s:name """' || c_name || chr(10) || 'second "line" ; . [' || chr(10) || '# third""" , \'' || c_mktsegment || '\'@en-GB ;;' || chr(10) || '  s:balance ' || CAST(CAST(c_acctbal AS DECIMAL(20, 2)) AS STRING) || ', "' || c_custkey || '"^^x:int ;'
        || ' s:near <#' || c_custkey || '>, <../up/' || c_custkey || '> ; s:place [ s:nation ' || c_nationkey || ' ; s:tags ( "a" c:' || c_custkey || ' ) ] .' || chr(10)''')
    half = F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1).alias("half")
    rows = table(spark, sf_dir, "customer").withColumn("block", block).groupBy("c_nationkey", half).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "block"))), lambda x: x["block"]), "").alias("blocks"))
    head = F.concat(F.lit("@prefix s: <http://schema.org/> .\nPREFIX x: <http://www.w3.org/2001/XMLSchema#>\n@base <http://base.example/n/"), F.col("c_nationkey").cast("string"), F.lit("/> .\n@prefix c: <http://even.example/> .\n"))
    first, second = (F.coalesce(F.max(F.when(F.col("half") == i, F.col("blocks"))), F.lit("")) for i in (0, 1))
    docs = rows.groupBy("c_nationkey").agg(first.alias("first"), second.alias("second"))
    name = F.concat(F.lit("n-"), F.col("c_nationkey").cast("string"))
    return docs.select(name.alias("crate_id"), F.concat(name, F.lit(".ttl")).alias("path"), F.concat(head, "first", F.lit("@prefix c: <http://odd.example/> .\n"), "second").alias("text"))


_T = "SELECT {s} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind, {d} AS datatype, {l} AS lang FROM k"


def _t(p: str, o: str, k: str, d: str = "NULL", lang: str = "NULL", s: str = "me") -> str:
    return _T.format(s=s, p=p if p.startswith("http") else f"http://schema.org/{p}", o=o, k=k, d=d, l=lang)


_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XSD = rdf.XSD
_TURTLE = "WITH k AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'http://even.example/' ELSE 'http://odd.example/' END || c_custkey AS me FROM customer) " + " UNION ALL ".join([
    _t(rdf.RDF_TYPE, "'http://schema.org/Person'", "iri"), _t(rdf.RDF_TYPE, "'http://schema.org/Thing'", "iri") + " WHERE c_custkey % 2 = 0",
    _t("name", "c_name || chr(10) || 'second \"line\" ; . [' || chr(10) || '# third'", "literal"), _t("name", "c_mktsegment", "literal", lang="'en-GB'"),
    _t("balance", "CAST(CAST(c_acctbal AS DECIMAL(20, 2)) AS VARCHAR)", "literal", f"'{_XSD}decimal'"), _t("balance", "CAST(c_custkey AS VARCHAR)", "literal", f"'{_XSD}int'"),
    _t("near", "'http://base.example/n/' || c_nationkey || '/#' || c_custkey", "iri"), _t("near", "'http://base.example/n/up/' || c_custkey", "iri"), _t("place", "'blank'", "blank"),
    _t("nation", "CAST(c_nationkey AS VARCHAR)", "literal", f"'{_XSD}integer'", s="'blank'"), _t("tags", "'blank'", "blank", s="'blank'"),
    _t(f"{_RDF}first", "'a'", "literal", s="'blank'"), _t(f"{_RDF}first", "me", "iri", s="'blank'"), _t(f"{_RDF}rest", "'blank'", "blank", s="'blank'"), _t(f"{_RDF}rest", f"'{_RDF}nil'", "iri", s="'blank'"),
])


@query(_TURTLE)
def turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle documents with all that statements can hold, written and read; blank nodes without their labels."""
    ship_package(spark)
    folder = new_folder(spark)
    sinks.write_documents(_turtle_documents(spark, sf_dir), folder).count()
    bare = lambda kind, x: F.when(F.col(kind) == "blank", "blank").otherwise(F.col(x)).alias(x)
    return read_turtle(spark, folder).select(bare("s_kind", "s"), "p", bare("o_kind", "o"), "o_kind", "datatype", "lang")


@query("SELECT c_custkey % 7 AS way, count(*) AS n, CASE c_custkey % 7 WHEN 0 THEN 'unknown prefix: no:p' WHEN 1 THEN 'a verb that is no IRI' WHEN 2 THEN 'brackets don''t match' WHEN 3 THEN 'no comma between objects' WHEN 4 THEN 'a verb without an object' WHEN 5 THEN 'not Turtle: %' END AS reason FROM customer WHERE c_custkey % 7 < 6 GROUP BY ALL")
def malformed_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with mistakes of six kinds, told one by one; those of a seventh kind are right."""
    rest = F.expr("""CASE c_custkey % 7 WHEN 0 THEN 'no:p "x"' WHEN 1 THEN '"p" "x"' WHEN 2 THEN '<p:q> [ <p:q> 1' WHEN 3 THEN '<p:q> 1 2' WHEN 4 THEN '<p:q>' WHEN 5 THEN '<p:q> %' ELSE '<p:q> (1 2)' END""")
    line = F.concat(F.lit("<c:"), F.col("c_custkey").cast("string"), F.lit("> "), rest, F.when(F.col("c_custkey") % 7 == 5, "\n").otherwise(" ."))
    # Each customer's line is a document, so that a statement without its end spoils no other.
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("crate_id"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n"), F.regexp_replace(line, "\n", "").alias("piece"))
    found = malformed_statements(lines)
    way = F.substring("crate_id", 3, 20).cast("long") % 7
    return found.groupBy(way.alias("way"), "reason").agg(F.count("*").alias("n"))


@query("SELECT s, p, o, o_kind, datatype FROM (SELECT 'http://c.example/' || c_custkey AS s, 'http://p.example/name' AS p, c_name || chr(10) || c_mktsegment AS o, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM customer UNION ALL SELECT 'http://c.example/' || c_custkey, 'http://p.example/nation', 'http://n.example/' || c_nationkey, 'iri', NULL FROM customer UNION ALL SELECT 'http://c.example/' || c_custkey, '" + rdf.RDF_TYPE + "', 'http://schema.org/Person', 'iri', NULL FROM customer)")
def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that the Turtle writer makes, in as many files as tasks, read back."""
    c = table(spark, sf_dir, "customer")
    s = F.concat(F.lit("http://c.example/"), F.col("c_custkey").cast("string"))
    row = lambda p, o, kind: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    said = F.array(row("http://p.example/name", F.concat("c_name", F.lit("\n"), "c_mktsegment"), "literal"), row("http://p.example/nation", F.concat(F.lit("http://n.example/"), F.col("c_nationkey").cast("string")), "iri"), row(rdf.RDF_TYPE, F.lit("http://schema.org/Person"), "iri"))
    null = F.lit(None).cast("string")
    triples = c.select(F.lit("c").alias("crate_id"), s.alias("s"), F.lit("iri").alias("s_kind"), F.explode(said).alias("x")).select("crate_id", "s", "s_kind", "x.*", null.alias("datatype"), null.alias("lang"))
    folder = new_folder(spark)
    rdf.turtle(triples).select("text").write.text(folder)
    return read_turtle(spark, folder).select("s", "p", "o", "o_kind", "datatype")


@query("SELECT 'c-' || c_custkey AS crate_id, 'http://ctx.example/' || c_custkey % 4 AS url FROM customer WHERE c_custkey % 4 > 1")
def unknown_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to contexts that nobody has given; those of the profile and two others are known."""
    key = F.col("c_custkey")
    urls = F.array(F.lit(f"{_PROFILE}/1.2/context"), F.concat(F.lit("http://ctx.example/"), (key % 4).cast("string")))
    items = table(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), key.cast("string")).alias("crate_id"), F.posexplode(urls).alias("pos", "value")).withColumns({"kind": F.lit("reference"), "key": F.lit(None).cast("string")})
    contexts = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.concat(F.lit("http://ctx.example/"), F.col("r_regionkey").cast("string")).alias("url"), F.lit("t").alias("term"), F.lit("http://t").alias("iri"))
    return rdf.unknown_references(items, contexts)


def _context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, text: a context for each customer, which refers to its nation's, some to one that is nowhere; nations refer to a region's, and regions back to nations."""
    c, n, r = (table(spark, sf_dir, name) for name in ("customer", "nation", "region"))
    of_customer = F.expr("""'{"@context":["https://w3id.org/ro/crate/1.2/context","http://ctx.example/n/' || c_nationkey || '",' || CASE WHEN c_custkey % 7 = 0 THEN '"http://ctx.example/lost/' || c_custkey % 3 || '",' ELSE '' END || '{"level":"http://c.example/' || c_custkey || '","@vocab":"http://v","none":null}]}'""")
    of_nation = F.expr("""'["http://ctx.example/r/' || n_regionkey || '",{"level":"http://n.example/' || n_nationkey || '","shared":{"@id":"http://n.example/shared/' || n_nationkey || '"},"twice":"http://lost"},{"twice":"http://n.example/twice"}]'""")
    of_region = F.expr("""'{"@context":[{"level":"http://r.example","shared":"http://r.example/shared","zone":"http://r.example/' || r_name || '"},"http://ctx.example/n/' || r_regionkey || '"]}'""")
    url = lambda kind, key: F.concat(F.lit(f"http://ctx.example/{kind}/"), F.col(key).cast("string")).alias("url")
    return c.select(url("c", "c_custkey"), of_customer.alias("text")).unionByName(n.select(url("n", "n_nationkey"), of_nation.alias("text"))).unionByName(r.select(url("r", "r_regionkey"), of_region.alias("text")))


@query("SELECT 'http://ctx.example/c/' || c_custkey AS url, term, CASE term WHEN 'level' THEN 'http://c.example/' || c_custkey WHEN 'shared' THEN 'http://n.example/shared/' || c_nationkey WHEN 'twice' THEN 'http://n.example/twice' ELSE 'http://r.example/' || r_name END AS iri FROM (SELECT *, unnest(['level', 'shared', 'twice', 'zone']) AS term FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)")
def context_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of contexts that refer to contexts, outer ones before inner ones, cycles and all."""
    documents = _context_documents(spark, sf_dir)
    return close_contexts(documents.select("url").filter("url LIKE '%/c/%'"), documents)[0]


@query("SELECT 'http://ctx.example/c/' || c_custkey AS url, 'http://ctx.example/lost/' || c_custkey % 3 AS missing FROM customer WHERE c_custkey % 7 = 0")
def missing_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts behind contexts that are nowhere, for each context that leads to them."""
    documents = _context_documents(spark, sf_dir)
    return close_contexts(documents.select("url").filter("url LIKE '%/c/%'"), documents)[1]


def _said(url: str, headers: dict[str, str]) -> remote.Response:  # noqa: ARG001
    """A transport for documents that are in the address: some places raise, some have nothing."""
    kind, _, text = url.removeprefix("data:").partition(",")
    if kind == "broken":
        raise OSError(f"no route to {text}")
    return remote.Response(200 if kind == "ok" else 404, [], b'{"@graph":["' + text.encode() + b'"]}')


@query("SELECT 'data:' || kind || ',' || c_custkey AS url, CASE kind WHEN 'ok' THEN '{\"@graph\":[\"' || c_custkey || '\"]}' END AS text, CASE kind WHEN 'broken' THEN 'OSError: no route to ' || c_custkey WHEN 'lost' THEN 'not found' END AS reason FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'broken' ELSE 'lost' END AS kind FROM customer)")
def fetch_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that raise are rows with a reason, and others are fetched all the same."""
    ship_package(spark)
    m = F.col("c_custkey") % 3
    urls = table(spark, sf_dir, "customer").select(F.concat(F.lit("data:"), F.when(m == 0, "ok").when(m == 1, "broken").otherwise("lost"), F.lit(","), F.col("c_custkey").cast("string")).alias("url"))
    return remote.resolve_all(urls, _said, tries=2).select(F.col("crate_id").alias("url"), "text", "reason")


@query("SELECT 'c-' || c_custkey AS crate_id, list_aggregate(list_concat(CASE WHEN c_custkey % 2 = 0 THEN ['zz'] ELSE [] END, coalesce(parts, [])), 'string_agg', ',') AS parts FROM customer LEFT JOIN (SELECT o_custkey, list('o-' || o_orderkey ORDER BY 'o-' || o_orderkey) AS parts FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 OR parts IS NOT NULL")
def added_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer become parts of its root at once; half of the roots have a list already."""
    name = F.concat(F.lit("c-"), F.col("c_custkey").cast("string"))
    crates = table(spark, sf_dir, "customer").select(name.alias("crate_id"), F.col("c_custkey").alias("key"))
    entities = crates.select("crate_id", F.lit(1).alias("pos"), F.lit("./").alias("id"), F.lit("root").alias("kind"))
    null = lambda kind: F.lit(None).cast(kind)
    properties = crates.filter("key % 2 = 0").select(
        "crate_id", F.lit(1).alias("pos"), F.lit("./").alias("id"), F.lit("hasPart").alias("key"), F.lit("hasPart").alias("path"), F.lit(0).alias("depth"), F.lit("dynamic").alias("origin"), F.lit("./").alias("owner"), F.lit("ids").alias("tag"),
        null("string").alias("s"), null("bigint").alias("i"), null("double").alias("d"), F.array(F.lit("zz")).alias("ids"), null("array<string>").alias("items"), null("string").alias("json"),
    )
    new = table(spark, sf_dir, "orders").select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("crate_id"), F.lit("./").alias("id"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("part"))
    return edit.add_parts(entities, properties, new).select("crate_id", F.array_join("ids", ",").alias("parts"))


@query("SELECT 'c-' || c_custkey AS uuid, CASE WHEN c_custkey % 3 = 2 THEN 'false' ELSE 'true' END AS value FROM customer")
def boolean_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans of N-Triples, in two spellings, in packages, in triples again and in the frame of those."""
    key = F.col("c_custkey").cast("string")
    home = F.concat(F.lit("http://h.example/"), key, F.lit("/"))
    about, flag = (F.concat(F.lit("<"), home, F.lit(x)) for x in (f"{METADATA_FILE}> <http://schema.org/about> <", "> "))
    m = F.col("c_custkey") % 3
    value = F.when(m == 0, "true").when(m == 1, "1").otherwise("false")
    lines = F.array(F.concat(about, home, F.lit("> .")), F.concat(flag, F.lit(f"<{rdf.RDF_TYPE}> <http://schema.org/Dataset> .")), F.concat(flag, F.lit('<http://p.example/flag> "'), value, F.lit(f'"^^<{_XSD}boolean> .')))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), key).alias("crate_id"), F.explode(lines).alias("line"))
    terms = spark.range(1).select(F.lit("1.2").alias("version"), F.lit("schema").alias("term"), F.lit("http://schema.org/").alias("iri"))
    once = rdf_import.import_packages(rdf.parse_ntriples(rows), terms)
    again = written(rdf.export_triples(once.crates, once.entities, once.properties, terms, strict=False))
    twice = rdf_import.import_packages(again.filter("o <> '' AND p <> 'conformsTo'"), terms)
    crates = twice.crates.withColumn("base", F.concat(F.lit("urn:uuid:"), "crate_id"))
    return frame.eav_frame(crates, twice.context_items, twice.entities, twice.properties).filter("key = 'http://p.example/flag'").select("uuid", "value")
