"""Queries over metadata packages, by name, each with the SQL that gives the same rows.

The test tables hold no packages, so ``plans.views`` reads them as such; each
query applies an operator to whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph import edit_queries, graph_queries, package_queries  # noqa: F401, which register their own
from parcelgraph.functions.links import is_not_url
from parcelgraph.functions.values import kind, schema_version
from parcelgraph.operators import counts, edit, frame, lookup, rdf, reach, validate
from parcelgraph.plans import views
from parcelgraph.plans.storage import new_folder
from parcelgraph.plans.tables import CONTEXT_ITEMS, PROPERTIES
from parcelgraph.plans.views import entity_id, table
from parcelgraph.registration import QUERIES, SQL, Query, query
from parcelgraph.sources import sinks
from parcelgraph.sources.packages import flatten

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Parts of SQL that several queries share: the entities and properties of views.py.
_NUMBER = lambda x: f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
_ENTITIES = {
    "region": "SELECT r_regionkey AS pos, '#region-' || r_regionkey AS id, 'Place' AS type FROM region",
    "nation": "SELECT n_nationkey AS pos, '#nation-' || n_nationkey AS id, 'Place' AS type FROM nation",
    "customer": "SELECT c_custkey AS pos, '#customer-' || c_custkey AS id, 'Person' AS type FROM customer",
    "orders": "SELECT o_orderkey AS pos, '#order-' || o_orderkey AS id, 'Order' AS type FROM orders",
}
_LINKS = {
    "nation": "SELECT '#nation-' || n_nationkey AS src, 'containedInPlace' AS key, '#region-' || n_regionkey AS dst FROM nation",
    "customer": "SELECT '#customer-' || c_custkey AS src, 'nationality' AS key, '#nation-' || c_nationkey AS dst FROM customer",
    "orders": "SELECT '#order-' || o_orderkey AS src, 'customer' AS key, '#customer-' || o_custkey AS dst FROM orders",
}


def _values_sql(*names: str) -> str:
    """src, key, value of text and number columns."""
    parts = []
    for name in names:
        kind_, key, _, texts, numbers, _ = views.SHAPES[name]
        parts += [f"SELECT '#{kind_}-' || {key} AS src, '{c}' AS key, {c} AS value FROM {name}" for c in texts]
        parts += [f"SELECT '#{kind_}-' || {key} AS src, '{c}' AS key, {_NUMBER(c)} AS value FROM {name}" for c in numbers]
    return " UNION ALL ".join(parts)


def _union(parts: dict[str, str], *names: str) -> str:
    return " UNION ALL ".join(parts[n] for n in names)


@query("SELECT '#event-' || event_id AS id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def field_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.field_value_counts(flatten(views.event_documents(spark, sf_dir)), "k")


@query("WITH hit AS (SELECT '#customer-' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING') SELECT id, 'BUILDING' AS value, count(*) AS n FROM (SELECT id FROM hit UNION ALL SELECT 'N/A' FROM hit) GROUP BY id")
def value_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.value_search_counts(views.properties(spark, sf_dir, "customer"), "BUILDING")


@query("SELECT DISTINCT key FROM (" + _values_sql("region", "nation", "customer", "orders") + " UNION ALL SELECT src, key, dst FROM (" + _union(_LINKS, "nation", "customer", "orders") + "))")
def property_keys_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.property_keys(views.properties(spark, sf_dir, "region", "nation", "customer", "orders"))


@query("SELECT 'shop' AS crate_id, CAST(c_custkey AS INTEGER) AS pos, '#customer-' || c_custkey AS id, 'string' AS tag, '\"' || c_mktsegment || '\"' AS json FROM customer")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "customer")
    return lookup.property_values(views.entities(spark, sf_dir, *names), views.properties(spark, sf_dir, *names), "c_mktsegment")


@query("SELECT 'shop' AS crate_id, CAST(min(pos) AS INTEGER) AS pos, id, 'contextual' AS kind, min(type) AS types FROM (" + _union(_ENTITIES, "nation", "customer", "customer") + ") WHERE id = '#customer-7' GROUP BY id")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.first_entity(views.entities(spark, sf_dir, "nation", "customer", "customer"), "#customer-7")
    return found.select("crate_id", "pos", "id", "kind", F.array_join("types", ",").alias("types"))


@query("SELECT 'shop' AS crate_id, CAST(min(pos) AS INTEGER) AS pos FROM (" + _union(_ENTITIES, "nation", "customer") + ") WHERE id = '#customer-11'")
def entity_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.entity_index(views.entities(spark, sf_dir, "nation", "customer"), "#customer-11")


@query("SELECT 'shop' AS crate_id, CAST(c_custkey AS INTEGER) AS pos, '#customer-' || c_custkey AS id, 'c_mktsegment' AS key FROM customer WHERE c_mktsegment = 'MACHINERY'")
def find_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.entities_with_value(views.properties(spark, sf_dir, "customer"), "MACHINERY")


@query("SELECT DISTINCT crate_id, src, dst FROM (SELECT 'shop' AS crate_id, src, dst FROM (" + _union(_LINKS, "nation", "customer", "orders") + ") UNION ALL SELECT '#order-' || l_orderkey, './', '#line-' || l_orderkey || '-' || l_linenumber FROM lineitem)")
def linked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = lookup.edges(views.properties(spark, sf_dir, "nation", "customer", "orders"))
    return lookup.linked_ids(links.unionByName(views.order_parts(spark, sf_dir)))


@query("SELECT DISTINCT 'shop' AS crate_id, dst FROM (" + _union(_LINKS, "nation", "customer", "orders") + ") AS l WHERE NOT EXISTS (SELECT 1 FROM (" + _union(_ENTITIES, "nation", "customer", "orders") + ") AS e WHERE e.id = l.dst)")
def dangling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "customer", "orders")
    return validate.dangling_ids(views.entities(spark, sf_dir, *names), lookup.edges(views.properties(spark, sf_dir, *names)))


def _terms(spark: SparkSession, *names: str) -> DataFrame:
    """A vocabulary of these names."""
    return spark.createDataFrame([("1.2", n, f"http://schema.org/{n}") for n in names], "version string, term string, iri string")


@query("SELECT DISTINCT 'shop' AS crate_id, key FROM (" + _values_sql("customer") + " UNION ALL " + _LINKS["customer"] + ") WHERE key NOT IN ('c_name', 'nationality', 'c_mktsegment')")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    crates = spark.createDataFrame([(views.SHOP, "1.2")], "crate_id string, schema_version string")
    own = spark.createDataFrame([(views.SHOP, 1, "embedded", "c_mktsegment", "http://example.org/segment")], "crate_id string, pos int, kind string, key string, value string")
    return validate.unknown_keys(crates, views.properties(spark, sf_dir, "customer"), own, _terms(spark, "c_name", "nationality"))


@query("""WITH bad AS (SELECT l_orderkey, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT l_orderkey, '#line-' || l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_linenumber > 4) GROUP BY l_orderkey)
SELECT '#order-' || o_orderkey AS crate_id, CASE WHEN ids IS NULL THEN 'valid' ELSE 'invalid' END AS status, '' AS invalid_keys, coalesce(ids, '') AS invalid_ids FROM orders LEFT JOIN bad ON l_orderkey = o_orderkey""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages whose entities are their first four line items, linked to all of them."""
    crates = table(spark, sf_dir, "orders").select(entity_id("order", "o_orderkey").alias("crate_id"), F.lit("1.2").alias("schema_version"))
    parts = views.order_parts(spark, sf_dir)
    entities = parts.filter(F.regexp_extract("dst", r"-(\d+)$", 1).cast("int") <= 4).select("crate_id", F.col("dst").alias("id"))
    links = parts.select("crate_id", F.lit(1).alias("pos"), F.col("src").alias("id"), "key", F.col("key").alias("path"), F.lit(0).alias("depth"), "origin", F.lit("id").alias("tag"), F.lit(None).cast("string").alias("s"), F.array("dst").alias("ids"))
    none = spark.createDataFrame([], "crate_id string, pos int, kind string, key string, value string")
    report = validate.validation_report(crates, entities, links, none, _terms(spark, "hasPart"))
    return report.select("crate_id", "status", F.array_join("invalid_keys", ",").alias("invalid_keys"), F.array_join("invalid_ids", ",").alias("invalid_ids"))


_PART_ID = "CASE WHEN p_partkey = 1 THEN './' WHEN p_partkey = 2 THEN 'ro-crate-metadata.json' WHEN p_partkey % 5 = 0 THEN '#part-' || p_partkey ELSE 'part-' || p_partkey END"
_PART_TYPE = "CASE p_size % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'Dataset' ELSE 'Person' END"


@query(f"SELECT id, CASE WHEN id = 'ro-crate-metadata.json' THEN 'descriptor' WHEN id = './' THEN 'root' WHEN id NOT LIKE '#%' AND type IN ('File', 'Dataset') THEN 'data' ELSE 'contextual' END AS kind FROM (SELECT {_PART_ID} AS id, {_PART_TYPE} AS type FROM part)")
def entity_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.expr(_PART_ID).alias("id"), F.array(F.expr(_PART_TYPE), F.lit(None).cast("string")).alias("types"))
    return rows.select("id", kind(F.col("id"), F.col("types")).alias("kind"))


@query("SELECT 'k' AS key, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'null_bool' ELSE 'object' END AS tag, count(*) AS n FROM events WHERE json_type(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def value_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(views.event_documents(spark, sf_dir)).groupBy("key", "tag").agg(F.count("*").alias("n"))


_UUID = "01890a5d-ac96-774b-bcce-b302099a8057"


@query(
    f"SELECT '{_UUID}' AS uuid, id, key, value FROM (SELECT '@context' AS id, '@base' AS key, 'urn:uuid:{_UUID}' AS value UNION ALL SELECT '@graph', '@id', id FROM (" + _union(_ENTITIES, "nation", "customer")
    + ") UNION ALL SELECT id, '@type', type FROM (" + _union(_ENTITIES, "nation", "customer") + ") UNION ALL SELECT src, key, dst FROM (" + _union(_LINKS, "nation", "customer") + ") UNION ALL " + _values_sql("nation", "customer") + ")"
)
def eav_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "customer")
    crates = spark.createDataFrame([(views.SHOP, f"urn:uuid:{_UUID}")], "crate_id string, base string")
    context = spark.createDataFrame([(views.SHOP, 1, "embedded", "@base", f"urn:uuid:{_UUID}")], "crate_id string, pos int, kind string, key string, value string")
    return frame.eav_frame(crates, context, views.entities(spark, sf_dir, *names), views.properties(spark, sf_dir, *names))


@query(f"SELECT '{_UUID}' AS uuid, '@graph' AS id, '@id' AS key, '#part-' || p_partkey AS value FROM part UNION ALL SELECT '{_UUID}', '#part-' || p_partkey, '@type', unnest([p_type, p_brand]) FROM part")
def eav_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of two types and without properties."""
    crates = spark.createDataFrame([("parts", f"urn:uuid:{_UUID}")], "crate_id string, base string")
    parts = table(spark, sf_dir, "part").select(F.lit("parts").alias("crate_id"), entity_id("part", "p_partkey").alias("id"), F.array("p_type", "p_brand").alias("types"))
    none = lambda columns: spark.createDataFrame([], columns)
    return frame.eav_frame(crates, none(CONTEXT_ITEMS), parts, none(PROPERTIES))


# Of each text whether it is no URL, as the URL standard says and not by a pattern: the pages' addresses are URLs, ids and paths are none.
_LOCATIONS = "SELECT url AS s, false AS not_url FROM pages UNION ALL SELECT '#customer-' || c_custkey, true FROM customer UNION ALL SELECT 'data/part-' || p_partkey || '.csv', true FROM part UNION ALL SELECT * FROM (VALUES ('http://a b', true), ('C:/x', true), ('./y', true), ('_:b1', true), ('', true), ('file:///z', true), ('s3://bucket/key', false), ('mailto:a@example.org', false), ('~/x', true), ('https://[::1]:80/x', false), ('http://', true), ('x-y+z.1:q', false), ('1x:q', true))"


@query(_LOCATIONS)
def not_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "pages").select(F.col("url").alias("s")).unionByName(table(spark, sf_dir, "customer").select(entity_id("customer", "c_custkey").alias("s")))
    texts = texts.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("data/part-"), F.col("p_partkey"), F.lit(".csv")).alias("s")))
    fixed = spark.createDataFrame([(x,) for x in ("http://a b", "C:/x", "./y", "_:b1", "", "file:///z", "s3://bucket/key", "mailto:a@example.org", "~/x", "https://[::1]:80/x", "http://", "x-y+z.1:q", "1x:q")], "s string")
    return texts.unionByName(fixed).select("s", is_not_url(F.col("s")).alias("not_url"))


@query("SELECT url AS id, url AS stored FROM pages UNION ALL SELECT '#customer-' || c_custkey, 's3://store/#customer-' || c_custkey FROM customer")
def object_store_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "pages").select(F.col("url").alias("id")).unionByName(views.entities(spark, sf_dir, "customer").select("id"))
    return ids.select("id", edit.object_store_id(F.col("id"), "s3://store/").alias("stored"))


@query("SELECT '#order-' || o_orderkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '#client-' || o_custkey ELSE '#customer-' || o_custkey END AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def rename_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    names = customers.select(F.lit(views.SHOP).alias("crate_id"), entity_id("customer", "c_custkey").alias("old"), entity_id("client", "c_custkey").alias("new"))
    _, rows = edit.rename(views.entities(spark, sf_dir, "customer", "orders"), views.properties(spark, sf_dir, "orders"), names)
    return rows.filter("key = 'customer'").select("id", F.element_at("ids", 1).alias("customer"))


@query("SELECT src AS id, key FROM (" + _values_sql("orders") + " UNION ALL " + _LINKS["orders"] + ") WHERE NOT (key = 'customer' AND value IN (SELECT '#customer-' || c_custkey FROM customer WHERE c_acctbal < 0))")
def remove_entity_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.lit(views.SHOP).alias("crate_id"), entity_id("customer", "c_custkey").alias("id"))
    return edit.remove_links(views.properties(spark, sf_dir, "orders"), gone).select("id", "key")


@query("SELECT id, CASE WHEN id IN (SELECT '#customer-' || c_custkey FROM customer WHERE c_nationkey < 4) THEN 'Organization' ELSE type END AS types FROM (" + _ENTITIES["customer"] + ") UNION ALL SELECT '#customer-new-' || c_custkey, 'Organization' FROM customer WHERE c_nationkey < 4")
def upsert_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").filter("c_nationkey < 4")
    ids = some.select(entity_id("customer", "c_custkey").alias("id")).unionByName(some.select(entity_id("customer-new", "c_custkey").alias("id")))
    new = ids.select(F.lit(views.SHOP).alias("crate_id"), "id", F.lit("contextual").alias("kind"), F.array(F.lit("Organization")).alias("types"), F.lit(False).alias("types_is_array"))
    return edit.upsert(views.entities(spark, sf_dir, "customer"), new).select("id", F.array_join("types", ",").alias("types"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 1 THEN 'a,new' ELSE 'a,b,new' END AS parts FROM orders")
def add_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single link is replaced, a list without the part grows, one with it stays."""
    m = F.col("o_orderkey") % 3
    parts = F.when(m == 0, F.array(F.lit("a"))).when(m == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("new")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(edit.add_part(parts, m != 0, F.lit("new")), ",").alias("parts"))


@query("SELECT p_partkey, p_type || ',' || p_brand || ',File' AS types FROM part")
def add_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types, _ = edit.add_type(F.array("p_type", "p_brand"), F.lit(True), "File")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(types, ",").alias("types"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ',File' END AS types FROM part")
def remove_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("File"), F.col("p_brand"), F.lit("File"))).otherwise(F.array(F.lit("File")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(edit.remove_type(types, "File"), ",").alias("types"))


_BASE = "https://example.org/shop/"
_NAMES = "SELECT url AS name FROM pages UNION ALL SELECT 'schema:' || c_mktsegment FROM customer UNION ALL SELECT '#customer-' || c_custkey FROM customer UNION ALL SELECT 'data/' || p_partkey FROM part UNION ALL SELECT 'name' UNION ALL SELECT 'plain'"


@query(f"SELECT name, CASE WHEN name = 'name' THEN 'http://schema.org/name' WHEN name LIKE 'schema:%' THEN 'http://schema.org/' || substr(name, 8) WHEN name LIKE 'http%' THEN name WHEN name LIKE '#%' THEN 'https://example.org/shop' || name ELSE '{_BASE}' || name END AS iri FROM (SELECT DISTINCT name FROM ({_NAMES}))")
def expand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, c: table(spark, sf_dir, name).select(c.alias("name"))
    names = one("pages", F.col("url")).unionByName(one("customer", F.concat(F.lit("schema:"), F.col("c_mktsegment")))).unionByName(one("customer", entity_id("customer", "c_custkey")))
    names = names.unionByName(one("part", F.concat(F.lit("data/"), F.col("p_partkey")))).unionByName(spark.createDataFrame([("name",), ("plain",)], "name string"))
    terms = spark.createDataFrame([("1.2", "name", "http://schema.org/name"), ("1.2", "schema", "http://schema.org/")], "version string, term string, iri string")
    home = names.distinct().select(F.lit("1.2").alias("version"), F.lit(_BASE).alias("base"), F.lit(None).cast("string").alias("vocab"), "name")
    return rdf.expand(home, terms).select("name", "iri")


_TERMS = {"Place": "Place", "Person": "Person", "Order": "Order", "n_name": "name", "r_name": "name", "c_name": "name", "c_mktsegment": "segment", "c_acctbal": "balance", "o_orderstatus": "orderStatus", "o_orderpriority": "priority", "o_totalprice": "price", "containedInPlace": "containedInPlace", "nationality": "nationality", "customer": "customer"}
_TERM = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN 'http://schema.org/{v}'" for k, v in _TERMS.items()) + " END"
_IRI = lambda c: f"'https://example.org/shop' || {c}"
_TABLES = ("region", "nation", "customer", "orders")
_NUMBERS = ("c_acctbal", "o_totalprice")
_TRIPLES = (
    f"SELECT DISTINCT * FROM (SELECT {_IRI('id')} AS s, '{rdf.RDF_TYPE}' AS p, {_TERM('type')} AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM (" + _union(_ENTITIES, *_TABLES)
    + f") UNION ALL SELECT {_IRI('src')}, {_TERM('key')}, {_IRI('dst')}, 'iri', NULL FROM (" + _union(_LINKS, *_TABLES[1:])
    + f") UNION ALL SELECT {_IRI('src')}, {_TERM('key')}, value, 'literal', CASE WHEN key IN ('c_acctbal', 'o_totalprice') THEN '{rdf.XSD}double' END FROM (" + _values_sql(*_TABLES) + "))"
)


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    crates = spark.createDataFrame([(views.SHOP, "1.2", _BASE)], "crate_id string, schema_version string, base string")
    terms = spark.createDataFrame([("1.2", k, f"http://schema.org/{v}") for k, v in _TERMS.items()], "version string, term string, iri string")
    return rdf.export_triples(crates, views.entities(spark, sf_dir, *_TABLES), views.properties(spark, sf_dir, *_TABLES), terms)


@query(_TRIPLES)
def triples_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir).select("s", "p", "o", "o_kind", "datatype")


@query(f"SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"' || coalesce('^^<' || datatype || '>', '') END || ' .' AS line FROM ({_TRIPLES})")
def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ntriples(_triples(spark, sf_dir)).select("line")


@query(_TRIPLES.replace("SELECT DISTINCT *", "SELECT DISTINCT s, p, o, o_kind, datatype"))
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written to files and read back."""
    folder = new_folder(spark)
    sinks.write_lines(rdf.ntriples(_triples(spark, sf_dir)), folder)
    lines = spark.read.text(folder).select(F.lit(views.SHOP).alias("crate_id"), F.col("value").alias("line"))
    return rdf.parse_ntriples(lines).select("s", "p", "o", "o_kind", "datatype")


@query(f"SELECT s, p, n, \"values\", CASE WHEN n = 1 THEN \"values\" END AS single FROM (SELECT s, p, count(*) AS n, string_agg(o, '|' ORDER BY o) AS \"values\" FROM ({_TRIPLES}) WHERE p <> '{rdf.RDF_TYPE}' GROUP BY s, p)")
def subject_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.subject_index(_triples(spark, sf_dir)).select("s", "p", F.col("n").cast("long").alias("n"), F.array_join("values", "|").alias("values"), "single")


@query("SELECT iri, CASE WHEN iri = 'http://schema.org/name' THEN 'name' WHEN iri LIKE 'http://schema.org/actions/%' THEN 'act:' || substr(iri, 27) WHEN iri LIKE 'http://schema.org/%' THEN 'schema:' || substr(iri, 19) WHEN iri LIKE 'https://example.org/shop/%' THEN substr(iri, 26) ELSE iri END AS name FROM (SELECT url AS iri FROM pages UNION SELECT 'http://schema.org/' || c_mktsegment FROM customer UNION SELECT 'http://schema.org/actions/' || c_mktsegment FROM customer UNION SELECT 'https://example.org/shop/' || p_partkey FROM part UNION SELECT 'http://schema.org/name')")
def compact_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, c: table(spark, sf_dir, name).select(c.alias("iri"))
    iris = one("pages", F.col("url")).unionByName(one("customer", F.concat(F.lit("http://schema.org/"), F.col("c_mktsegment")))).unionByName(one("customer", F.concat(F.lit("http://schema.org/actions/"), F.col("c_mktsegment"))))
    iris = iris.unionByName(one("part", F.concat(F.lit(_BASE), F.col("p_partkey")))).unionByName(spark.createDataFrame([("http://schema.org/name",)], "iri string")).distinct()
    terms = spark.createDataFrame([("1.2", "name", "http://schema.org/name"), ("1.2", "schema", "http://schema.org/"), ("1.2", "act", "http://schema.org/actions/")], "version string, term string, iri string")
    home = iris.select(F.lit("1.2").alias("version"), F.lit(_BASE).alias("base"), F.lit(None).cast("string").alias("vocab"), "iri")
    return rdf.compact(home, terms).select("iri", "name")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'string' WHEN 2 THEN 'bool' ELSE 'string' END AS tag, CASE event_id % 4 WHEN 1 THEN event_type WHEN 3 THEN CAST(event_id AS VARCHAR) END AS s, CASE WHEN event_id % 4 = 0 THEN user_id END AS i, CASE WHEN event_id % 4 = 2 THEN user_id % 2 = 0 END AS b FROM events")
def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.col("user_id").cast("string")).when(m == 1, F.col("event_type")).when(m == 2, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")).otherwise(F.col("event_id").cast("string"))
    datatype = F.when(m == 0, f"{rdf.XSD}integer").when(m == 3, f"{rdf.XSD}string")
    return table(spark, sf_dir, "events").select("event_id", rdf.typed_literal(text, datatype).alias("v")).select("event_id", "v.tag", "v.s", "v.i", "v.b")


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 AND p_partkey % 5 <> 0 THEN 'data' ELSE 'contextual' END AS kind FROM part")
def classify_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("http://schema.org/MediaObject"), F.col("p_type"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("schema:Dataset"))).otherwise(F.array(F.col("p_type")))
    id_ = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("#"), F.col("p_partkey"))).otherwise(F.concat(F.lit("part-"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", rdf.import_kind(id_, types).alias("kind"))


@query("SELECT '#order-' || o_orderkey AS crate_id, 'http://o/' || o_orderkey || '/ro-crate-metadata.json' AS metadata, 'http://o/' || o_orderkey || '/' AS root FROM orders WHERE o_orderstatus <> 'F'")
def root_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as graphs of triples; those of status F have no Dataset."""
    home = F.concat(F.lit("http://o/"), F.col("o_orderkey"), F.lit("/"))
    orders = table(spark, sf_dir, "orders").select(entity_id("order", "o_orderkey").alias("crate_id"), home.alias("root"), "o_orderstatus")
    about = orders.select("crate_id", F.concat("root", F.lit("ro-crate-metadata.json")).alias("s"), F.lit("http://schema.org/about").alias("p"), F.col("root").alias("o"))
    types = orders.select("crate_id", F.col("root").alias("s"), F.lit(rdf.RDF_TYPE).alias("p"), F.when(F.col("o_orderstatus") != "F", "http://schema.org/Dataset").otherwise("http://schema.org/Order").alias("o"))
    return rdf.roots(about.unionByName(types))


_REACHED = "WITH RECURSIVE e AS (" + _union(_LINKS, "nation", "customer", "orders") + "), r(id) AS (SELECT '#order-' || o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)"


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.lit(views.SHOP).alias("crate_id"), entity_id("order", "o_orderkey").alias("id"))
    return reach.reachable(starts, lookup.edges(views.properties(spark, sf_dir, "nation", "customer", "orders")))


@query(_REACHED + " SELECT id FROM r")
def reachable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir).select("id")


@query(_REACHED + ", n AS (" + _union(_ENTITIES, *_TABLES) + ") SELECT id FROM n WHERE id NOT IN (SELECT id FROM r)")
def unreachable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.unreachable(views.entities(spark, sf_dir, *_TABLES), _reached(spark, sf_dir)).select("id")


@query("WITH RECURSIVE c AS (SELECT o_orderkey AS child, o_orderkey // 4 AS parent FROM orders WHERE o_orderkey // 4 <> o_orderkey), t(package, depth) AS (SELECT DISTINCT o_orderkey, 0 FROM orders WHERE o_orderkey <= 3 UNION ALL SELECT c.child, depth + 1 FROM t JOIN c ON c.parent = t.package) SELECT '#order-' || package AS package, depth FROM t")
def subpackage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders nested by a quarter of their key."""
    orders = table(spark, sf_dir, "orders").withColumn("up", F.floor(F.col("o_orderkey") / 4)).select("o_orderkey", "up")
    children = orders.filter("up <> o_orderkey").select(entity_id("order", "up").alias("parent"), entity_id("order", "o_orderkey").alias("child"))
    return reach.nested_packages(orders.filter("o_orderkey <= 3").select(entity_id("order", "o_orderkey").alias("package")), children)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1.1' WHEN 1 THEN '1.2' END AS version FROM orders")
def context_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, ref = F.col("o_orderkey") % 3, "https://w3id.org/ro/crate/{}/context"
    texts = F.when(m == 0, F.array(F.lit("http://example.org"), F.lit(ref.format("1.1")))).when(m == 1, F.array(F.lit(ref.format("1.2")), F.lit(ref.format("1.1")))).otherwise(F.array(F.lit("http://example.org")))
    return table(spark, sf_dir, "orders").select("o_orderkey", schema_version(texts).alias("version"))
