"""Package documents made from the relational test tables: a package for each customer, whose files are the customer's orders.

They hold what packages can hold: descriptor, root and license, data entities and
contextual ones, one type or several, numbers, links, lists of links, nested
objects, JSON booleans and nulls, packages below, contexts with and without terms
and bases, and some documents that are none.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.plans.storage import tasks
from parcelgraph.plans.tables import Packages
from parcelgraph.plans.views import table

PROFILE = "https://w3id.org/ro/crate"
#: Of 50 customers the ones whose document is cut off, and whose root lacks a license.
CUT, UNLICENSED = 7, 8

# Fragments that Spark and other SQL read alike.
ORDER_ID = "CASE WHEN o_orderkey % 10 = 0 THEN '#order-' || o_orderkey ELSE 'order-' || o_orderkey || '.csv' END"
ORDER_TYPE = """CASE o_orderkey % 3 WHEN 0 THEN '"File"' WHEN 1 THEN '["File","Thing"]' ELSE '"Dataset"' END"""
_BELOW = f"""CASE o_orderkey % 8 WHEN 1 THEN ',"conformsTo":{{"@id":"{PROFILE}/1.2"}},"subjectOf":{{"@id":"https://store.example/' || o_orderkey || '/meta.json"}}' WHEN 5 THEN ',"conformsTo":{{"@id":"{PROFILE}/1.2"}}' ELSE '' END"""
_ORDER = f"""'{{"@id":"' || {ORDER_ID} || '","@type":' || {ORDER_TYPE} || ',"price":' || CAST(o_totalprice AS STRING) || ',"lines":' || (o_orderkey % 7) || ',"status":"' || o_orderstatus
    || '","author":{{"@id":"#agent-' || o_custkey || '"}},"see":[{{"@id":"#lic"}},{{"@id":"order-' || (o_orderkey + 1) || '.csv"}}],"detail":{{"@id":"#d-' || o_orderkey || '","priority":"' || o_orderpriority
    || '","deep":{{"level":' || (o_orderkey % 5) || '}}}},"tags":["t","' || o_orderstatus || '"],"flag":true,"none":null' || {_BELOW} || '}}'"""
CONTEXT = f"""CASE c_custkey % 3 WHEN 0 THEN '"{PROFILE}/1.1/context"' WHEN 1 THEN '["{PROFILE}/1.2/context",{{"ex":"https://example.org/ns/","segment":"https://example.org/terms#segment"}}]'
    ELSE '["{PROFILE}/1.2/context",{{"@base":"urn:uuid:00000000-0000-7000-8000-' || lpad(CAST(c_custkey AS STRING), 12, '0') || '"}}]' END"""
_ROOT = f"""'{{"@id":"./","@type":"Dataset","name":"' || c_name || '","description":"' || CASE WHEN c_custkey % 2 = 0 THEN 'all orders' ELSE '' END || '","datePublished":"2024-01-01"'
    || CASE WHEN c_custkey % 50 = {UNLICENSED} THEN '' WHEN c_custkey % 3 = 2 THEN ',"license":"CC0"' ELSE ',"license":{{"@id":"#lic"}}' END || ',"hasPart":[' || coalesce(parts, '') || '],"segment":"' || c_mktsegment || '","ex:balance":' || CAST(c_acctbal AS STRING) || '}}'"""
_DESCRIPTOR = f"""'{{"@id":"ro-crate-metadata.json","@type":"CreativeWork","conformsTo":{{"@id":"{PROFILE}/1.2"}},"about":{{"@id":"./"}}}}'"""
_LICENSE = """'{"@id":"#lic","@type":"CreativeWork","name":"free"}'"""


def package_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crate_id, source, text, dealt to all tasks by customer: orders travel as columns and become text where their package is."""
    n = tasks(spark)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").repartition(n, "o_custkey")
    orders = orders.select("o_custkey", "o_orderkey", F.expr(_ORDER).alias("text"), F.expr(f"""'{{"@id":"' || {ORDER_ID} || '"}}'""").alias("part"))
    listed = F.sort_array(F.collect_list(F.struct("o_orderkey", "text", "part")))
    orders = orders.groupBy("o_custkey").agg(listed.alias("all"))  # one document's
    joined = lambda name: F.array_join(F.transform("all", lambda x: x[name]), ",")
    customers = table(spark, sf_dir, "customer").repartition(n, "c_custkey")
    rows = customers.hint("shuffle_hash").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns({"parts": joined("part"), "files": joined("text")})
    text = f"""'{{"@context":' || {CONTEXT} || ',"@graph":[' || {_DESCRIPTOR} || ',' || {_ROOT} || ',' || {_LICENSE} || coalesce(',' || files, '') || ']' || CASE WHEN c_custkey % 50 = {CUT} THEN '' ELSE '}}' END"""
    return rows.select(F.expr("'c-' || c_custkey").alias("crate_id"), F.lit("tables").alias("source"), F.expr(text).alias("text"))


_parsed: dict[tuple, DataFrame] = {}


def _versions(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of the files that packages are made of."""
    hadoop, found = spark._jsc.hadoopConfiguration(), []
    for name in ("customer", "orders"):
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(hadoop).getFileStatus(path)
            found.append((file, status.getLen(), status.getModificationTime()))
    return tuple(found)


def packages(spark: SparkSession, sf_dir: str, properties: bool | str | tuple[str, ...] = True, links: bool = True, extra: tuple[str, ...] = ()) -> Packages:
    """The packages of ``package_texts``, parsed once for each state of their files as long as the parsed table is there; the rest as in ``parse``."""
    from parcelgraph.sources.packages import parse_documents, tables

    at, graph = (spark.sparkContext.applicationId, *_versions(spark, sf_dir)), bool(properties)
    for key in [k for k in _parsed if k[:-1] == at and k[-1] in (graph, True)]:
        try:
            if _parsed[key].limit(1).count() >= 0:
                return tables(_parsed[key], properties, links, extra)
        except PySparkException:
            pass
    _parsed[(*at, graph)] = parse_documents(package_texts(spark, sf_dir), graph, dealt=True)
    return tables(_parsed[(*at, graph)], properties, links, extra)


#: The same packages in SQL: c (packages), o (orders as entities), e (entities), p (top-level properties: origin, tag, s as text, json), n (nested ones), l (links).
BASE_SQL = f"""c AS (SELECT c_custkey AS k, 'c-' || c_custkey AS crate_id, c_name, c_mktsegment, c_acctbal, c_custkey % 3 AS m FROM customer WHERE c_custkey % 50 NOT IN ({CUT}, {UNLICENSED})),
o AS (SELECT o.*, c.k, c.crate_id, c.m, CAST(2 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pos, {ORDER_ID} AS id, {ORDER_TYPE} AS type_json FROM orders AS o JOIN c ON c.k = o.o_custkey),
e AS (SELECT crate_id, 0 AS pos, 'ro-crate-metadata.json' AS id, 'descriptor' AS kind, 'CreativeWork' AS types FROM c UNION ALL SELECT crate_id, 1, './', 'root', 'Dataset' FROM c UNION ALL SELECT crate_id, 2, '#lic', 'contextual', 'CreativeWork' FROM c
    UNION ALL SELECT crate_id, pos, id, CASE WHEN id LIKE '#%' THEN 'contextual' ELSE 'data' END, CASE o_orderkey % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'File,Thing' ELSE 'Dataset' END FROM o),
l AS (SELECT crate_id, 'ro-crate-metadata.json' AS src, 'about' AS key, './' AS dst, 'fixed' AS origin FROM c UNION ALL SELECT crate_id, 'ro-crate-metadata.json', 'conformsTo', '{PROFILE}/1.2', 'fixed' FROM c
    UNION ALL SELECT crate_id, './', 'license', CASE WHEN m = 2 THEN 'CC0' ELSE '#lic' END, 'fixed' FROM c UNION ALL SELECT crate_id, './', 'hasPart', id, 'dynamic' FROM o UNION ALL SELECT crate_id, id, 'author', '#agent-' || k, 'dynamic' FROM o
    UNION ALL SELECT crate_id, id, 'see', '#lic', 'dynamic' FROM o UNION ALL SELECT crate_id, id, 'see', 'order-' || (o_orderkey + 1) || '.csv', 'dynamic' FROM o
    UNION ALL SELECT crate_id, id, 'conformsTo', '{PROFILE}/1.2', 'dynamic' FROM o WHERE o_orderkey % 8 IN (1, 5) UNION ALL SELECT crate_id, id, 'subjectOf', 'https://store.example/' || o_orderkey || '/meta.json', 'dynamic' FROM o WHERE o_orderkey % 8 = 1)"""
