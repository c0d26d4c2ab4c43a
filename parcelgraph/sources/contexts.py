"""Context documents that packages refer to: a few configuration files on the driver, or a table of any number."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgraph.operators.rdf import PROFILE_CONTEXTS
from parcelgraph.plans.storage import written


class MissingContext(LookupError):
    """A context that is neither given nor fetched."""


class InvalidContext(ValueError):
    """A context that isn't text, a list or an object."""


def context_terms(value: object) -> tuple[dict[str, str], list[str]]:
    """The terms of a parsed context and the URLs that it refers to; ``@`` keys and terms without an IRI are passed over, and of a term the last IRI counts."""
    if isinstance(value, str):
        return {}, [value]
    if isinstance(value, list):
        terms, urls = {}, []
        for item in value:
            more, further = context_terms(item)
            terms |= more
            urls += further
        return terms, urls
    if not isinstance(value, dict):
        raise InvalidContext("a context is text, a list or an object")
    iris = {k: v.get("@id") if isinstance(v, dict) else v for k, v in value.items() if not k.startswith("@")}
    return {k: v for k, v in iris.items() if isinstance(v, str)}, []


class Contexts:
    """Contexts by URL: those given, and with ``fetch`` those that it finds."""

    def __init__(self, documents: dict[str, str] | None = None, fetch: Callable[[str], str | None] | None = None) -> None:
        self._documents, self._fetch = dict(documents or {}), fetch

    def _document(self, url: str) -> object:
        if url not in self._documents:
            text = self._fetch(url) if self._fetch is not None else None
            if text is None:
                raise MissingContext(url)
            self._documents[url] = text
        parsed = json.loads(self._documents[url])
        return parsed["@context"] if isinstance(parsed, dict) and "@context" in parsed else parsed

    def terms(self, url: str) -> dict[str, str]:
        """All terms behind ``url``; a context's own count before those of the contexts that it refers to, each of which is read once."""
        met, waiting, order = set(), [url], []
        while waiting:
            if (at := waiting.pop()) not in met:
                met.add(at)
                terms, urls = context_terms(self._document(at))
                order.append(terms)
                waiting += urls
        found: dict[str, str] = {}
        for terms in reversed(order):
            found |= terms
        return found

    def table(self, spark: SparkSession, urls: list[str]) -> DataFrame:
        """url, term, iri, for ``export_triples``."""
        rows = [(url, k, v) for url in urls for k, v in self.terms(url).items()]
        return spark.createDataFrame(rows, "url string, term string, iri string")


def context_items(documents: DataFrame) -> DataFrame:
    """url, pos, term, iri, nested of context documents (url, text): a row for each term, and for each URL that a context refers to (``nested``).

    A context is text, an object or a list of both, as it is or under ``@context``.
    Keys that begin with ``@`` and terms without an IRI are passed over; a document
    that isn't JSON has no rows.
    """
    spark = documents.sparkSession
    listed = spark.sql(
        """SELECT url, CASE WHEN schema_of_variant(c) LIKE 'ARRAY<%' THEN try_variant_get(c, '$', 'array<variant>') ELSE array(c) END AS items
           FROM (SELECT url, coalesce(try_variant_get(v, '$["@context"]', 'variant'), v) AS c FROM (SELECT url, try_parse_json(text) AS v FROM {t}) WHERE v IS NOT NULL)""",
        t=documents,
    ).select("url", F.posexplode("items").alias("pos", "item"))
    return spark.sql(
        """SELECT url, pos, CAST(NULL AS string) AS term, CAST(NULL AS string) AS iri, try_variant_get(item, '$', 'string') AS nested FROM {t} WHERE schema_of_variant(item) = 'STRING'
           UNION ALL
           SELECT url, pos, term, iri, NULL FROM (
               SELECT url, t.pos, e.key AS term, CASE WHEN schema_of_variant(e.value) = 'STRING' THEN try_variant_get(e.value, '$', 'string') WHEN schema_of_variant(try_variant_get(e.value, '$["@id"]', 'variant')) = 'STRING' THEN try_variant_get(e.value, '$["@id"]', 'string') END AS iri
               FROM {t} AS t, LATERAL variant_explode(item) AS e(epos, key, value) WHERE schema_of_variant(item) LIKE 'OBJECT<%')
           WHERE iri IS NOT NULL AND NOT startswith(term, '@')""",
        t=listed,
    )


def close_contexts(roots: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, term, iri) with all terms behind each ``url`` of roots, for ``export_triples``, and (url, missing) with the URLs behind it that ``documents`` (url, text) lacks.

    All roots are followed at once, a join a level.  A context's own terms count
    before those of contexts that it refers to, and of these the last one's first,
    with all behind it; within a context the later term counts.  A context is met
    once for each root, so cycles end.  The profile's own contexts are no documents.
    """
    items = written(context_items(documents))
    links = items.filter("nested IS NOT NULL").select(F.col("url").alias("at"), "pos", "nested")
    order = F.lpad((F.lit(99_999_999) - F.col("pos")).cast("string"), 8, "0")  # the last one first
    met = written(roots.select("url").distinct().select("url", F.col("url").alias("at"), F.lit("").alias("path"), F.array("url").alias("trail")))
    level = met
    while not level.isEmpty():
        further = level.join(links, "at").filter(~F.array_contains("trail", F.col("nested"))).select("url", F.col("nested").alias("at"), F.concat("path", order).alias("path"), F.concat("trail", F.array("nested")).alias("trail"))
        further = further.groupBy("url", "at").agg(F.min(F.struct("path", "trail")).alias("f")).select("url", "at", "f.*")
        known = met.select("url", "at", F.col("path").alias("known"))
        level = written(further.join(known, ["url", "at"], "left").filter("known IS NULL OR path < known").drop("known"))
        met = written(met.unionByName(level).groupBy("url", "at").agg(F.min(F.struct("path", "trail")).alias("f")).select("url", "at", "f.*"))
    own = items.filter("term IS NOT NULL").select(F.col("url").alias("at"), "pos", "term", "iri")
    terms = met.join(own, "at").groupBy("url", "term").agg(F.min_by("iri", F.struct("path", -F.col("pos"))).alias("iri"))
    asked = met.select("url", F.col("at").alias("missing"))
    for profile in PROFILE_CONTEXTS:
        asked = asked.filter(~F.col("missing").contains(profile))
    return terms, asked.join(documents.select(F.col("url").alias("missing")).distinct(), "missing", "left_anti").select("url", "missing")
